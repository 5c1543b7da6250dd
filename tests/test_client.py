"""The client object, its commands and requests."""

import json

import pytest

from quillstone.operators.client import Cache


class Clock:
    now = 1000

    def __call__(self):
        return self.now


@pytest.fixture
def cache(spark):
    c = Cache(spark, clock=Clock())
    for key in ("/coding/cpp/move", "/coding/cpp/template", "/coding/python/async", "/agent/personality"):
        c.set(key, f"text of {key}")
    return c


def test_reading_and_writing(cache):
    assert len(cache) == 4 and cache["/coding/cpp/move"] == "text of /coding/cpp/move" and "/x" not in cache
    cache["/x"] = "1"
    cache["/x"] = "2"
    assert cache.get("/x") == "2" and cache.count() == 5
    del cache["/x"]
    assert cache.get("/x") is None and not cache.delete("/x")
    with pytest.raises(KeyError):
        cache["/x"]
    cache.set_json("/j", {"a": [1, "é"]})
    assert cache.get_json("/j") == {"a": [1, "é"]}
    with pytest.raises(ValueError):
        cache.set("", "x")


def test_time(cache):
    cache.set("/t", "x", ttl=100)
    cache.clock.now = 1100
    assert "/t" in cache
    cache.clock.now = 1101
    assert "/t" not in cache and cache.purge_expired() == 1
    cache.clock.now = 1000


def test_namespaces_and_searches(cache, spark):
    assert [k for k, _ in cache.items("/coding/cpp")] == ["/coding/cpp/move", "/coding/cpp/template"]
    assert cache.search_prefix("/coding/").count() == 3 and cache.search_regex("ASYNC$").count() == 1
    assert cache.delete_ns("/coding/cpp") == 2 and list(cache.keys()) == ["/agent/personality", "/coding/python/async"]
    cache.set_batch(spark.createDataFrame([("a:1", "x"), ("a:2", "y"), ("b:1", "z")], "key string, value string"))
    assert cache.request("GET", "/namespace/a")[1] == {"count": 2, "keys": ["a:1", "a:2"]}
    assert "b" in cache.request("GET", "/api/v1/namespaces")[1]["namespaces"]


def test_vectors(cache):
    cache.set_vector("/v/1", "one", [1.0, 0.0])
    cache.set_vector("/v/2", "two", [0.0, 1.0])
    cache.set_vector("/v/2", "two again", [1.0, 1.0])
    assert [r.key for r in cache.search_vector([1.0, 0.1], 2).collect()] == ["/v/1", "/v/2"]
    assert cache.get_vector("/v/2") == [1.0, 1.0] and cache.get_vector("/coding/cpp/move") is None


def test_commands(cache):
    assert cache.execute("PING") == "+PONG" and cache.execute("set k v w") == "+OK" and cache.execute("GET k") == "$3\nv w"
    assert cache.execute("EXISTS k") == ":1" and cache.execute("DEL k") == ":1" and cache.execute("GET k") == "$-1" and cache.execute("COUNT") == ":4"
    assert cache.execute("SEARCH prefix /coding/cpp").startswith("*2\n/coding/cpp/move\t1.0") and cache.execute("what") == "-ERR" and cache.execute("QUIT") == "+BYE"


def test_requests(cache):
    assert cache.request("PUT", "/cache/k", body=json.dumps({"value": "v"}))[0] == 200
    assert cache.request("GET", "/cache/k") == (200, {"key": "k", "value": "v"}) and cache.request("GET", "/cache/k/exists")[1] == {"exists": True}
    assert cache.request("DELETE", "/cache/k")[0] == 200 and cache.request("GET", "/cache/k")[0] == 404 and cache.request("GET", "/search")[0] == 400
    assert cache.request("POST", "/batch", body=json.dumps({"entries": [{"key": "p1", "value": "a"}, {"key": "p2", "value": "b"}]}))[1] == {"stored": 2}
    assert cache.request("GET", "/search", {"q": "p", "max_results": "20000"})[1]["count"] == 2 and cache.request("GET", "/nowhere")[0] == 404


def test_snapshots_and_memory(spark, tmp_path):
    clock = Clock()
    c = Cache(spark, f"file://{tmp_path}/c", clock=clock)
    c.set("a", "1")
    c.close()
    again = Cache(spark, f"file://{tmp_path}/c", clock=clock)
    assert again["a"] == "1"
    small = Cache(spark, max_memory=80, clock=clock)
    for i in range(5):
        clock.now += 1
        small.set(f"k{i}", "v", ttl=10_000)
    assert list(small.keys()) == ["k3", "k4"] and small.stats()["memory_used"] <= 80
    clock.now = 1000
