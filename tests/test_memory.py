"""The keyed layer: searches, time to live, retention, and their properties."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators import keyed as K
from quillstone.operators import search as S

KEYS = ["/coding/cpp/move", "/coding/cpp/template", "/coding/python/async", "/agent/personality", "/coding2/x"]


def kv(spark, rows):
    """rows: (key, value, ttl, written)."""
    frame = spark.createDataFrame(rows, "k string, v string, ttl long, w long")
    return K.entries(frame, F.col("k"), F.col("v"), F.col("w"), F.col("ttl"))


@pytest.fixture
def table(spark):
    return kv(spark, [(k, f"value of {k}", 0, i) for i, k in enumerate(KEYS)])


def keys(frame):
    return [r.key for r in frame.orderBy("key").collect()]


def test_searches(table):
    assert len(keys(S.prefix(table, "/coding/cpp", 0))) == 2
    assert len(keys(S.between(table, "/coding/cpp/", "/coding/cpp0", 0))) == 2
    assert keys(S.pattern(table, "/CODING/.*/async", 0)) == ["/coding/python/async"]
    assert keys(S.pattern(table, "/CODING/.*/async", 0, S.Options(case_sensitive=True))) == []
    assert "/coding/cpp/move" in keys(S.fuzzy(table, "/coding/cpp/movf", 0))
    assert keys(S.prefix(table, "/", 0, S.Options(namespace="/coding"))) == sorted(k for k in KEYS if k.startswith("/coding/"))
    assert keys(S.prefix(table, "/", 0, S.Options(max_results=1))) == ["/agent/personality"]
    with pytest.raises(ValueError):
        S.prefix(table, "", 0)


def test_prefix_is_a_range(table):
    assert keys(S.prefix(table, "/coding/", 0)) == keys(S.between(table, "/coding/", "/coding0", 0))


def test_namespaces(table):
    assert K.full_key("/coding/cpp/", "move") == "/coding/cpp/move"
    assert keys(K.delete_namespace(table, "/coding/cpp")) == ["/agent/personality", "/coding/python/async", "/coding2/x"]
    assert keys(K.iterate(table, 0)) == sorted(KEYS)


def test_time_to_live(spark):
    t = kv(spark, [("a", "x", 100, 0), ("b", "x", 0, 0)])
    assert keys(K.live(t, 100)) == ["a", "b"] and keys(K.live(t, 101)) == ["b"]
    assert keys(K.purge_expired(t, 101)) == ["b"]
    assert {r.status: r.entries for r in K.status_counts(t, 101).collect()} == {"expired": 1, "valid": 1}
    assert keys(K.live(K.expire(t, "b", 50), 50)) == ["a"]


def test_upsert_keeps_the_newest(spark):
    t = K.upsert(kv(spark, [("a", "old", 0, 1), ("b", "x", 0, 1)]), kv(spark, [("a", "new", 0, 2)]))
    assert sorted((r.key, r.value) for r in t.collect()) == [("a", "new"), ("b", "x")]


def test_retention_of_two(spark):
    t = kv(spark, [("a", "1", 1000, 1), ("b", "2", 1000, 2)])  # 32 bytes each
    assert keys(K.retained(t, 60, buckets=2)) == ["b"]
    assert keys(K.retained(t, 64, buckets=2)) == ["a", "b"]
    assert keys(K.retained(t, 10, buckets=2)) == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 50), st.booleans()), min_size=1, max_size=30), st.integers(0, 1200))
def test_retention_equals_eviction(spark, rows, capacity):
    t = kv(spark, [(f"k{i:02d}", "v" * (i % 9), 0 if p else 10_000, a) for i, (a, p) in enumerate(rows)])
    entries = [(f"k{i:02d}", -(-(3 + i % 9 + 30) // 8) * 8, a, p) for i, (a, p) in enumerate(rows)]
    used = sum(b for _, b, _, _ in entries)
    loose = sorted((e for e in entries if not e[3]), key=lambda e: (e[2], [-ord(c) for c in e[0]]))
    while loose and used > capacity:
        used -= loose.pop(0)[1]
    assert keys(K.retained(t, capacity, buckets=3)) == sorted([e[0] for e in entries if e[3]] + [e[0] for e in loose])


def test_tags(spark):
    t = kv(spark, [("a", "alpha beta_1 π2x", 0, 0), ("b", "Alpha", 0, 0), ("c", "x-y z", 0, 0)])
    assert keys(S.tag(t, "alpha", 0)) == ["a"] and keys(S.tag(t, "π2x", 0)) == ["a"]
    assert keys(S.tag(t, "x-y", 0)) == ["c"] and keys(S.tag(t, "q", 0)) == []


def test_distances_are_over_bytes(spark):
    row = spark.range(1).select(X.byte_levenshtein(F.lit("é"), F.lit("e")).alias("a"), X.byte_levenshtein(F.lit("e"), F.lit("é")).alias("b"), X.fuzzy_score(F.lit(""), F.lit("")).alias("c")).first()
    assert (row.a, row.b, row.c) == (2, 2, 1.0)
