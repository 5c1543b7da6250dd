"""Exact top-k and WARC archives."""

import gzip
import hashlib
import math
import random
import uuid

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import topk, warc
from quillstone.llm.storage import fresh


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), rng.normal(size=8).astype(float).tolist(), 0) for i in range(700)]
    rows += [(700 + i, rows[50][1], 0) for i in range(9)]  # ties
    bad = [(1000, None, 0), (1050, [1.0, None] + [0.0] * 6, 0), (1100, [math.nan] * 8, 0), (1150, [math.inf] * 8, 0), (None, [1.0] * 8, 0)]
    table = topk.quantised(vectors(spark, rows + bad))
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows}
    found = topk.top_k(table, table.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 5, shard=100).collect()
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)


def test_top_k_of_clusters_prunes(spark, monkeypatch):
    """Far clusters are left out by their bounds; of huge components a vector takes no part; sizes are not mixed."""
    monkeypatch.setattr(topk, "BLOCK", 8)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(960)]
    rows += [(2000, [3e38] * 16, 0), (2050, [-3e38] + [0.0] * 15, 0), (3000, [1.0, 2.0], 0), (3050, [2.0, 1.0], 0), (3100, [], 0)]
    table = topk.quantised(vectors(spark, rows)).cache()
    asked = table.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    sent = []
    keep = topk.cut
    monkeypatch.setattr(topk, "cut", lambda f, name: sent.append((name, keep(f, name))) or sent[-1][1])
    found = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, asked, 5, shard=40).collect())
    whole = {r.vec_id: r.v for r in table.collect()}
    assert 2000 not in whole and 2050 not in whole
    want = []
    for q in (i for i in whole if i % 50 == 0 and whole[i]):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert found == sorted(want)
    pairs = sum(len(r.ids) // 8 for r in dict(sent)["survivors"].collect())
    assert pairs < 0.5 * 25 * asked.count()
    scored: list[int] = []
    ids = np.arange(960)
    order = np.argsort(ids % 12, kind="stable")
    v = np.array([whole[i] for i in ids.tolist()])
    topk.search_shard(ids[order], v[order], ids[::50], v[::50], 5, scored=scored)
    assert sum(scored) < 0.4 * 960 * 20


def test_top_k_of_few_and_none(spark):
    table = topk.quantised(vectors(spark, [(0, [1.0], 0), (1, [2.0], 0), (0, [1.0], 0)]))
    asked = table.where("vec_id = 0").withColumnRenamed("vec_id", "query_id")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table, asked).collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(table.limit(0), asked.limit(0)).collect() == []


def pages():
    rng = random.Random(1)
    big, other = "x" * 5000, "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(4000))
    rows = [(i, f"http://h/{i}", big) for i in range(6)] + [(10, "u", "small"), (11, "u", "small"), (12, None, None), (13, "v", ""), (14, "w", other), (15, "w é\r\n", other), (None, "n", big), (16, "z", "\x1f\x08WARC/1.1 " * 300), (16, "z", "\x1f\x08WARC/1.1 " * 300)]
    return rows + [(100 + i, f"http://h/{i}", "".join(rng.choices("abcdef<>", k=rng.randrange(3000)))) for i in range(200)]


def expected(rows):
    largest = {}
    for i, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 1000 and i != largest[h]
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", largest[h] if revisit else None))
    return sorted(out, key=str)


def test_round_trip_over_small_splits(spark):
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    archives = warc.write_warc(frame, fresh(spark, "warc"))
    for split in (1000, 7, 1 << 20) if archives.agg(F.sum("bytes")).first()[0] < 1e5 else (4096, 1 << 20):
        read = warc.read_warc(archives, split).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str) == expected(rows)
    texts = {r.page_id: r.payload for r in read if r.record_type == "response"}
    assert bytes(texts[15]) == dict((i, h) for i, _, h in rows)[15].encode()


def test_archives_are_plain_gzip_members(spark, tmp_path):
    archives = warc.write_warc(spark.createDataFrame(pages(), "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    path = archives.first().path.removeprefix("file://")
    text = gzip.open(path).read()
    assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Record-ID: ") == len(pages())
    assert uuid.UUID(text.split(b"urn:uuid:")[1][:36].decode())


def test_foreign_archives(spark, tmp_path):
    """A warcinfo, a request, a response with a hex digest, a metadata record, a foreign revisit and one with a wrong digest."""
    page, http = b"<p>\xc3\xa9</p>", b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n"
    sha, two = hashlib.sha1(page).hexdigest(), "WARC-Record-ID: <urn:uuid:6f1f5a3c-8d0e-4a6b-9d49-0d5a3c1f2b7e>"
    records = [
        (["WARC-Type: warcinfo", "WARC-Record-ID: <urn:x:1>", "Content-Type: application/warc-fields"], b"software: x\r\n"),
        (["WARC-Type: request", two, "WARC-Target-URI: http://h/%E4%B8%80", "Content-Type: application/http;msgtype=request"], b"GET / HTTP/1.1\r\nHost: h\r\n\r\n"),
        (["WARC-Type: response", two, f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response"], http + page),
        (["WARC-Type: metadata", "Content-Type: text/plain", "WARC-Payload-Digest: md5:abc"], b"via: y\r\n\r\nz"),
        (["WARC-Type: revisit", "WARC-Refers-To: <urn:uuid:6f1f5a3c-8d0e-4a6b-9d49-0d5a3c1f2b7e>", "Content-Type: application/http"], http),
        (["WARC-Type: response", "WARC-Payload-Digest: sha1:" + "A" * 32, "Content-Type: application/http"], http + page),
        (["no colon"], b""),
    ]
    raw = b"".join(gzip.compress(b"WARC/1.0\r\n" + "\r\n".join([*h, f"Content-Length: {len(b)}"]).encode() + b"\r\n\r\n" + b + b"\r\n\r\n") for h, b in records)
    (tmp_path / "a.warc.gz").write_bytes(raw)
    archives = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(raw))], "path string, bytes long")
    for split in (50, 1 << 20):
        found = sorted(((r.record_type, bytes(r.payload) if r.payload is not None else None, r.payload_digest, r.intact, r.page_id, r.refers_to) for r in warc.read_warc(archives, split).collect()), key=str)
        assert found == sorted([
            ("warcinfo", records[0][1], hashlib.sha1(records[0][1]).hexdigest(), None, None, None), ("request", b"", hashlib.sha1(b"").hexdigest(), None, None, None),
            ("response", page, sha, True, None, None), ("metadata", records[3][1], hashlib.sha1(records[3][1]).hexdigest(), None, None, None),
            ("revisit", None, None, None, None, None), ("response", page, sha, False, None, None), (None, b"", hashlib.sha1(b"").hexdigest(), None, None, None),
        ], key=str)


def test_urls_hot_payloads_and_long_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_DIGESTS", 1)
    urls = {1: "http://h/\u4e00/é", 2: "http://h/a%20b?x=1", 3: "http://h/a b\r\nWARC-Type: x"}
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh é", k=3_000_000))
    rows = [(i, urls.get(i, "u"), "hot" * 500 if i > 10 else "cold" * 400 if i > 5 else long if i == 4 else "s") for i in range(60)] + [(200, "u", long)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("mine")).withColumn("largest", F.lit(1)).withColumn("key", F.lit("k"))
    read = warc.round_trip(spark, frame).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read), key=str) == expected(rows)
    import urllib.parse

    found = {r.page_id: r.target_uri for r in read}
    assert all(urllib.parse.unquote(found[i]) == urllib.parse.unquote(u) for i, u in urls.items()) and found[1] == "http://h/%E4%B8%80/%C3%A9" and found[2] == urls[2]


def test_no_pages(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
