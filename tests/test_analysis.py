"""Vectors, graphs, code, books, probes, sources and streams on small inputs."""

import io
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillstone.functions import hashes as H
from quillstone.functions import text as X
from quillstone.functions import vectors as V
from quillstone.operators import aggregates as A
from quillstone.operators import books as B
from quillstone.operators import code as C
from quillstone.operators import graph as G
from quillstone.operators import vectors as R
from quillstone.sources import files as S
from quillstone.streaming import streams


def test_vector_hits_itself(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 16))
    t = spark.createDataFrame([(f"k{i}", x.tolist()) for i, x in enumerate(v)] + [("other", [1.0, 2.0])], "key string, embedding array<double>")
    best = R.exact_top_k(t, v[7].tolist(), 3).collect()
    assert best[0].key == "k7" and abs(best[0].score - 1) < 1e-9
    zero = spark.range(1).select(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("c"), V.mean_pooled(F.array(F.array(F.lit(1.0)), F.array(F.lit(3.0)), F.array(F.lit(9.0))), F.array(F.lit(1), F.lit(1), F.lit(0))).alias("m")).first()
    assert zero.c == 0 and zero.m == [2.0]


def test_stored_index_recall(spark, tmp_path):
    """Over noise, where nothing clusters: every row is indexed, one row in a hundred is a query."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 64))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, [1.0]), (5001, None), (5002, [0.0] * 64)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    R.write_index(R.build_index(t, 64, name="vec_id"), str(tmp_path), "vec_id")
    codes, vectors = spark.read.parquet(f"{tmp_path}/codes"), spark.read.parquet(f"{tmp_path}/vectors")
    assert codes.count() == 4001 and codes.schema["codes"].dataType.simpleString() == "array<bigint>"
    asked = t.where("vec_id % 100 = 0 and vec_id < 4000").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in R.all_top_k(t, asked, 10).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert exact == {(q, int(i)) for q in range(0, 4000, 100) for i in np.argsort(-(unit @ unit[q]), kind="stable")[:10]}
    found = {(r.query_id, r.vec_id) for r in R.indexed_all_top_k(codes.join(vectors, "vec_id"), asked, 10).collect()}
    assert len(exact & found) >= 0.95 * len(exact)
    hits = [len({r.vec_id for r in R.indexed_top_k(codes, vectors, v[q].tolist(), 10, name="vec_id").collect()} & {i for p, i in exact if p == q}) for q in (0, 700, 1900)]
    assert sum(hits) >= 27


def test_batch_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "VECTOR_PART", 30)
    monkeypatch.setattr(R, "QUERY_BLOCK", 4)
    v = np.random.default_rng(5).normal(size=(100, 8))
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(200, None), (201, [1.0])], "vec_id long, embedding array<double>")
    asked = t.where("vec_id < 10").withColumnRenamed("vec_id", "query_id")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(q, int(i), n + 1) for q in range(10) for n, i in enumerate(np.argsort(-(unit @ unit[q]))[:3])}
    assert {(r.query_id, r.vec_id, r.rank) for r in R.all_top_k(t, asked, 3).collect()} == want
    assert {(r.query_id, r.vec_id, r.rank) for r in R.batch_top_k(t, v[:10], list(range(10)), 3).collect()} == want
    codes = R.build_index(t, 8, name="vec_id")
    assert {(r.query_id, r.vec_id, r.rank) for r in R.indexed_all_top_k(codes, asked, 3, over=100).collect()} == want
    assert R.all_top_k(t.limit(0), asked, 3).collect() == [] == R.all_top_k(t, asked.limit(0), 3).collect()


def test_recall_of_codes_does_not_fall_with_the_rows(spark):
    """Noise with copies, zero vectors and NaN, where the first candidates are far too few."""
    v = np.random.default_rng(8).normal(size=(6000, 64))
    v[3000:3100], v[5000:5030], v[5500, 3] = v[:100], 0.0, np.nan
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = t.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.vec_id) for r in R.all_top_k(t, asked, 10).collect()}
    found = R.indexed_all_top_k(R.build_index(t, 64, name="vec_id"), asked, 10, over=1).collect()
    assert len(found) == len(exact) == 600 and len(exact & {(r.query_id, r.vec_id) for r in found}) >= 0.97 * len(exact)


def test_distances_of_codes_at_an_angle():
    """The least distance that all but one in a hundred codes keep, by drawing them."""
    radii = R._radii(256, 0.01)
    assert len(radii) == R.ANGLES + 1 and radii[0] == 0 and radii[-1] == 256 and (np.diff(radii) >= 0).all()
    drawn = np.random.default_rng(9)
    for step in (1, 200, 341, 512, 1000):
        apart = drawn.binomial(256, step / R.ANGLES, 100_000)
        assert (apart <= radii[step]).mean() > 0.988 and (apart < radii[step]).mean() < 0.992


def test_recall_query_on_more_rows(spark, tmp_path):
    """Its SQL says that the recall is reached, with any number of rows and queries."""
    from quillstone.plans.catalogue import QUERIES

    for name, n, first, queries in (("many", 30_000, 0, 300), ("none", 50, 1, 0)):
        v = np.random.default_rng(10).normal(size=(n, 64)).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 64, pa.int32()), pa.array(v.ravel()))
        (tmp_path / name).mkdir()
        pq.write_table(pa.table({"vec_id": np.arange(n) + first, "embedding": lists}), tmp_path / name / "embeddings.parquet")
        assert tuple(QUERIES["vec_index_recall"](spark, f"{tmp_path}/{name}").first()) == (True, queries)


def test_paths_of_many_levels(spark):
    """Cut to the first paths level by level, the paths are the first of all."""
    rng = np.random.default_rng(3)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2)) if a != b}
    t = spark.createDataFrame(sorted(edges), "src long, dst long")

    def slow(path):
        up = sorted(a for a, b in edges if b == path[-1])
        if not up or len(path) == 6 or path[-1] in path[:-1]:
            return [tuple(path)]
        return [p for a in up for p in slow([*path, a])]

    want = sorted(slow([3]))
    assert [tuple(r.path) for r in G.paths_up(t, 3, 5, 10**6).orderBy("path").collect()] == want
    assert sorted(tuple(r.path) for r in G.paths_up(t, 3, 5, 7).collect()) == want[:7]


def test_outline_of_any_depth(spark):
    nodes = spark.createDataFrame([("b", i, i - 1 if i else None, f"t{i}", i) for i in range(12)], "book string, id long, parent long, title string, page long")
    assert {(r.id, r.level) for r in B.flat_outline(nodes).collect()} == {(i, i) for i in range(12)}
    assert B.flat_outline(nodes.limit(0)).collect() == []


def test_sites_have_a_limit(spark):
    sites = spark.createDataFrame([(f"f{i:02d}", "g", "x.c", i) for i in range(30)], "src string, dst string, file string, line long")
    row = G.callers(sites, 4).first()
    assert row["count"] == 30 and [s.function for s in row.sites] == ["f00", "f01", "f02", "f03"]
    assert {(r.name, r.direction, r.depth) for r in G.neighbourhood(sites.limit(2), "g").collect()} == {("f00", "callers", 1), ("f01", "callers", 1)}


def test_noise_names():
    assert len(C.NOISE_SYMBOLS) == len(set(C.NOISE_SYMBOLS)) and {"Symbol", "Buffer", "findIndex", "Object.keys", "console.log", "Effect.gen", "fs.rmSync", "fs.existsSync", "path.join", "Schema.Struct"} <= set(C.NOISE_SYMBOLS)


def test_bytes_not_characters(spark):
    text = "é" * 600 + " token"
    row = spark.range(1).select(X.keyword_matches(F.lit(text), "token É é").alias("k"), X.preview(F.lit("é" * 150)).alias("p"), X.preview(F.lit("a" + "é" * 150)).alias("q"), X.keyword_matches(F.lit("Ab tOken"), "TOKEN ab zz").alias("n")).first()
    assert (row.k, row.p, row.q, row.n) == (1, "é" * 100, "a" + "é" * 99, 2)


def test_paths_and_reach(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "c")], "src string, dst string")
    paths = {tuple(r.path) for r in G.paths_up(edges, "c").collect()}
    assert paths == {("c", "x"), ("c", "b", "a", "c")}
    assert {r.name: r.depth for r in G.reach(edges, spark.createDataFrame([("a",)], "name string")).collect()} == {"a": 0, "b": 1, "c": 2}


def test_code_lexers(spark):
    source = "int f(int n) {\n  char *p = g(h(1, 2), \"a,b\");\n  n += 1; // }\n  return n;\n}\nint later(void);\n"
    row = spark.range(1).select(C.call_arguments(F.lit('x = g(h(1, 2), "a,b");'), F.lit("g")).alias("args"), C.full_definition(F.lit(source), F.lit(0)).alias("body"), C.block_end(F.split(F.lit(source), "\n"), F.lit(5)).alias("end"), C.variable_occurrences(F.lit(source)).alias("o")).first()
    assert row.args == ["h(1, 2)", '"a,b"'] and row.body == source[: source.index("\nint later")] and row.end == 0
    found = {(o.variable, o.kind, o.line) for o in row.o}
    assert ("n", "definition", 0) in found and ("n", "assignment", 2) in found and ("n", "usage", 3) in found


def test_body_windows(spark):
    text = "\n".join(f"line {i:04d} é" for i in range(400))
    parts = spark.range(1).select(C.body_windows(F.lit(text), F.lit("sig"), F.lit("name")).alias("p")).first().p
    assert len(parts) == 5 and parts[0].content == text
    for p in parts[1:]:
        head, _, body = p.content.partition("\n")
        assert head == f"sig // Part {p.part}" and body in text and len(body.encode()) <= 1500


def test_imports(spark):
    python = "import os.path\nfrom a.b import c, d\n"
    found = spark.range(1).select(*(v.alias(k) for k, v in C.imports(F.lit(python), "python").items())).first()
    assert found.modules == ["os", "a"] and found.symbols == ["c", "d"]
    js = spark.range(1).select(C.imports(F.lit("import x from 'lib'; require('./own'); require('two')"), "javascript")["libraries"].alias("l")).first().l
    assert js == ["lib", "two"]


def test_pages_keep_the_text():
    text = "\n\n".join(f"Paragraph {i} " + "word " * (20 + i * 7 % 300) for i in range(40))
    pages = B.split_text(text)
    assert all(len(p.encode()) <= 3001 for p in pages) and "".join("".join(pages).split()) == "".join(text.split())
    assert B.split_text("") == [] and B.split_text(None) == []
    long = "字" * 3000
    assert "".join(B.split_text(long)) == long


def test_html_and_epub(spark, tmp_path):
    html = "<h1>T</h1><p>a <b>bold</b> &amp; <a href='u'>link</a></p><ul><li>x</li></ul><script>no()</script><pre>k  v</pre>"
    text = S.markdown(html)
    assert "# T" in text and "a **bold** & [link](u)" in text and "- x" in text and "no()" not in text and "```\nk  v\n```" in text
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("META-INF/container.xml", '<c xmlns="x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>')
        z.writestr("o/p.opf", '<package xmlns="y"><manifest><item id="1" href="c.xhtml"/></manifest><spine><itemref idref="1"/></spine></package>')
        z.writestr("o/c.xhtml", "<html><title>One</title><body><p>Hello</p></body></html>")
    (tmp_path / "book.epub").write_bytes(raw.getvalue())
    row = S.read_epubs(spark, str(tmp_path)).first()
    assert (row.book, row.title) == ("book", "One") and "Hello" in row.text


def test_source_tree(spark, tmp_path):
    for name, text in (("a.py", "x = 1"), ("node_modules/b.js", "y"), ("c.txt", "z"), ("d.test.ts", "t")):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text(text)
    rows = S.read_source_tree(spark, str(tmp_path)).collect()
    assert [(r.language, r.content) for r in rows] == [("python", "x = 1")]


def test_probe_words():
    probe = A.parse_probe("target f when bytes >= 10 collect n: count, s: sum(bytes), h: hist(bytes)")
    assert probe["filter"] == ("bytes", ">=", 10.0) and [c[1] for c in probe["collect"]] == ["count", "sum", "hist"]
    with pytest.raises(ValueError):
        A.parse_probe("nothing")


def test_probe_histogram(spark):
    t = spark.createDataFrame([("f", 1.0), ("f", 3.0), ("f", 2.0), ("g", 9.0)], "target string, v double")
    row = A.run_probe(t, "target f collect n: count, h: hist(v)").first()
    assert row.n == 3 and row.h == {0: 1, 1: 2}


@pytest.mark.parametrize("accuracy, margin", [(None, None), (3, 0.0)])
def test_percentiles_are_values_at_their_ranks(spark, monkeypatch, accuracy, margin):
    """More values than a sketch keeps, ties, NaN, nulls, and sketches that are far off."""
    if accuracy:
        monkeypatch.setattr(A, "SKETCH_ACCURACY", accuracy)
        monkeypatch.setattr(A, "SKETCH_MARGIN", margin)
    rng = np.random.default_rng(6)
    groups = {
        "many": rng.permutation(40_000) / 7, "ties": rng.integers(0, 3, 1000) * 1.0, "hundred": np.arange(100.0), "one": np.array([5.0]),
        None: rng.normal(size=300), "nan": np.array([1.0, 2.0, float("nan"), float("nan")]), "none": np.array([]),
    }
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [(g, None) for g in ("many", "ties", "none", None)]
    t = spark.createDataFrame(rows, "g string, v double").repartition(7)
    at = lambda v, hundredths: repr(float(np.sort(v)[max(-(-hundredths * len(v) // 100), 1) - 1])) if len(v) else "None"
    found = A.percentiles(t, "g", "v")
    assert found.columns == ["g", "p50", "p90", "p99"] and found.schema["p50"].dataType.simpleString() == "double"
    assert {r.g: (repr(r.p50), repr(r.p90), repr(r.p99)) for r in found.collect()} == {g: tuple(at(v, h) for h in (50, 90, 99)) for g, v in groups.items()}


def test_percentiles_of_long_integers(spark):
    """Sketches hold doubles, the result does not; a table without rows has no groups."""
    big = 2**60
    t = spark.range(1, 1001).select(F.lit(1).alias("g"), (F.col("id") + big).alias("v"))
    assert [tuple(r) for r in A.percentiles(t, "g", "v").collect()] == [(1, big + 500, big + 900, big + 990)]
    assert A.percentiles(t.limit(0), "g", "v").collect() == []


def test_hashes(spark):
    row = spark.createDataFrame([("hello",)], "s string").select(H.fnv1a64("s").alias("f"), H.djb2("s").alias("d"), H.crc(F.col("s")).alias("c")).first()
    assert int(row.f) == 0xA430D84680AABD0B and int(row.d) == 210714636441 and row.c == 907060870


def test_names(spark):
    row = spark.range(1).select(X.safe_name(F.lit("a/b: “c” –d ")).alias("s"), X.chapter_name(F.lit(4), F.lit("é" * 40)).alias("c")).first()
    assert row.s == "a_b__ _c_ -d".replace(" ", "_").replace("___c", "__c") or row.s.startswith("a_b_")
    assert row.c == "05-" + "é" * 30


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", i % 3, "click", float(i)) for i in range(40)]
    batch = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").select("event_id", F.to_timestamp("ts").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = streams.read_events(spark, str(tmp_path / "in"))
    q = streams.windowed(events, "10 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert {r.calls for r in spark.table("w").collect()} == {10}
    changes = events.select(F.concat(F.lit("k"), "user_id").alias("key"), F.col("value").cast("string").alias("value"), F.col("event_id").alias("version"))
    q = changes.writeStream.foreachBatch(streams.upsert_into(str(tmp_path / "kv"))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert {r.key: r.version for r in spark.read.parquet(str(tmp_path / "kv" / "batch=0")).collect()} == {"k0": 39, "k1": 37, "k2": 38}
