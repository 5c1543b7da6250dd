"""Sources and sinks: vectors, pages, chunks, tags, repositories, plugins, exports; symbols of imports."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import vectors as V
from quillstone.operators import code as C
from quillstone.operators import vectors as R
from quillstone.sources import files as S
from quillstone.sources.snapshots import current, export, read_snapshot, verify
from quillstone.sources.staging import shared_root, staged


def test_vectors_are_stored_at_length_one(spark, tmp_path):
    rows = spark.createDataFrame([("a", [3.0, 4.0]), ("z", [0.0, 0.0])], "name string, embedding array<double>")
    S.write_vectors(rows, str(tmp_path / "v"))
    found = {r.name: r.embedding for r in S.read_vectors(spark, str(tmp_path / "v")).collect()}
    assert found["a"] == pytest.approx([0.6, 0.8]) and found["z"] == [0.0, 0.0]


def test_pages_json_and_export(spark, tmp_path):
    pages = spark.createDataFrame([("b", "01-x", 1, "text one"), ("b", "01-x", 2, "text two")], "book string, chapter string, page int, text string")
    S.write_pages(pages, str(tmp_path / "p"))
    back = spark.read.text(str(tmp_path / "p"))
    assert sorted((r.page, r.value) for r in back.collect()) == [(1, "text one"), (2, "text two")]
    S.write_json(pages, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    odd = spark.createDataFrame([('a"b\\\n\t', None)], "s string, n int")
    assert json.loads(S.json_rows(odd).first().json) == {"s": 'a"b\\\n\t', "n": None}
    export(pages, str(tmp_path / "e"))
    assert verify(spark, str(tmp_path / "e"), pages)


def test_chunks_and_tags(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(json.dumps({"name": "f", "file": "a.c", "kind": "function", "line_start": 1, "line_end": 2, "content": "x"}) + "\n")
    assert S.read_chunks(spark, str(tmp_path / "c.jsonl")).first().line_end == 2
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(x) for x in ({"_type": "tag", "name": "f", "path": "a.c", "kind": "method", "line": 3}, {"_type": "ptag", "name": "p"})))
    tags = S.read_tags(spark, str(tmp_path / "t.jsonl"))
    assert [(r.name, r.category) for r in tags.collect()] == [("f", "function")]
    files = spark.createDataFrame([("a.c", "int f;"), ("b.py", "x")], "path string, content string")
    rows = {r.key: r.value for r in S.repository_rows("o", "n", files, tags).collect()}
    assert rows["/github/o/n/src/a.c"] == "int f;" and json.loads(rows["/github/o/n/symbols/f"])[0]["line"] == 3 and json.loads(rows["/github/o/n/_meta"]) == {"c": 1, "python": 1}


def test_the_plugin_of_highest_priority_runs(spark):
    files = spark.createDataFrame([("a.ts", "x y"), ("b.c", "z")], "path string, content string")
    low = (1, ("ts", "js"), lambda path, content: [{"path": path, "n": -1}])
    high = (5, ("ts",), lambda path, content: [{"path": path, "n": len(content.split())}])
    assert [(r.path, r.n) for r in S.indexed_by_plugin(files, [high, low], "path string, n long").collect()] == [("a.ts", 2)]


def test_stand_in_embedding(spark):
    row = spark.createDataFrame([("some words here",), ("",), (None,)], "t string").select("t", R.hashing_embedding("t").alias("e"))
    found = {r.t: r.e for r in row.collect()}
    assert sum(x * x for x in found["some words here"]) == pytest.approx(1) and set(found[""]) == {0.0} and set(found[None]) == {0.0}
    assert row.where("t <> ''").select(V.cosine(F.col("e"), F.col("e")).alias("c")).first().c == pytest.approx(1)


def test_symbols_of_imports(spark):
    kv = spark.createDataFrame([("/code/a/hnswlib/symbols/addPoint", "record"), ("/code/me/own/symbols/addPoint", "mine")], "key string, value string")
    repos = spark.createDataFrame([("/code/a/hnswlib",), ("/code/me/own",)], "repo string")
    terms, symbols = spark.createDataFrame([("hnswlib/hnswalg.h",), ("own",)], "term string"), spark.createDataFrame([("addPoint",), ("gone",)], "symbol string")
    assert [r.value for r in C.imported_symbols(terms, symbols, repos, kv, "/code/me/own").collect()] == ["record"]


def test_staging_and_missing_snapshots(spark, tmp_path):
    assert staged(spark.range(3)).count() == 3 and shared_root(spark)
    assert current(spark, f"file://{tmp_path}/none") is None
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, f"file://{tmp_path}/none")
