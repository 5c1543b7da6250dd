"""The pipeline's stages on a small corpus."""

import corpus_pipeline
import pytest

from tests.llm.fixtures import WORD
from tests.llm.test_near_duplicates import brute
from tests.llm.test_scans import encoding_of, leaks, slow_spans

pytest.importorskip("public_tokenizers")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    good = [" ".join(f"good{(i * 7 + j * j) % 90}" for j in range(30 + i % 20)) for i in range(120)]
    bad = [" ".join(f"%%{(i + j) % 30}$" for j in range(40)) for i in range(60)]
    leak = " ".join(f"item{j}" for j in range(25))
    texts = [*good, *bad, good[3], good[3] + " good1", f"{good[5]} {leak} {good[6]}", f"{good[7]} token = \"0123456789abcdef0123456789abcdef\" {good[8]}", None, ""]
    rows = [(i, t, "en", "s", len(t) if t else 0) for i, t in enumerate(texts)] + [(None, good[9] + " more words here", "en", "s", 1), (0, good[0], "en", "s", 2)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def test_stages(spark, folder, tmp_path):
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), [f.split()[0] for f in COLUMNS.split(", ")]
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if number < 4:
            assert docs.columns == columns
        if name == "quality":
            kept = {r.doc_id for r in docs.collect()}
            assert set(range(120)) <= kept and not kept & set(range(120, 180))
        if name == "near_duplicates":
            kept = [r.doc_id for r in docs.collect()]
            assert 3 in kept and 180 not in kept and kept.count(0) == 1 and None not in kept
        if name == "decontamination":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == {182}
        if name == "secrets":
            rows = {r.doc_id: r for r in docs.collect()}
            assert "[SECRET]" in rows[183].text and "0123456789abcdef" not in rows[183].text and rows[183].n_chars == len(rows[183].text)
            texts = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.decoded for r in docs.collect()} == {i: t or "" for i, t in texts.items()}
    assert all(len(r.ids) == r.n_tokens for r in docs.collect())
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((str(r.doc_id), r.ids) for r in whole.collect()) == sorted((str(r.doc_id), r.ids) for r in docs.collect())
    assert WORD is not None


def test_leaks_go_by_row(spark, tmp_path, monkeypatch):
    leak, clean = " ".join(f"item{j}" for j in range(25)), " ".join(f"good{j}" for j in range(25))
    rows = [(i, t, "en", "s", 1) for i, t in [(None, f"head {leak} tail"), (None, clean), (1, f"head {leak}"), (1, clean), (2, None), (None, None)]]
    spark.createDataFrame([(1, leak), (2, "other words of an item that is nowhere")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for size in (8 << 20, 40):
        monkeypatch.setattr(corpus_pipeline.decontaminate, "ITEM_BYTES", size)
        kept = corpus_pipeline.drop_leaks(spark, spark.createDataFrame(rows, COLUMNS), str(tmp_path)).collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(i), str(t)) for i, t in [(None, clean), (1, clean), (2, None), (None, None)])


def test_near_duplicates_by_row(spark, tmp_path):
    """Rows that share a doc_id are documents of their own."""
    one, two, three = (" ".join(f"{c}{j}" for j in range(25)) for c in "abc")
    rows = [(5, one), (5, two), (3, one), (7, two), (9, three), (9, three), (9, ""), (9, ""), (9, None), (None, one)]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS), str(tmp_path)).collect()
    expected = [(3, one), (5, two), (9, three), (9, ""), (9, None)]  # (None, one) is a copy of (3, one)
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(i), str(t)) for i, t in expected)


def test_clashing_columns_and_ties(spark, tmp_path):
    """Further columns keep names, order and values; of rows with equal doc_id and text one stays, the same at every run."""
    extra = "_n int, score string, doc_id long, text string, _row int, _p int, _words boolean, kept int, lang string, source string, n_chars long"
    good = [" ".join(f"good{(i * 7 + j * j) % 90}" for j in range(40)) for i in range(80)]
    bad = [" ".join(f"%%{(i + j) % 30}$" for j in range(40)) for i in range(80)]
    leak = " ".join(f"item{j}" for j in range(25))
    rows = [(7, f"s{i}", i, t, 8, 9, True, 4, "en", "x", len(t)) for i, t in enumerate(good + bad)]
    rows += [(b, "tie", 0, good[0], 8, 9, True, 4, "en", "x", 1) for b in (3, 2)] + [(b, "tie", 500, "", 8, 9, None, 4, None, None, None) for b in (5, 4)]
    rows += [(1, None, None, f"{good[1]} {leak} x", 8, 9, True, 4, "en", "x", 1), (1, "no id", None, good[2] + " y", 8, 9, True, 4, "en", "x", 1)]
    docs = spark.createDataFrame(rows, extra)
    spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "near_duplicates":
            found = {(r.doc_id, r._n) for r in docs.collect() if r.score in ("tie", "no id", "s0")}
            assert len({f for f in found if f[0] == 0}) == 1 and len({f for f in found if f[0] == 500}) <= 1 and (None, 1) not in found
            assert found == {(r.doc_id, r._n) for r in out.collect() if r.score in ("tie", "no id", "s0")}
    found = docs.collect()
    assert all(r._row == 8 and r._p == 9 and r.kept == 4 for r in found) and not any(r.doc_id is None for r in found)
    assert {r.doc_id for r in found} - {500} == set(range(80))


def test_all_stages_equal_brute_force(spark, folder):
    """From the rows that quality keeps, the other stages are said anew in plain Python."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in corpus_pipeline.keep_quality(spark, docs, folder).collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    classes, _ = brute(list(enumerate(t for _, t in rows)), 80, 100)
    seen, kept = set(), []
    for i, row in enumerate(rows):
        wordless = not WORD.search(row[1] or "")
        if classes[i] == i and not (wordless and row in seen):
            kept.append(row)
        seen.add(row)
    item = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [r for r in kept if not leaks([(0, r[1])], item)]
    final = []
    for i, text in kept:
        out, last = "", 0
        for _, a, b in slow_spans(text or ""):
            if b > last:
                out += ((text[last:a] + "[SECRET]") if a >= last else "")
                last = b
        final.append((str(i), encoding_of().encode_ordinary(out + (text or "")[last:])))
    assert sorted((str(r.doc_id), r.ids) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(final)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
