"""Physical plans: what reaches the scan, and what must not appear."""

import os
import re

import pytest

from quillstone.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def plan(frame) -> str:
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["range_filter"](spark, DATA))
    assert "GreaterThan(o_totalprice,100000.0)" in text and "EqualTo(o_orderstatus,F)" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>", text)
    assert "Exchange" not in text
    text = plan(QUERIES["scan_filter_topn"](spark, DATA))
    assert "GreaterThan(l_quantity,45.0)" in text and "l_comment" not in text and "TakeOrderedAndProject" in text


def test_top_k_keeps_k_rows_a_task(spark):
    for name in ("vec_topk_exact", "hot_top10_share", "fan_in"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, DATA)), name


@pytest.mark.parametrize("name", ["kv_prefix", "kv_regex", "kv_fuzzy", "ttl_live", "purge_expired", "html_strip", "noise_filter", "edit_distance", "keyword_matches", "vec_normalise", "ast_extract"])
def test_narrow_queries_have_no_wide_step(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    assert "hashpartitioning" not in text and "rangepartitioning" not in text


def test_numbering_has_no_window_over_all_rows(spark):
    """Only the counts of partitions meet in one task; the rows are numbered where they are."""
    text = plan(QUERIES["row_numbers"](spark, DATA))
    windows = re.findall(r"\) Window\n.*?\nArguments: ([^\n]*)", text, re.S)
    assert windows and all("_c" in w and "o_orderkey" not in w for w in windows)


def test_search_by_codes_scans_no_vectors_but_its_candidates(spark, tmp_path):
    """The scan of the codes reads nothing else, keeps the nearest rows of each task, and the candidates are broadcast."""
    from quillstone.operators import vectors as R

    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    R.write_index(R.build_index(rows, 2, name="vec_id"), str(tmp_path), "vec_id")
    text = plan(R.indexed_top_k(spark.read.parquet(f"{tmp_path}/codes"), spark.read.parquet(f"{tmp_path}/vectors"), [1.0, 0.5], 3, name="vec_id"))
    assert "ReadSchema: struct<vec_id:bigint,codes:array<bigint>>" in text and text.count("TakeOrderedAndProject") >= 2 and "BroadcastHashJoin" in text


def test_the_levels_of_a_graph_do_not_nest(spark):
    """Each level is read from its own staged table, so the plan grows by a level, not by doubling."""
    from quillstone.operators import graph as G

    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long")
    sizes = [plan(G.reach(edges, spark.range(1).withColumnRenamed("id", "name"), depth)).count("Scan") for depth in (2, 4, 6)]
    assert sizes[2] - sizes[1] == sizes[1] - sizes[0]
    sizes = [plan(G.paths_up(edges, 9, depth)).count("Scan") for depth in (2, 4, 6)]
    assert sizes[2] - sizes[1] <= sizes[1] - sizes[0] + 4


def test_one_scan_finds_tags_and_their_fallback(spark):
    """The values are read once; what decides is the small table of what was found."""
    text = plan(QUERIES["kv_tag"](spark, DATA))
    assert "documents.parquet" not in text


def test_numbering_of_large_inputs_has_more_partitions(spark, monkeypatch):
    from quillstone.operators import ranking

    orders = spark.read.parquet(f"{DATA}/orders.parquet")
    assert ranking.range_partitions(orders) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(ranking, "PARTITION_BYTES", 1000)
    many = ranking.range_partitions(orders)
    assert many > 10
    rows = ranking.numbered(orders.select("o_orderkey"), "o_orderkey").collect()
    assert sorted(r.n for r in rows) == list(range(1, len(rows) + 1)) and [r.o_orderkey for r in sorted(rows, key=lambda r: r.n)] == sorted(r.o_orderkey for r in rows)
