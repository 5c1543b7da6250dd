"""Counts and statistics: terms, probes, histograms, repositories, tasks, metrics."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators.ranking import top
from quillstone.sources.staging import staged

#: Fixed value: term counts below this are left out.
MIN_COUNT = 3
#: Accuracy of a percentile's sketch, and how far from its rank the cuts lie, as a share of the values.
SKETCH_ACCURACY, SKETCH_MARGIN = 10_000, 0.001
#: Comparison operators of a probe's filter.
COMPARE = {"==": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v}


def word_frequencies(texts: DataFrame, column: str = "text", mode: str = "term", least: int = MIN_COUNT) -> DataFrame:
    """word, df, idf = ln(texts / (df + 1)) + 1; df counts every occurrence, or texts in mode "document"."""
    if mode == "document":
        words = texts.select(F.explode(F.array_distinct(X.word_tokens(F.col(column)))).alias("word"))
    else:  # the same words, tested and cut after they are rows, where the code is compiled
        words = texts.select(F.explode(F.split(X.ascii_lower(F.col(column)), "[^a-z0-9_]+")).alias("word")).where(F.length("word") >= 2).select(F.substring("word", 1, 63).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    total = texts.agg(F.count("*").alias("_n"))
    return counts.crossJoin(F.broadcast(total)).select("word", "df", (F.log(F.col("_n") / (F.col("df") + 1)) + 1).alias("idf"))


def status_histogram(frame: DataFrame, status: Column) -> DataFrame:
    return frame.groupBy(status.alias("status")).agg(F.count("*").alias("rows"))


def histogram(frame: DataFrame, group: str, value: str) -> DataFrame:
    """group, bucket, count: powers of two; bucket b holds values from 2^b below 2^(b + 1)."""
    return frame.where(F.col(value) > 0).groupBy(group, F.floor(F.log2(value)).cast("int").alias("bucket")).agg(F.count("*").alias("count"))


def percentiles(frame: DataFrame, group: str, value: str, ranks: tuple[float, ...] = (0.5, 0.9, 0.99), exact: bool = False) -> DataFrame:
    """group, p50, p90, p99: of a group's n values in order the one at ceil(rank * n), nulls apart.

    Partial sketches place two cuts around every rank, a scan counts the values between cuts, and a last one counts the
    distinct values between the two cuts where a rank lies, usually those of SKETCH_MARGIN on both sides.  A sketch's error
    only moves the cuts, not the result.  With `exact` a group's distinct values are brought together at once, for small groups."""
    names = [f"p{round(100 * r)}" for r in ranks]
    if exact:
        return frame.groupBy(group).agg(*(F.expr(f"percentile_disc({r}) within group (order by {value})").alias(n) for r, n in zip(ranks, names, strict=True)))
    rows = frame.select(F.col(group).alias("_g"), F.col(value).alias("_v"))
    marks = sorted({min(max(r + e, 0.0), 1.0) for r in ranks for e in (-SKETCH_MARGIN, SKETCH_MARGIN)})
    cuts = staged(rows.groupBy("_g").agg(F.percentile_approx("_v", marks, SKETCH_ACCURACY).alias("_cuts")), "cuts")
    same = lambda left, right, *more: [left["_g"].eqNullSafe(right["_g"]), *(left[c] == right[c] for c in more)]
    rows = rows.where("_v is not null")
    between = sum(((F.col("_cuts")[i] < F.col("_v")).cast("int") for i in range(len(marks))), F.lit(0))
    placed = rows.join(cuts, same(rows, cuts)).select(rows["_g"], "_v", between.alias("_b"))

    own = Window.partitionBy("_g")
    counts = placed.groupBy("_g", "_b").agg(F.count("*").alias("_n")).select("_g", "_b", (F.sum("_n").over(own.orderBy("_b")) - F.col("_n")).alias("_below"), "_n", F.sum("_n").over(own).alias("_all"))
    places = F.array(*(F.struct(F.lit(i).alias("i"), F.ceil(F.col("_all") * F.lit(Decimal(str(r)))).cast("long").alias("at")) for i, r in enumerate(ranks)))
    places = counts.select("_g", "_b", "_below", "_n", F.explode(places).alias("_r")).select("_g", "_b", F.col("_r.i").alias("_i"), (F.greatest("_r.at", F.lit(1)) - F.col("_below")).alias("_at"), "_n")
    places = staged(places.where("_at between 1 and _n").drop("_n"), "places")

    distinct = placed.join(places, same(placed, places, "_b"), "left_semi").groupBy("_g", "_b", "_v").agg(F.count("*").alias("_n"))
    upto = distinct.withColumn("_to", F.sum("_n").over(Window.partitionBy("_g", "_b").orderBy("_v")))
    hits = upto.join(places, [*same(upto, places, "_b"), places["_at"] > upto["_to"] - upto["_n"], places["_at"] <= upto["_to"]])
    best = hits.groupBy(upto["_g"]).agg(*(F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)))
    return cuts.join(best, same(cuts, best), "left").select(cuts["_g"].alias(group), *names)


def caller_map(frame: DataFrame, group: str, caller: str, most: int = 10) -> DataFrame:
    """group, callers: map of the most frequent callers to their counts."""
    counts = frame.groupBy(group, caller).agg(F.count("*").alias("_c"))
    best = counts.groupBy(group).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("_c")).alias("n"), F.col(caller).alias("k")))), 1, most).alias("_b"))
    return best.select(group, F.map_from_entries(F.transform("_b", lambda x: F.struct(x["k"], -x["n"]))).alias("callers"))


def off_cpu_stacks(samples: DataFrame) -> DataFrame:
    """stack, state, samples: counts by stack and reason."""
    return samples.groupBy("stack", "state").agg(F.count("*").alias("samples"))


def off_cpu(samples: DataFrame) -> DataFrame:
    """state, samples, stacks: counts by reason and the number of stacks of each."""
    return off_cpu_stacks(samples).groupBy("state").agg(F.sum("samples").alias("samples"), F.count("*").alias("stacks"))


def hot_functions(samples: DataFrame, name: str = "function", n: int = 10) -> DataFrame:
    """name, samples, share: the n most sampled functions, and their share of the first one's count."""
    best = top(samples.groupBy(name).agg(F.count("*").alias("samples")), n, "samples", name)
    first = best.agg(F.max("samples").alias("_m"))
    return best.crossJoin(F.broadcast(first)).select(name, "samples", (F.col("samples") / F.col("_m")).alias("share"))


def parse_probe(spec: str) -> dict:
    """A probe in words: target NAME [when FIELD OP NUMBER] collect A: F(X), ...

    Aggregates: count, sum, avg, min, max, hist, p50, p90, p99."""
    m = re.fullmatch(r"\s*target\s+(\S+)(?:\s+when\s+(\w+)\s*(==|!=|>=|<=|>|<)\s*(-?[\d.]+))?\s+collect\s+(.+?)\s*", spec, re.S)
    if not m:
        raise ValueError(f"not a probe: {spec}")
    collect = []
    for part in m[5].split(","):
        a = re.fullmatch(r"\s*(\w+)\s*:\s*(count|sum|avg|min|max|hist|p50|p90|p99)\s*(?:\(\s*(\w*)\s*\))?\s*", part)
        if not a:
            raise ValueError(f"not an aggregate: {part}")
        collect.append((a[1], a[2], a[3] or None))
    return {"target": m[1], "filter": (m[2], m[3], float(m[4])) if m[2] else None, "collect": collect}


def run_probe(samples: DataFrame, spec: str, target: str = "target") -> DataFrame:
    """One row of the probe's aggregates over its target's samples (* for all, one row each); a hist is a
    map from the power of two to the count."""
    probe = parse_probe(spec)
    rows = samples if probe["target"] == "*" else samples.where(F.col(target) == probe["target"])
    if probe["filter"]:
        field, op, value = probe["filter"]
        rows = rows.where(COMPARE[op](F.col(field), value))
    made = []
    for name, kind, field in probe["collect"]:
        if kind == "count":
            made.append(F.count("*").alias(name))
        elif kind == "hist":
            continue
        elif kind[0] == "p":
            made.append(F.percentile_approx(field, F.lit(int(kind[1:]) / 100), F.lit(10_000)).alias(name))
        else:
            made.append(getattr(F, kind)(field).alias(name))
    out = rows.groupBy(target).agg(*(made or [F.count("*").alias("_all")]))
    for name, kind, field in probe["collect"]:
        if kind == "hist":  # counted per bucket first, so a group is at most a few dozen rows
            bars = histogram(rows, target, field).groupBy(target).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bucket", "count")))).alias(name))
            out = out.join(bars, target, "left")
    return out.drop("_all")


def languages(files: DataFrame) -> DataFrame:
    """language, files, bytes of a repository's files (path, bytes)."""
    return files.groupBy(X.language_of(F.col("path")).alias("language")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def project_counts(hits: DataFrame, n: int) -> DataFrame:
    """project, hits among the best n."""
    return top(hits, n, "score", "project", "name").groupBy("project").agg(F.count("*").alias("hits"))


def metrics(samples: DataFrame) -> DataFrame:
    """name, labels, total, samples: counters and timers by name and labels."""
    return samples.groupBy("name", "labels").agg(F.sum("value").alias("total"), F.count("*").alias("samples"))


def metrics_text(totals: DataFrame) -> DataFrame:
    """line: totals in the usual text exposition format."""
    labels = F.when(F.col("labels") == "", "").otherwise(F.concat(F.lit("{"), F.col("labels"), F.lit("}")))
    return totals.select(F.concat("name", labels, F.lit(" "), F.col("total").cast("string")).alias("line"))


def gathered(results: DataFrame, nodes: int, deadline: int, now: int) -> DataFrame:
    """task_id, received, status: ok with an answer of every node, partial after the deadline, else pending."""
    counts = results.groupBy("task_id").agg(F.count_distinct("node").alias("received"), F.min("sent_at").alias("_t"))
    status = F.when(F.col("received") >= nodes, "ok").when(F.col("_t") + deadline < now, "partial").otherwise("pending")
    return counts.select("task_id", "received", status.alias("status"))
