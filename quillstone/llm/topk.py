"""Exact top-k inner products by block-at-a-time pruning.

Vectors are put into an order in which like ones stand together, and cut into
shards and blocks of consecutive places.  A block keeps the largest and smallest
value of every dimension, so for a query the sum of the larger products bounds
all its scores.  A query first meets one shard, whose k-th best score is its
threshold.  Block bounds, a sixty-fourth of the vectors, then tell which other
shards may hold better ones; only these are searched, block by block in the order
of the bounds, until the next bound is below the k-th best score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.storage import cut
from quillstone.operators.ranking import numbered

#: Vectors of a shard, of a block, queries that meet a shard in one task, and queries compared at a time.
SHARD, BLOCK, QUERY_BLOCK, QUERIES = 8192, 128, 16384, 1024
#: A small table still has so many shards, if each gets so many vectors, so that tasks are many and even.
FEW_SHARDS, SMALL_SHARD = 64, 512
#: Shards whose block bounds one task compares with a block of queries, and leading dimensions whose signs order vectors.
BOUNDED, SIGNS = 64, 16
#: Sums of products beyond this are not exact in float64; such shards are scored in int64.
_EXACT = 1 << 53


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """float64 where products of the two are exact in it, else int64."""
    return np.float64 if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < _EXACT else np.int64


def extrema(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest and the smallest value of every dimension in each block."""
    cuts = np.arange(0, len(vectors), BLOCK)
    return np.maximum.reduceat(vectors, cuts), np.minimum.reduceat(vectors, cuts)


def bounds(queries: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    """(n_queries, n_blocks): no score of the block is larger."""
    return (np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ bottom.T).astype(np.int64)


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None, scored: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores (n_queries, k) of the best of one shard; absent ones have id -1.  Scores below a query's `least`
    may be left out; `scored` takes the number of pairs that were scored."""
    kind = _kind(vectors, queries)
    vectors, queries = vectors.astype(kind), queries.astype(kind)
    low = np.iinfo(np.int64).min
    best, best_ids = np.full((len(queries), k), low, np.int64), np.full((len(queries), k), -1, np.int64)
    bound = bounds(queries, *extrema(vectors))
    least = np.full(len(queries), low) if least is None else least
    order = np.argsort(-bound, axis=1, kind="stable")
    alive = np.arange(len(queries))
    for turn in range(bound.shape[1]):
        at = order[alive, turn]
        going = bound[alive, at] >= np.maximum(best[alive, -1], least[alive])  # an equal bound may hold a tie of a smaller id
        alive, at = alive[going], at[going]
        if not len(alive):
            break
        by = np.argsort(at, kind="stable")
        for rows in np.split(alive[by], np.flatnonzero(np.diff(at[by])) + 1):
            first = int(order[rows[0], turn]) * BLOCK
            own = ids[first : first + BLOCK]
            scores = (queries[rows] @ vectors[first : first + BLOCK].T).astype(np.int64)
            if scored is not None:
                scored.append(scores.size)
            known = np.broadcast_to(own, scores.shape).copy()
            same = own[None, :] == query_ids[rows, None]
            scores[same], known[same] = low, -1
            scores, known = np.hstack([best[rows], scores]), np.hstack([best_ids[rows], known])
            pick = np.lexsort((np.where(known < 0, np.iinfo(np.int64).max, known), -np.maximum(scores, low + 1)))[:, :k]
            best[rows], best_ids[rows] = np.take_along_axis(scores, pick, 1), np.take_along_axis(known, pick, 1)
    return best_ids, best


_FOUND = "query_id long, vec_id long, score long"
_LOW = np.iinfo(np.int64).min


def _results(parts: list) -> pa.Table:
    columns = [np.concatenate(x) if parts else np.zeros(0, np.int64) for x in (zip(*parts, strict=True) if parts else [[]] * 3)]
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(("query_id", "vec_id", "score"), columns, strict=True)})


def _shard(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(table["place"].to_numpy(), kind="stable")
    return table["vec_id"].to_numpy()[order], _matrix(table["v"])[order]


def _in_shard(table: pa.Table, query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> pa.Table:
    ids, vectors = _shard(table)
    out = []
    for start in range(0, len(query_ids), QUERIES):
        part = slice(start, start + QUERIES)
        found, scores = search_shard(ids, vectors, query_ids[part], queries[part], k, least[part])
        there = found >= 0
        out.append((np.broadcast_to(query_ids[part][:, None], found.shape)[there], found[there], scores[there]))
    return _results(out)


def _first(k: int):
    """The best of the one shard that a query meets first."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _results([])
        return _in_shard(left, right["query_id"].to_numpy(), _matrix(right["v"]), np.full(right.num_rows, _LOW), k)

    return run


def _bounded(table: pa.Table) -> pa.Table:
    """A shard's block extrema in one row."""
    top, bottom = extrema(_shard(table)[1])
    return pa.table({"d": table["d"][:1], "shard": table["shard"][:1], "top": pa.array([top.tobytes()], pa.binary()), "bottom": pa.array([bottom.tobytes()], pa.binary())})


_SURVIVORS = "d int, shard int, block int, ids binary, least binary, v binary"


def _surviving(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each shard the queries of the block that it may have a better vector for; not those that have met it."""
    out = {c: [] for c in ("shard", "ids", "least", "v")}
    if left.num_rows and right.num_rows:
        d = left["d"][0].as_py()
        ids, home, least, queries = right["query_id"].to_numpy(), right["home"].to_numpy(), right["least"].to_numpy(), _matrix(right["v"])
        for shard, top, bottom in zip(left["shard"].to_pylist(), left["top"], left["bottom"], strict=True):
            top, bottom = (np.frombuffer(x.as_buffer(), np.int64).reshape(-1, d) for x in (top, bottom))
            kind = np.float64 if _kind(top, queries) is _kind(bottom, queries) is np.float64 else np.int64
            best = np.concatenate([bounds(queries[i : i + QUERIES].astype(kind), top.astype(kind), bottom.astype(kind)).max(axis=1) for i in range(0, len(queries), QUERIES)])
            good = np.flatnonzero((best >= least) & (home != shard))
            if len(good):
                out["shard"].append(shard)
                for name, values in (("ids", ids), ("least", least), ("v", queries)):
                    out[name].append(np.ascontiguousarray(values[good]).tobytes())
    n = len(out["shard"])
    d, block = (left["d"][0].as_py(), right["block"][0].as_py()) if n else (0, 0)
    return pa.table({"d": pa.array([d] * n, pa.int32()), "shard": pa.array(out["shard"], pa.int32()), "block": pa.array([block] * n, pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("ids", "least", "v")}})


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _results([])
        get = lambda c: np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in right[c]])
        return _in_shard(left, get("ids"), get("v").reshape(-1, right["d"][0].as_py()), get("least"), k)

    return run


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of every component; rows with a null id, a null vector
    or a null or non-finite component are left out, and so are vectors of d components with one beyond
    the square root of 2**62 / d after scaling, as their inner products need not fit into a long."""
    x = F.col("embedding").cast("array<double>")
    most = F.sqrt(F.lit(float(1 << 62)) / F.size(x))
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) * scale < most))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(y * scale).cast("long")).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` (query_id, v array<long>) the k rows of
    `vectors` (vec_id, v) with the largest inner product, ties to the smaller vec_id, never the query's own id.

    Vectors are compared with queries of the same length only; inner products must
    fit into a long, as they do for vectors of quantised().  A query with fewer
    candidates gets all of them; empty tables give no rows.  Of repeated ids each
    distinct vector counts, the largest score once: an id appears once in a query's
    result.  A query is sent to one shard first and then only to shards that a block
    bound lets pass; where none can be left out, every block of queries meets every
    shard, a pair to a task.
    """
    sized = vectors.withColumn("d", F.size("v")).where("d > 0").dropDuplicates(["vec_id", "v"])
    code = F.aggregate(F.slice("v", 1, SIGNS), F.lit(0), lambda s, x: s * 2 + (x > 0).cast("int"))
    placed = numbered(sized.withColumn("code", code), "d", "code", "vec_id", "v", name="place")
    rows = placed.count()
    if not rows:
        return queries.select("query_id").limit(0).select("query_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("score"))
    shards = max(-(-rows // shard), min(FEW_SHARDS, -(-rows // SMALL_SHARD)))
    placed = placed.withColumn("shard", F.floor((F.col("place") - 1) * shards / rows).cast("int"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("d", F.size("v")).dropDuplicates(["query_id", "v"])
    # A query's first shard is one that holds vectors of its own signs, if any does; a code is one of 2**SIGNS numbers.
    codes = placed.groupBy("d", "code").agg(F.min("shard").alias("low"), F.max("shard").alias("high"))
    asked = asked.withColumn("code", code).join(codes, ["d", "code"], "left")
    spread = lambda n: F.pmod(F.xxhash64("query_id"), n)
    asked = asked.withColumn("home", F.coalesce(F.col("low") + spread(F.col("high") - F.col("low") + 1), spread(F.lit(shards))).cast("int"))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")).select("query_id", "v", "d", "home", "block")
    asked = cut(asked, "asked")

    # However many queries one shard is the first of, a task has a block of them.
    meeting = asked.select("d", F.col("home").alias("shard"), F.col("block").alias("block")).distinct()
    first = placed.join(meeting, ["d", "shard"]).groupBy("d", "shard", "block").cogroup(asked.groupBy("d", "home", "block")).applyInArrow(_first(k), _FOUND)
    first = cut(first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "first")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    least = first.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    asked = asked.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(_LOW)))

    outline = placed.groupBy("d", "shard").applyInArrow(_bounded, "d int, shard int, top binary, bottom binary").withColumn("part", F.floor(F.col("shard") / BOUNDED).cast("int"))
    meets = asked.withColumn("part", every(-(-shards // BOUNDED))).groupBy("d", "part", "block")
    survivors = cut(outline.withColumn("block", every(blocks)).groupBy("d", "part", "block").cogroup(meets).applyInArrow(_surviving, _SURVIVORS), "survivors")
    dealt = placed.join(survivors.select(*(F.col(c).alias(c) for c in ("d", "shard", "block"))), ["d", "shard"])
    more = dealt.groupBy("d", "shard", "block").cogroup(survivors.groupBy("d", "shard", "block")).applyInArrow(_search(k), _FOUND)

    found = first.unionByName(more).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
