"""Global numbering, ranked merges and top-k without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.sources.staging import staged


#: Input bytes for which a range partition is made, where the session's number of partitions is too small for them.
PARTITION_BYTES = 256 << 20
#: A leaf of a plan without known size has a number beyond this.
_UNKNOWN_BYTES = 1 << 56


def range_partitions(frame: DataFrame) -> int:
    """The session's number of shuffle partitions, or more where the files and tables that `frame` reads are large."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    known = [n for n in (int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())) if n < _UNKNOWN_BYTES]
    return max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-sum(known) // PARTITION_BYTES))


def numbered(frame: DataFrame, *order: str, name: str = "n", partitions: int | None = None) -> DataFrame:
    """`frame` with its 1-based row number in the given total order.

    Rows are range-partitioned and counted per partition; a row's number is its
    number in its partition plus the counts before.  Only those counts (one row
    a partition) meet in one task.  The partitioned rows are staged: range bounds
    are sampled, so two runs of the shuffle need not cut alike."""
    if not order:
        raise ValueError("a numbering needs an order")
    count = partitions or range_partitions(frame)
    dealt = frame.repartitionByRange(count, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    # monotonically_increasing_id is partition number * 2**33 + the row's place in the sorted partition
    dealt = dealt.withColumn("_i", F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = staged(dealt, "numbered")
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_p", before.alias("_b")))  # one row a partition
    return dealt.join(starts, "_p").withColumn(name, F.col("_i") + F.col("_b") + 1).drop("_p", "_i", "_b")


def top(frame: DataFrame, k: int, score: str = "score", *tie: str) -> DataFrame:
    """The k rows of the largest score, ties by `tie`; each task keeps k rows."""
    return frame.orderBy(F.desc(score), *tie).limit(k)


def top_per(frame: DataFrame, k: int, group: str, score: str = "score", *tie: str) -> DataFrame:
    """The k rows of the largest score of each group, with their rank."""
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), *tie))
    return frame.withColumn("rank", best).where(F.col("rank") <= k)


def first_per(frame: DataFrame, most: int, group: str, *order: str) -> DataFrame:
    """The first `most` rows of each group in the given order; each task passes on no more than that of a group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return frame.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def merged_top(sources: dict[str, DataFrame], k: int, *tie: str) -> DataFrame:
    """Top k over several sources: each source's own top k, then the best of these."""
    parts = [top(f, k, "score", *tie).withColumn("source", F.lit(n)) for n, f in sources.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return top(out, k, "score", "source", *tie)


def cross_project(hits: DataFrame, k: int) -> DataFrame:
    """The best hit of each (project, name), then the top k."""
    best = hits.groupBy("project", "name").agg(F.max("score").alias("score"))
    return top(best, k, "score", "project", "name")


def latest(frame: DataFrame, key: list[str], *version: Column) -> DataFrame:
    """The row of the largest version of each key."""
    newest = F.row_number().over(Window.partitionBy(*key).orderBy(*(v.desc() for v in version)))
    return frame.withColumn("_n", newest).where("_n = 1").drop("_n")


def length_batches(frame: DataFrame, text: str, index: str, size: int, partitions: int | None = None) -> DataFrame:
    """batch: rows in order of text length (ties by index), `size` to a batch."""
    sized = frame.withColumn("_len", F.octet_length(text))
    return numbered(sized, "_len", index, name="_n", partitions=partitions).withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n", "_len")
