"""Keyed memory: a table key -> value with time to live, namespaces, retention and compaction.

Columns: key, value, ttl_ms, written_at, access_time, expire_at (0: never), permanent,
deleted, version.  Times are milliseconds; `now` is always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import namespace_of
from quillstone.operators.ranking import latest, numbered
from quillstone.sources.staging import staged

#: Bytes of an entry's header, the two terminators, and the alignment.
HEADER, TERMINATORS, ALIGN = 28, 2, 8
#: Longest key and value in bytes.
MAX_KEY, MAX_VALUE = 1023, (1 << 20) - 1
COLUMNS = ("key", "value", "ttl_ms", "written_at", "access_time", "expire_at", "permanent", "deleted", "version")


def entries(frame: DataFrame, key: Column, value: Column, written_at: Column, ttl_ms: Column | int = 0, version: Column | None = None) -> DataFrame:
    """A keyed table from any frame; a ttl of 0 is permanent."""
    ttl = F.lit(ttl_ms).cast("long") if isinstance(ttl_ms, int) else ttl_ms.cast("long")
    written = written_at.cast("long")
    return frame.select(
        key.alias("key"), value.alias("value"), ttl.alias("ttl_ms"), written.alias("written_at"), written.alias("access_time"),
        F.when(ttl > 0, written + ttl).otherwise(F.lit(0)).cast("long").alias("expire_at"), (ttl == 0).alias("permanent"), F.lit(False).alias("deleted"),
        (version if version is not None else written).cast("long").alias("version"),
    )


def valid_sizes(kv: DataFrame) -> DataFrame:
    """Entries whose key and value are within the limits."""
    return kv.where((F.octet_length("key") <= MAX_KEY) & (F.octet_length("value") <= MAX_VALUE))


def entry_bytes(key: Column | str = "key", value: Column | str = "value") -> Column:
    """Bytes of an entry with header, terminators and padding."""
    size = F.octet_length(key) + F.octet_length(value) + HEADER + TERMINATORS
    return (F.ceil(size / ALIGN) * ALIGN).cast("long")


def is_live(now: int) -> Column:
    """Neither deleted nor expired; an entry lives through the millisecond it expires in."""
    return ~F.col("deleted") & ((F.col("expire_at") == 0) | (F.col("expire_at") >= now))


def is_expired(now: int) -> Column:
    return (F.col("expire_at") > 0) & (F.col("expire_at") < now)


def live(kv: DataFrame, now: int) -> DataFrame:
    return kv.where(is_live(now))


def upsert(kv: DataFrame, changes: DataFrame) -> DataFrame:
    """The newest version of every key; one shuffle by key."""
    return latest(kv.unionByName(changes), ["key"], F.col("version"), F.col("written_at"))


def get(kv: DataFrame, key: str, now: int) -> DataFrame:
    return live(kv, now).where(F.col("key") == key).select("key", "value")


def exists(kv: DataFrame, key: str, now: int) -> DataFrame:
    """One row, found."""
    return get(kv, key, now).limit(1).agg((F.count("*") > 0).alias("found"))


def touch(kv: DataFrame, key: str, now: int) -> DataFrame:
    """Sets the access time of a key."""
    return kv.withColumn("access_time", F.when(F.col("key") == key, F.lit(now).cast("long")).otherwise(F.col("access_time")))


def expire(kv: DataFrame, key: str, now: int) -> DataFrame:
    """Marks a key as expired before `now`."""
    return kv.withColumn("expire_at", F.when(F.col("key") == key, F.lit(now - 1).cast("long")).otherwise(F.col("expire_at")))


def remove(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the keys of `keys` (column key)."""
    return kv.join(keys.select("key").distinct(), "key", "left_anti")


def set_in(kv: DataFrame, namespace: str, key: str, value: str, now: int, ttl_ms: int = 0) -> DataFrame:
    """`kv` with an entry at the namespace's key, as a newer version than any."""
    row = kv.sparkSession.range(1).crossJoin(F.broadcast(kv.agg((F.coalesce(F.max("version"), F.lit(0)) + 1).alias("_v"))))
    made = entries(row, F.lit(full_key(namespace, key)), F.lit(value), F.lit(now), ttl_ms, F.col("_v"))
    return upsert(kv, made)


def get_in(kv: DataFrame, namespace: str, key: str, now: int) -> DataFrame:
    return get(kv, full_key(namespace, key), now)


def remove_in(kv: DataFrame, namespace: str, key: str) -> DataFrame:
    return kv.where(F.col("key") != full_key(namespace, key))


def full_key(namespace: str, key: str) -> str:
    return f"{namespace.rstrip('/')}/{key}"


def in_namespace(namespace: str, key: Column | str = "key") -> Column:
    """The key itself or any key below it; /coding does not match /coding2."""
    k = F.col(key) if isinstance(key, str) else key
    return (k == namespace) | k.startswith(namespace + "/")


def delete_namespace(kv: DataFrame, namespace: str) -> DataFrame:
    """Without the keys below a namespace; an entry at the namespace's own key stays."""
    return kv.where(~F.col("key").startswith(namespace.rstrip("/") + "/"))


def iterate(kv: DataFrame, now: int, namespace: str | None = None) -> DataFrame:
    """Live entries in key order."""
    rows = live(kv, now)
    return (rows if namespace is None else rows.where(in_namespace(namespace))).orderBy("key")


def purge_expired(kv: DataFrame, now: int) -> DataFrame:
    return kv.where(~is_expired(now))


def compacted(kv: DataFrame, now: int) -> DataFrame:
    """Live entries in key order with dense numbers."""
    return numbered(live(kv, now), "key", name="position")


def status(now: int) -> Column:
    return F.when(F.col("deleted"), "deleted").when(is_expired(now), "expired").otherwise("valid")


def status_counts(kv: DataFrame, now: int) -> DataFrame:
    return kv.groupBy(status(now).alias("status")).agg(F.count("*").alias("entries"))


def memory_used(kv: DataFrame) -> DataFrame:
    return kv.agg(F.coalesce(F.sum(entry_bytes()), F.lit(0)).alias("memory_used"))


def stats(kv: DataFrame, now: int) -> DataFrame:
    return live(kv, now).agg(F.count("*").alias("entries"), F.coalesce(F.sum(entry_bytes()), F.lit(0)).alias("memory_used"))


def namespaces(kv: DataFrame, separator: str = ":") -> DataFrame:
    """Distinct first key parts."""
    return kv.select(F.split_part("key", F.lit(separator), F.lit(1)).alias("namespace")).distinct()


def namespace_counts(kv: DataFrame) -> DataFrame:
    """Entries of each namespace node."""
    return kv.groupBy(namespace_of(F.col("key")).alias("namespace")).agg(F.count("*").alias("entries"))


#: Entries of a range whose running sum one task forms.
RANGE_ENTRIES = 1_000_000


def retained(kv: DataFrame, capacity: int, *, buckets: int | None = None) -> DataFrame:
    """The entries that least-recently-used eviction leaves within `capacity` bytes.

    Permanent entries stay and use capacity.  Of the others the most recently
    used suffix stays whose bytes fit into the rest, ties by key.  The running
    sum is two-level: bytes are summed per range of access times first, and only
    the entries of one range, RANGE_ENTRIES or so, meet in a task's window.
    """
    if buckets is None:
        buckets = -(-kv.count() // RANGE_ENTRIES) + 7
    sized = kv.withColumn("_b", entry_bytes())
    fixed = sized.where("permanent").agg(F.coalesce(F.sum("_b"), F.lit(0)).alias("_fixed"))
    loose = sized.where("not permanent")
    dealt = loose.repartitionByRange(buckets, F.desc("access_time"), "key").sortWithinPartitions(F.desc("access_time"), "key").withColumn("_p", F.spark_partition_id())
    dealt = staged(dealt, "retained")
    sums = dealt.groupBy("_p").agg(F.sum("_b").alias("_s"))
    before = sums.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum("_b").over(Window.partitionBy("_p").orderBy(F.desc("access_time"), "key").rowsBetween(Window.unboundedPreceding, 0))
    kept = dealt.join(F.broadcast(before), "_p").withColumn("_run", own + F.col("_before"))  # a row a range
    kept = kept.crossJoin(F.broadcast(fixed)).where(F.col("_run") + F.col("_fixed") <= capacity).drop("_p", "_before", "_run", "_fixed", "_b")
    return sized.where("permanent").drop("_b").unionByName(kept)
