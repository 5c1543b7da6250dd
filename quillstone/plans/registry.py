"""Registration of queries: a name, a function of (spark, sf_dir), and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(column, digits: int = 6):
    return F.round(column, digits)


def head_has(text: str, word: str) -> str:
    """SQL: 1 where the first 1023 bytes of a text, ASCII capitals small, have an ASCII word, else 0; bytes are compared as hex pairs."""
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"contains(regexp_replace(left(hex(encode({low})), 2046), '(..)', '\\1,', 'g'), '{''.join(f'{b:02X},' for b in word.encode())}')::int"


#: SQL of a text's first 200 bytes: the characters whose bytes all lie within them.
PREVIEW = "array_to_string(list_filter(list_transform(range(1, least(length({t}), 200) + 1), lambda i: case when strlen(left({t}, i::int)) <= 200 then substr({t}, i, 1) end), lambda c: c is not null), '')"


def preview_of(text: str) -> str:
    return PREVIEW.replace("{t}", text)


#: Documents and events as keyed tables, here and in SQL.
KV_DOCUMENTS = "(select '/' || lang || '/' || source || '/' || doc_id as key, text as value from documents)"
KV_EVENTS = "(select '/events/' || event_type || '/' || user_id || '/' || event_id as key, props as value, event_id * 1000 as written_at, event_id * 1000 as access_time, (event_id % 4) * 3600000 as ttl_ms, case when event_id % 4 > 0 then event_id * 1000 + (event_id % 4) * 3600000 else 0 end as expire_at, event_id % 4 = 0 as permanent, event_id % 10 = 9 as deleted, event_id as version from events)"
NOW = 7_000_000


def kv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return keyed.entries(docs, F.concat_ws("/", F.lit(""), "lang", "source", "doc_id"), F.col("text"), F.col("doc_id"))


def kv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    made = keyed.entries(
        events.select("event_id", "event_type", "user_id", "props"), F.concat_ws("/", F.lit("/events"), "event_type", "user_id", "event_id"), F.col("props"),
        F.col("event_id") * 1000, F.col("event_id") % 4 * 3_600_000, F.col("event_id"),
    )
    return made.withColumn("deleted", F.col("version") % 10 == 9)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites from lineitem: supplier -> part, in one space of names."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("line"))


CALLS = "(select l_suppkey as src, l_partkey as dst, l_returnflag as file, l_linenumber as line from lineitem)"
