"""Search over keyed tables: every mode returns key, value, score, by key order where a cut is asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as X
from quillstone.operators.keyed import in_namespace, live
from quillstone.sources.staging import staged


@dataclass(frozen=True)
class Options:
    """max_results 0 is unlimited; matching ignores case unless case_sensitive."""

    max_results: int = 100
    case_sensitive: bool = False
    namespace: str | None = None
    query_text: str | None = None


def _found(kv: DataFrame, now: int, options: Options, condition: Column, score: Column | float = 1.0) -> DataFrame:
    rows = live(kv, now).where(condition)
    if options.namespace is not None:
        rows = rows.where(in_namespace(options.namespace))
    rows = rows.select("key", "value", (F.lit(score) if isinstance(score, float) else score).alias("score"))
    return rows.orderBy("key").limit(options.max_results) if options.max_results else rows


def exact(kv: DataFrame, key: str, now: int) -> DataFrame:
    return _found(kv, now, Options(0), F.col("key") == key)


def prefix(kv: DataFrame, start: str, now: int, options: Options = Options()) -> DataFrame:
    if not start:
        raise ValueError("a prefix is not empty")
    return _found(kv, now, options, F.col("key").startswith(start))


def between(kv: DataFrame, start: str, end: str, now: int, options: Options = Options()) -> DataFrame:
    """Keys in [start, end), by bytes."""
    return _found(kv, now, options, (F.col("key") >= start) & (F.col("key") < end))


def pattern(kv: DataFrame, expression: str, now: int, options: Options = Options()) -> DataFrame:
    """Keys that an unanchored regular expression matches."""
    return _found(kv, now, options, X.matches_pattern(F.col("key"), expression, options.case_sensitive))


def fuzzy(kv: DataFrame, target: str, now: int, options: Options = Options()) -> DataFrame:
    """Keys whose edit similarity with the target is above 0.5, cut in key order.

    Lengths alone bound the score, so most keys are dropped before the distance is computed."""
    size = len(target.encode())
    close = F.octet_length("key").between(-(-size // 2), 2 * size)
    score = X.fuzzy_score(F.col("key"), F.lit(target))
    return _found(kv, now, options, close & (score > 0.5), score)


def tag(kv: DataFrame, word: str, now: int, options: Options = Options()) -> DataFrame:
    """Values with the tag as a token (as written); without any, values with it as a bounded word.

    One scan finds both; what it finds is staged, and whether a token was among it decides."""
    token = F.array_contains(X.tag_tokens(F.col("value")), word) if len(word.encode()) >= 2 else F.lit(False)
    either = token | X.contains_word(F.col("value"), word)
    rows = live(kv, now).where(F.contains("value", F.lit(word))).where(either)
    if options.namespace is not None:
        rows = rows.where(in_namespace(options.namespace))
    rows = staged(rows.select("key", "value", F.lit(1.0).alias("score"), token.alias("_token")), "tag")
    any_token = rows.agg(F.coalesce(F.bool_or("_token"), F.lit(False)).alias("_any"))
    kept = rows.crossJoin(F.broadcast(any_token)).where(F.col("_token") | ~F.col("_any")).select("key", "value", "score")
    return kept.orderBy("key").limit(options.max_results) if options.max_results else kept


def structure(kv: DataFrame, query: str, now: int, options: Options = Options()) -> DataFrame:
    """Values of syntax records that contain the query."""
    value = F.col("value")
    return _found(kv, now, options, F.contains(value, F.lit('"type":"')) & F.contains(value, F.lit(query)))


def tag_postings(kv: DataFrame) -> DataFrame:
    """tag, key: the inverted index, a row for each key of a tag.  A tag of any number of keys stays rows."""
    return kv.select(F.explode(F.array_distinct(X.tag_tokens(F.col("value")))).alias("tag"), "key")


def tag_index(kv: DataFrame) -> DataFrame:
    """tag, entries: how many keys each tag of the index has."""
    return tag_postings(kv).groupBy("tag").agg(F.count("*").alias("entries"))


def write_tag_index(kv: DataFrame, path: str) -> None:
    """The postings stored in order of tag and key, so that a lookup skips all row groups but a few."""
    tag_postings(kv).repartitionByRange("tag", "key").sortWithinPartitions("tag", "key").write.mode("overwrite").parquet(path)


def tagged(kv: DataFrame, postings: DataFrame, word: str, now: int) -> DataFrame:
    """key, value of the live entries that the stored index has for a tag."""
    return live(kv, now).join(postings.where(F.col("tag") == word).select("key"), "key", "left_semi").select("key", "value")


def serve(kv: DataFrame, parameters: dict[str, str], now: int) -> DataFrame:
    """A request's search: type prefix by default, max_results outside 1 to 10000 read as 100."""
    try:
        limit = int(parameters.get("max_results", "100"))
    except ValueError:
        limit = 100
    options = Options(limit if 1 <= limit <= 10_000 else 100)
    kind = {"prefix": prefix, "regex": pattern, "fuzzy": fuzzy, "tag": tag}[parameters.get("type", "prefix")]
    return kind(kv, parameters["q"], now, options)
