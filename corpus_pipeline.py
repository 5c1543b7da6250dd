"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, tokens.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept, and returns a DataFrame that is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.llm import bpe, decontaminate, quality, secrets
from quillstone.llm.minhash import minhash_dedup
from quillstone.llm.queries import tokenizer_path
from quillstone.llm.storage import cut, modest, spare
from quillstone.operators.ranking import numbered


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.3)."""
    modest(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    model = quality.train(docs, labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    score = spare(docs, "score")
    return quality.score(docs, model, score).where(F.col(score) >= 0.3).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (similarity 0.8 of five-word shingles): the one with the
    smallest doc_id (nulls last), of several the one whose text and other columns hash lowest.  Every row is a document by its own text, also
    where rows share a doc_id or have none.  Of texts without words, which are in no class, rows equal in
    doc_id and text count once."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # Further columns travel in one struct, so that no name of theirs can clash with an operator's.
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in others), F.lit(0).alias("_")).alias("_others"))
    # The order's keys are short, as the bounds of its ranges are sampled from them.
    ordered = packed.withColumn("_null", F.col("doc_id").isNull()).withColumn("_hash", F.xxhash64("text", F.to_json("_others")))
    rows = numbered(ordered, "_null", "doc_id", "_hash", name="_row").drop("_null", "_hash")
    kept = minhash_dedup(rows.select(F.col("_row").alias("doc_id"), "text"), k=5, num=80, den=100).where("kept")
    stay = rows.join(kept.select(F.col("doc_id").alias("_row"), (F.col("n_shingles") > 0).alias("_words")).hint("merge"), "_row")
    first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("_row"))
    bare = stay.where("not _words").withColumn("_n", first).where("_n = 1").drop("_n")
    return stay.where("_words").union(bare).select(*(c if c in ("doc_id", "text") else F.col(f"_others.`{c}`") for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage (a window of weighted similarity 0.8 with an item); every
    row counts by its own text, with or without a doc_id."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in text replaced by [SECRET]; n_chars follows the text."""
    hidden = secrets.redact(docs)
    return hidden.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the text decoded from the ids."""
    tokens = bpe.round_trip(docs, tokenizer_path())
    return tokens.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.decode("decoded", "UTF-8").alias("decoded"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("secrets", hide_secrets),
    ("tokens", tokenise),
]

#: No stage but the scans of fixed patterns can be said in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; every result but the last is cut to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut(docs, name)
    return docs
