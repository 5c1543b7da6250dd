"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import bpe, decontaminate, licences, quality, secrets, substring, suffixes, topk, warc
from quillstone.llm.minhash import minhash_dedup
from quillstone.llm.storage import modest


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    modest(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(_table(spark, sf_dir, "documents"), k=5, num=85, den=100)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.classify_quality(_table(spark, sf_dir, "documents"), labels, threshold=0.3)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.suffix_dedup(_table(spark, sf_dir, "documents"), window=50)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents")).select("doc_id", "spans")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.substring_dedup(_table(spark, sf_dir, "documents"), window=20)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), k=5)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=5, threshold=0.8)


# Written apart from the operator's tables: the references that stand on lines of their own.
_OP2 = """
with lines as (
  select doc_id, list_transform(string_split(text, chr(10)), lambda s: trim(lower(s), ' .')) as parts from documents),
named as (
  select doc_id, list_filter(list_transform(parts, lambda s: case
    when s in ('licensed under the apache license, version 2.0', 'released under the apache license, version 2.0') then 'Apache-2.0'
    when s in ('released under the mit license', 'licensed under the mit license', 'this project is licensed under the mit license') then 'MIT'
    when s in ('this work is licensed under the gnu general public license, version 3', 'licensed under the gnu general public license, version 3') then 'GPL-3.0-only'
    when s = 'licensed under cc by-nc 4.0' then 'CC-BY-NC-4.0'
    when s = 'licensed under cc by 4.0' then 'CC-BY-4.0'
    when s = 'licensed under cc by-sa 4.0' then 'CC-BY-SA-4.0'
    when s = 'all rights reserved' then 'AllRights' end), lambda s: s is not null) as found from lines)
select doc_id, coalesce(array_to_string(found, ','), '') as sentences,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(found, lambda s: case when s = 'AllRights' then 'Proprietary' else s end))), ','), '') as licences from named
"""

_OP8 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id as vec_id, cast(list_inner_product(a.q, b.q) as bigint) as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

_OP9 = """
with p as (
  select page_id, coalesce(html, '') as payload from pages),
d as (select page_id, strlen(payload) as payload_bytes, sha1(payload) as payload_digest from p),
w as (select *, max(page_id) over (partition by payload_digest) as largest from d)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> largest then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> largest then largest end as refers_to
from w
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_licences, op3_quality, op4_suffix, op5_secrets, op6_substring, op7_bpe, op8_topk, op9_warc, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op2_licences": _OP2, "op8_topk": _OP8, "op9_warc": _OP9}
