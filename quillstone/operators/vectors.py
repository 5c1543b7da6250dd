"""Vector search and ranking: exact top-k, hybrid and engine scores, batch search, stored codes for approximate search."""

from __future__ import annotations

from dataclasses import dataclass
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.functions import text as X
from quillstone.functions import vectors as V
from quillstone.operators.graph import neighbourhood
from quillstone.operators.keyed import in_namespace, live
from quillstone.operators.ranking import cross_project, length_batches, top

#: Largest vector, dimension of the ranking engine, and the confidence below which a first hit is doubtful.
MAX_DIM, ENGINE_DIM, LOW_CONFIDENCE = 1536, 768, 0.30


def similarity(vector: Column, query: list[float]) -> Column:
    """(cosine + 1) / 2, so 0 to 1."""
    return (V.cosine(vector, V.literal(query)) + 1) / 2


def vector_entries(kv: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keyed entries with their vectors (key, embedding); the value and the vector are columns of one table."""
    return kv.join(vectors.select("key", F.col("embedding").alias("embedding"), F.size("embedding").alias("dim")), "key")


def exact_top_k(vectors: DataFrame, query: list[float], k: int = 10, min_score: float | None = None, name: str = "key") -> DataFrame:
    """name, score of the k most similar vectors of the query's dimension, ties by name.

    A narrow scan and a top-k; each task keeps k rows."""
    scored = vectors.where(F.size("embedding") == len(query)).select(name, similarity(F.col("embedding"), query).alias("score"))
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return top(scored, k, "score", name)


def dot_top_k(vectors: DataFrame, query: list[float], k: int = 10, name: str = "key") -> DataFrame:
    """name, score by plain dot product, for vectors at length 1."""
    return top(vectors.where(F.size("embedding") == len(query)).select(name, V.dot(F.col("embedding"), V.literal(query)).alias("score")), k, "score", name)


def batch_top_k(vectors: DataFrame, queries: np.ndarray, query_ids: list[int], k: int = 10, name: str = "vec_id") -> DataFrame:
    """query_id, name, score: the k most similar vectors of every query of a stated, bounded batch.

    Matrix products per Arrow batch; every batch passes on only k rows a query."""
    unit = queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-30)
    shared = vectors.sparkSession.sparkContext.broadcast(unit.astype(np.float64))

    def run(batches):
        q = shared.value
        for batch in batches:
            column = batch.column("embedding")
            keep = np.flatnonzero(np.array([x.is_valid and len(x) == q.shape[1] for x in column]))
            if not len(keep):
                continue
            part = batch.take(pa.array(keep))
            v = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(keep), -1).astype(np.float64)
            lengths = np.linalg.norm(v, axis=1)
            scores = (np.where(lengths > 0, q @ v.T / np.maximum(lengths, 1e-30), 0.0) + 1) / 2
            ids = part.column("id").to_numpy()
            best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores))[:, :k]
            n = best.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(query_ids), n)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(scores, best, 1).ravel())], ["query_id", name, "score"])

    found = vectors.select(F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"query_id long, {name} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), name))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Queries of a block, and vectors that a block meets in one task.
QUERY_BLOCK, VECTOR_PART = 4096, 65536


def all_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, name: str = "vec_id") -> DataFrame:
    """query_id, name, score, rank: the k most similar vectors of every row of `queries` (query_id, embedding), of
    any number.  Blocks of queries meet parts of the vectors, a pair to a task, which passes on k rows a query."""
    rows = vectors.where("embedding is not null").select(F.col(name).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("d"))
    asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("d"))
    parts, blocks = -(-rows.count() // VECTOR_PART) or 1, -(-asked.count() // QUERY_BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("block", every(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("part", every(parts))

    def matrix(table: pa.Table) -> np.ndarray:
        return table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows and left["d"][0].as_py():
            v, ids = matrix(left), left["id"].to_numpy()
            lengths = np.linalg.norm(v, axis=1)
            for start in range(0, right.num_rows, 256):
                part = right.slice(start, 256)
                q = matrix(part)
                own = np.linalg.norm(q, axis=1)[:, None] * lengths
                scores = (np.where(own > 0, q @ v.T / np.maximum(own, 1e-300), 0.0) + 1) / 2
                best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores))[:, :k]
                for column, values in zip(out, (np.repeat(part["query_id"].to_numpy(), best.shape[1]), ids[best].ravel(), np.take_along_axis(scores, best, 1).ravel()), strict=True):
                    column.append(values)
        return pa.table(dict(zip(("query_id", name, "score"), (pa.array(np.concatenate(x)) for x in out), strict=True)))

    found = rows.groupBy("part", "block", "d").cogroup(asked.groupBy("part", "block", "d")).applyInArrow(run, f"query_id long, {name} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), name))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Sign bits of a stored code, and how many candidates per wanted row are compared exactly.
CODE_BITS, OVER_FETCH = 256, 40
#: Chance that a batch search misses a row it should find, and the steps in which it takes angles.
MISS, ANGLES = 0.01, 1024


def _planes(dim: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(bits, dim))


def _codes(planes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """(n, bits / 64) words of the signs of the products with the planes."""
    return np.packbits(vectors @ planes.T > 0, axis=1).view(np.int64)


def _radii(bits: int, miss: float) -> np.ndarray:
    """For angles from 0 to pi in ANGLES steps, the fewest bits within which the codes of two vectors at that angle differ,
    but for a chance of `miss`.  A bit differs if its plane lies between the two: with a chance of angle / pi, each by itself."""
    d, share = np.arange(bits + 1), np.linspace(0, 1, ANGLES + 1)[1:-1, None]
    ways = np.array([lgamma(bits + 1) - lgamma(i + 1) - lgamma(bits - i + 1) for i in d])
    within = np.cumsum(np.exp(ways + d * np.log(share) + (bits - d) * np.log1p(-share)), axis=1)
    return np.concatenate([[0], np.minimum((within < 1 - miss).sum(axis=1), bits), [bits]])


def build_index(vectors: DataFrame, dim: int, bits: int = CODE_BITS, seed: int = 7, name: str = "key") -> DataFrame:
    """name, codes array<long>, embedding of every vector of that dimension: a code of `bits` signs, an eighth of
    the vector's bytes or less.  Nothing is fitted.  Store the result (write_index); a search reads the codes of all
    rows, and the vectors of its candidates only."""
    planes = _planes(dim, bits, seed)

    def run(batches):
        for batch in batches:
            part = batch.filter(pa.array([x.is_valid and len(x) == dim for x in batch.column("embedding")], pa.bool_()))
            values = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim).astype(np.float64)
            words = _codes(planes, values) if part.num_rows else np.zeros((0, bits // 64), np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * (bits // 64), pa.int32()), pa.array(words.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("name"), lists, part.column("embedding")], ["name", "codes", "embedding"])

    kind = dict(vectors.dtypes)[name]
    made = vectors.select(F.col(name).alias("name"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"name {kind}, codes array<long>, embedding array<double>")
    return made.withColumnRenamed("name", name)


def write_index(index: DataFrame, path: str, name: str = "key") -> None:
    """Codes and vectors as two tables, so that the scan of codes reads nothing else."""
    index.select(name, "codes").write.mode("overwrite").parquet(f"{path}/codes")
    index.select(name, "embedding").write.mode("overwrite").parquet(f"{path}/vectors")


def indexed_top_k(codes: DataFrame, vectors: DataFrame, query: list[float], k: int = 10, over: int = OVER_FETCH, bits: int = CODE_BITS, seed: int = 7, name: str = "key") -> DataFrame:
    """name, score: approximately the k most similar vectors.  The over * k rows whose codes differ in the fewest
    bits (ties by name) are candidates; their exact similarities decide."""
    own = _codes(_planes(len(query), bits, seed), np.asarray(query, float)[None, :])[0]
    apart = sum((F.bit_count(F.col("codes")[i].bitwiseXOR(F.lit(int(w)))) for i, w in enumerate(own)), F.lit(0))
    near = codes.select(name, apart.alias("_apart")).orderBy("_apart", name).limit(over * k).select(name)
    return exact_top_k(vectors.join(F.broadcast(near), name), query, k, name=name)  # over * k rows


def indexed_all_top_k(index: DataFrame, queries: DataFrame, k: int = 10, over: int = OVER_FETCH, bits: int = CODE_BITS, seed: int = 7, name: str = "vec_id") -> DataFrame:
    """query_id, name, score, rank: the same for every row of `queries` (query_id, embedding) of the index's
    dimension, of any number.  Blocks of queries meet parts of the index; of a part the over * k nearest codes of
    each query are scored, so no candidate is lost that the single search would have.  The k-th best of these states an
    angle; then every row is scored whose code lies as near as codes at that angle do, but for a chance of MISS.  So the
    candidates grow with the rows, and recall depends neither on their number nor on `over`."""
    rows = index.select(F.col(name).cast("long").alias("id"), "codes", F.col("embedding").alias("v"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    parts, blocks = -(-rows.count() // VECTOR_PART) or 1, -(-asked.count() // QUERY_BLOCK) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).withColumn("block", every(blocks))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("part", every(parts))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            flat = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
            words, v, q = np.ascontiguousarray(flat(left, "codes").view(np.uint64).T), flat(left, "v"), flat(right, "v")
            own = _codes(_planes(q.shape[1], bits, seed), q).view(np.uint64)
            lengths, ids, radii = np.linalg.norm(v, axis=1), left["id"].to_numpy(), _radii(bits, MISS)

            def scores(near: np.ndarray, asked: np.ndarray) -> np.ndarray:
                both = lengths[near] * np.linalg.norm(asked)
                return (np.where(both > 0, v[near] @ asked / np.maximum(both, 1e-300), 0.0) + 1) / 2

            for i, query_id in enumerate(right["query_id"].to_pylist()):
                apart = np.bitwise_count(words ^ own[i][:, None]).sum(axis=0, dtype=np.int32)
                first = min(max(over, 1) * k, len(ids))
                radius = np.partition(apart, first - 1)[first - 1]
                near = np.flatnonzero(apart <= radius)
                score = scores(near, q[i])
                if len(near) < len(ids):
                    last = -2 * np.partition(-score, k - 1)[k - 1] - 1  # the cosine of the k-th best
                    wide = bits if np.isnan(last) else radii[int(np.ceil(np.arccos(np.clip(last, -1, 1)) / np.pi * ANGLES))]
                    if wide > radius:
                        near = np.flatnonzero(apart <= wide)
                        score = scores(near, q[i])
                best = np.lexsort((ids[near], -score))[:k]
                for column, values in zip(out, (np.full(len(best), query_id), ids[near][best], score[best]), strict=True):
                    column.append(values)
        return pa.table(dict(zip(("query_id", name, "score"), (pa.array(np.concatenate(x)) for x in out), strict=True)))

    found = rows.groupBy("part", "block").cogroup(asked.groupBy("part", "block")).applyInArrow(run, f"query_id long, {name} long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), name))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hybrid_score(score: Column, key: Column, value: Column, query_text: str | None) -> Column:
    """The similarity times factors for titles, metadata, query words in the value and early paragraphs."""
    title = key.endswith("/title") | F.contains(key, F.lit("/title/"))
    out = score * F.when(title, 1.5).when(F.contains(key, F.lit("/_meta/")), 1.3).otherwise(1.0)
    if query_text:
        out = out * F.least(F.lit(1.5), 1.0 + X.keyword_matches(value, query_text) * 0.1)
    return out * F.when(X.paragraph_number(key) < 3, 1.1).otherwise(1.0)


def hybrid_top_k(entries: DataFrame, query: list[float], query_text: str, k: int = 10) -> DataFrame:
    """Top k of vector entries by hybrid score."""
    base = similarity(F.col("embedding"), query)
    return top(entries.where(F.size("embedding") == len(query)).select("key", hybrid_score(base, F.col("key"), F.col("value"), query_text).alias("score")), k, "score", "key")


@dataclass(frozen=True)
class EngineOptions:
    keyword_boost: bool = True
    caller_boost: bool = True
    kind: str | None = None
    language: str | None = None
    file: str | None = None


def keyword_boost(names: DataFrame, query: str, idf: DataFrame | None = None, name: str = "name") -> DataFrame:
    """name, keyword_boost: the weights of the query's tokens that occur in the name, at most 0.3.

    The query's tokens are few literals; the idf table only supplies their weights (1.0 where it has none)."""
    tokens = X.query_tokens(query)
    if not tokens:
        return names.select(name, F.lit(0.0).alias("keyword_boost"))
    spark = names.sparkSession
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "i int, token string")
    weights = asked.select("i", "token", F.lit(1.0).alias("idf")) if idf is None else asked.join(idf.select(F.col("word").alias("token"), "idf"), "token", "left").select("i", "token", F.coalesce("idf", F.lit(1.0)).alias("idf"))
    folded = weights.agg(F.array_sort(F.collect_list(F.struct("i", "token", "idf"))).alias("_w"))  # as many as the query has words
    lowered = X.ascii_lower(F.col(name))
    total = F.aggregate("_w", F.lit(0.0), lambda s, w: s + F.when(F.contains(lowered, X.ascii_lower(w["token"])), 0.01 + w["idf"] / 9.0 * 0.07).otherwise(0.0))
    return names.crossJoin(F.broadcast(folded)).withColumn("keyword_boost", F.least(F.lit(0.3), total)).drop("_w")


def caller_boost(callers: Column) -> Column:
    """min(0.1, 0.02 ln(callers + 1))."""
    return F.when(callers > 0, F.least(F.lit(0.1), F.log(callers + 1.0) * 0.02)).otherwise(0.0)


def sharpened(score: Column) -> Column:
    return F.tanh((score - 0.5) * 2 * 1.5) * 0.5 + 0.5


def engine_scores(hits: DataFrame, meta: DataFrame, query: str, idf: DataFrame | None = None, callers: DataFrame | None = None, options: EngineOptions = EngineOptions()) -> DataFrame:
    """hits (name, score) rescored with metadata (name, file, kind, language[, line_no]), idf (word, idf)
    and callers (name, callers): an S-curve, keyword and caller boosts capped at 1, a penalty for test
    paths; anonymous names and undefined scores go; filters drop hits without metadata.  Hits may carry
    file, kind and language themselves, with `meta` for the others or None."""
    if meta is None:
        meta = hits.sparkSession.createDataFrame([], "name string")
    missing = [c for c in ("file", "kind", "language") if c not in meta.columns and c not in hits.columns]
    meta = meta.select("*", *(F.lit(None).cast("string").alias(c) for c in missing))
    last = meta if "line_no" not in meta.columns else meta.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("line_no")))).where("_n = 1").drop("_n", "line_no")
    rows = hits.where(~F.col("name").startswith("__anon") & ~F.isnan("score") & F.col("score").isNotNull()).join(last, "name", "left")
    score = sharpened(F.col("score"))
    if options.keyword_boost and query:
        rows = keyword_boost(rows, query, idf)
        score = F.least(F.lit(1.0), score + F.col("keyword_boost"))
    if options.caller_boost and callers is not None:
        rows = rows.join(callers, "name", "left")
        score = F.least(F.lit(1.0), score + caller_boost(F.coalesce("callers", F.lit(0))))
    score = score * F.when(F.coalesce(X.is_noise_path(F.col("file")), F.lit(False)), 0.85).otherwise(1.0)
    if options.kind:
        rows = rows.where(F.lower("kind") == options.kind.lower())
    if options.language:
        rows = rows.where(F.lower("language") == options.language.lower())
    if options.file:
        rows = rows.where(F.contains("file", F.lit(options.file)))
    return rows.select("name", "file", "kind", "language", score.alias("score"))


def cross_engine(sources: dict[str, tuple[DataFrame, DataFrame]], query: str, k: int = 10, idf: DataFrame | None = None, callers: DataFrame | None = None, options: EngineOptions = EngineOptions(), over: int = 4) -> DataFrame:
    """project, name, score: the engine's scores over several projects (hits, metadata), the best hit of each name,
    then the best k of all.  Of each project `over` * k hits, by similarity and then name, are rescored; 0 is all."""
    rows = None
    for project, (hits, meta) in sorted(sources.items()):
        some = top(hits, over * k, "score", "name") if over else hits
        part = engine_scores(some, meta, query, idf, callers, options).select(F.lit(project).alias("project"), "name", "score")
        rows = part if rows is None else rows.unionByName(part)
    return cross_project(rows, k)


def explore(hits: DataFrame, meta: DataFrame, sites: DataFrame, query: str, k: int = 5, depth: int = 2, idf: DataFrame | None = None, options: EngineOptions = EngineOptions()) -> DataFrame:
    """part, name, depth, score: the best k engine hits (part hit), and the functions within `depth` calls of the
    first of them (parts callers and callees)."""
    best = top(engine_scores(hits, meta, query, idf, None, options).select("name", "score"), k, "score", "name")
    out = best.select(F.lit("hit").alias("part"), "name", F.lit(0).alias("depth"), "score")
    first = best.orderBy(F.desc("score"), "name").first()
    if first is None:
        return out
    around = neighbourhood(sites, first.name, depth)
    return out.unionByName(around.select(F.col("direction").alias("part"), "name", "depth", F.lit(None).cast("double").alias("score")))


def vector_job(kv: DataFrame, namespace: str, now: int, size: int = 32) -> DataFrame:
    """key, name, text, batch: what is to be embedded of a repository's live chunks (JSON values with name, file,
    language, signature, docstring, content): paths of tests and mocks left out, texts in batches of like length."""
    chunk = F.from_json("value", "name string, file string, language string, signature string, docstring string, content string")
    rows = live(kv, now).where(in_namespace(f"{namespace}/chunks")).select("key", chunk.alias("c")).where(~X.is_noise_path(F.coalesce("c.file", F.lit(""))))
    texts = rows.select("key", F.col("c.name").alias("name"), X.embedding_text(F.col("c.name"), F.col("c.language"), F.col("c.signature"), F.col("c.docstring"), F.col("c.content")).alias("text"))
    return length_batches(texts, "text", "key", size)


def embedded(job: DataFrame, embed: Column | None = None) -> DataFrame:
    """key, name, embedding of a job's texts at length 1, embedded in Arrow batches; the stand-in model by default."""
    vector = hashing_embedding("text") if embed is None else embed
    return job.select("key", "name", vector.alias("embedding")).withColumn("embedding", V.normalised(F.col("embedding")))


def source_matches(source: Column, namespace: str) -> Column:
    """Whether a vector source serves a namespace: equal, contained either way, or /code/x for /code/local/x."""
    wanted = F.lit(namespace)
    local = F.replace(source, F.lit("/code/local/"), F.lit("/code/"))
    return (source == wanted) | F.contains(source, wanted) | F.contains(wanted, source) | (local == F.replace(wanted, F.lit("/code/local/"), F.lit("/code/")))


def with_confidence(hits: DataFrame) -> DataFrame:
    """hits with low_confidence: whether the best score is under 0.30."""
    best = hits.agg(F.max("score").alias("_best"))
    return hits.crossJoin(F.broadcast(best)).withColumn("low_confidence", F.col("_best") < LOW_CONFIDENCE).drop("_best")


def compare(hits: DataFrame, namespaces: list[str], k: int = 3) -> DataFrame:
    """The best k hits (namespace, name, score) of each namespace, side by side by rank."""
    rank = F.row_number().over(Window.partitionBy("namespace").orderBy(F.desc("score"), "name"))
    return hits.where(F.col("namespace").isin(namespaces)).withColumn("rank", rank).where(F.col("rank") <= k)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def hashing_embedding(text: pd.Series) -> pd.Series:
    """A deterministic 64-dimensional stand-in for a text model: signed hashed words at length 1."""
    import zlib

    def one(s):
        v = np.zeros(64)
        for w in (s or "").lower().split():
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h & 64 else -1
        n = np.linalg.norm(v)
        return (v / n if n else v).tolist()

    return text.map(one, na_action=None)
