"""Text quality by Naive Bayes support vectors.

Indicators of hashed n-grams (words, word pairs and byte trigrams) are scaled
by the log-count ratios of the two classes; a linear hinge-loss model is fitted
on them by dual coordinate descent, and a sigmoid maps its margins to
probabilities.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm import kernel as K

#: Labelled rows that a fit takes at most, those with the smallest hashes of doc_id: a bounded sample.
SAMPLE_ROWS = 8000
#: Hash slots: 2**18 for words and word pairs together, 2**16 for byte trigrams.
WORD_BITS, BYTE_BITS = 18, 16
#: After them come one slot for a word that follows itself and one for a word that does so twice.
REPEATED = (1 << WORD_BITS) + (1 << BYTE_BITS)
SIZE = REPEATED + 2
COST, EPOCHS, SMOOTHING = 1.0, 12, 1.0


def features(part: pa.RecordBatch) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each row; none for an empty text."""
    data, at = K.utf8(part.column("text"))
    data = K.LOWER[data]
    starts, ends, rows = K.word_bounds(data, at)
    words = K.span_hashes(data, starts, ends)
    ones = (words >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    pairs, _, pair_rows = K.shingles(words, rows, 2, seed=5)
    twos = (pairs >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    wide = data.astype(np.uint32)
    tri = ((((wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BYTE_BITS)).astype(np.int32) + (1 << WORD_BITS) if len(data) > 2 else np.zeros(0, np.int32)
    again = np.zeros(len(words) + 2, bool)
    again[1 : len(words)] = words[1:] == words[:-1]
    again[rows[:-1]] = False
    out = []
    for i in range(part.num_rows):
        twice = again[rows[i] : rows[i + 1]]
        loops = [REPEATED] * bool(twice.any()) + [REPEATED + 1] * bool((twice[1:] & twice[:-1]).any())
        own = tri[at[i] : max(at[i], at[i + 1] - 2)]
        out.append(np.unique(np.concatenate([ones[rows[i] : rows[i + 1]], twos[pair_rows[i] : pair_rows[i + 1]], own, np.array(loops, np.int32)])))
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights (the ratios are multiplied in), and slope and offset of the sigmoid.

    Rows in an order that does not depend on partitions.  With one class only,
    the weights are 0 and every score is that class's smoothed share."""
    labels = np.asarray(labels)
    share = (labels.sum() + 1.0) / (len(labels) + 2.0)
    if len(labels) < 2 or labels.min() == labels.max():
        return np.zeros(SIZE, np.float32), 1.0, float(np.log(share / (1 - share)))
    held = np.arange(len(rows)) % 5 == 4 if len(rows) >= 50 else np.zeros(len(rows), bool)

    def train(use: np.ndarray) -> np.ndarray:
        counts = np.full((2, SIZE), SMOOTHING)
        for i in use:
            counts[int(labels[i]), rows[i]] += 1
        ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
        sign = np.where(labels == 1, 1.0, -1.0)
        # Each class gets half of the total cost.
        cost = np.where(labels[use] == 1, COST * len(use) / 2 / max(1, (labels[use] == 1).sum()), COST * len(use) / 2 / max(1, (labels[use] == 0).sum()))
        values = []
        for i in use:
            v = ratio[rows[i]]
            values.append(v / max(np.sqrt((v * v).sum()), 1e-9))
        w, alpha, order = np.zeros(SIZE), np.zeros(len(use)), np.random.default_rng(11)
        for _ in range(EPOCHS):
            for j in order.permutation(len(use)):
                x, v, y = rows[use[j]], values[j], sign[use[j]]
                slope = y * (w[x] @ v) - 1.0
                new = min(max(alpha[j] - slope, 0.0), cost[j])
                if new != alpha[j]:
                    w[x] += (new - alpha[j]) * y * v
                    alpha[j] = new
        return np.concatenate([w, ratio])

    def margins(model: np.ndarray, use: np.ndarray) -> np.ndarray:
        return np.array([margin(rows[i], model[:SIZE], model[SIZE:]) for i in use])

    trial = train(np.flatnonzero(~held))
    test = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    m, y = margins(trial, test), labels[test].astype(float)
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps for the sigmoid, with a little shrinkage
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - y) * m).sum() + 0.01 * a, (p - y).sum() + 0.01 * b])
        s = p * (1 - p)
        h = np.array([[(s * m * m).sum() + 0.01, (s * m).sum()], [(s * m).sum(), s.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    full = train(np.arange(len(rows)))
    return full, float(a), float(b)


def margin(x: np.ndarray, w: np.ndarray, ratio: np.ndarray) -> float:
    """The model's margin; the scaled indicators have length 1."""
    v = ratio[x]
    return float(w[x] @ v / max(np.sqrt((v * v).sum()), 1e-9))


def _featurise(batches):
    for batch in batches:
        for part in K.slices(batch):
            rows = features(part)
            sizes = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(rows)) if rows else pa.array([], pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), lists], ["doc_id", "label", "features"])


def _fit_rows(table: pa.Table) -> pa.Table:
    ids, labels = table["doc_id"].to_numpy(), table["label"].to_numpy()
    lists = table["features"].combine_chunks()
    order = np.lexsort((labels, np.array([zlib.crc32(str(i).encode()) for i in ids], np.int64)))
    rows = [lists[int(i)].values.to_numpy() for i in order]
    model, a, b = fit(rows, labels[order])
    if len(model) == SIZE:
        model = np.concatenate([model, np.zeros(SIZE)])
    return pa.table({"model": pa.array([model.astype(np.float32).tobytes()], pa.binary()), "a": [a], "b": [b]})


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float, float]:
    """Fits on at most `sample_rows` of `labels` (doc_id, label 0 or 1), chosen by a hash of doc_id.

    The sample's size is fixed, so it may be broadcast to the scan of docs and
    fitted in one task; the driver only gets the model of fixed size."""
    labels = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = texts.mapInArrow(_featurise, "doc_id long, label int, features array<int>")
    rows = sample.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(_fit_rows, "model binary, a double, b double").collect()
    if not rows:
        return np.zeros(2 * SIZE, np.float32), 1.0, 0.0
    return np.frombuffer(rows[0].model, np.float32), rows[0].a, rows[0].b


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], name: str = "score") -> DataFrame:
    """`docs` with the column `name` (which it must not have), the probability of label 1 from the text alone, in one narrow pass."""
    weights, a, b = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w, ratio = shared.value[:SIZE].astype(np.float64), shared.value[SIZE:].astype(np.float64)
        for batch in batches:
            for part in K.slices(batch):
                m = np.array([margin(x, w, ratio) if len(x) else 0.0 for x in features(part)])
                p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
                yield part.append_column(name, pa.array(p, pa.float64()))

    fields = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, fields)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text; other columns are ignored).

    Learns from rows of `labels` (doc_id, label) whose crc32(doc_id as text) mod 5
    is not 0; null labels and labels other than 0 and 1 are ignored, of repeated
    ones the largest counts.  Null and empty texts have margin 0 and so the
    sigmoid's offset as score.  A null doc_id has held_out false.  Without
    labels every score is 0.5; no rows give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = train(docs, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "label").where(fold != 0))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
