"""Set questions between chunks of documents, asked and answered as packed arrays.

Documents are dealt into chunks of a few megabytes.  A chunk offers its distinct
64-bit hashes once, split by hash into buckets; a bucket answers each chunk with
one value for each of its hashes, in the order of the offer.  A hash that very
many documents share thus travels once per chunk, not once per occurrence, and
no row is longer than a chunk's share of a bucket.  What a chunk does depends on
its own hashes only: it never visits buckets that it has nothing for.

The shuffle that deals the documents is part of one plan, so Spark reuses its
files wherever the chunks are read again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K

#: Text bytes of a chunk, and for which there is one bucket.  Beyond LEVEL_BYTES of text both grow with its square
#: root, up to the factors, so that a chunk's share of a bucket stays a list of hashes.
CHUNK_BYTES, BUCKET_BYTES, LEVEL_BYTES = 4 << 20, 12 << 20, 64 << 30
CHUNK_GROWTH, BUCKET_GROWTH = 4, 8
#: A hash within its bucket takes 30 bits; above them stand "indexed" and "in two places of this chunk".
LOW, INDEXED, MANY = np.uint32((1 << 30) - 1), np.uint32(1 << 30), np.uint32(1 << 31)
OFFER = "bucket int, chunk long, hashes binary"
REPLY = "chunk long, bucket int, kind int, bits binary"


def sizes(total: int) -> tuple[int, int]:
    """Numbers of chunks and buckets for so many text bytes."""
    level = max(1.0, (total / LEVEL_BYTES) ** 0.5)
    chunk, bucket = int(CHUNK_BYTES * min(CHUNK_GROWTH, level)), int(BUCKET_BYTES * min(BUCKET_GROWTH, level))
    return max(8, -(-total // chunk)), max(8, -(-total // bucket))


def deal(docs: DataFrame) -> tuple[DataFrame, int]:
    """`docs` (doc_id, text) with chunk, by a hash of both columns, and the number of buckets for them."""
    chunks, buckets = sizes(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks))), buckets


def ordered(table: pa.Table) -> pa.RecordBatch:
    """The documents of a chunk by doc_id (nulls last) and text: the same order at every reading."""
    table = table.select(["doc_id", "text"]).combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return table.combine_chunks().to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def rank_ids(batch: pa.RecordBatch) -> np.ndarray:
    """doc_ids as int64; a null counts as the largest."""
    return batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False).astype(np.int64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: an equal range of its upper half."""
    return (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def runs(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of an ascending list, and where each begins, with the end of the list."""
    if not len(buckets):
        return buckets, np.zeros(1, np.int64)
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
    return buckets[starts], np.append(starts, len(buckets))


def packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values between the cuts as one binary each, without a copy of each."""
    values = np.ascontiguousarray(values)
    offsets = cuts * values.itemsize
    if len(values) * values.itemsize < 1 << 31:
        return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.view(np.uint8) if len(values) else b"")])
    raw = values.view(np.uint8)
    return pa.array([raw[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())


def rows(chunk: int, used: np.ndarray, **columns: pa.Array) -> pa.Table:
    return pa.table({"bucket": pa.array(used.astype(np.int32)), "chunk": pa.array(np.full(len(used), chunk or 0, np.int64)), **columns})


def offer(chunk: int, hashes: np.ndarray, indexed: np.ndarray, many: np.ndarray, buckets: int) -> pa.Table:
    """The offer of sorted distinct hashes: 30 bits of them suffice within a bucket (a false
    match has probability 2**-10 or so and is found out later), with two flags each."""
    used, cuts = runs(bucket_of(hashes, buckets))
    low = hashes.astype(np.uint32) & LOW
    low |= np.where(indexed, INDEXED, np.uint32(0)) | np.where(many, MANY, np.uint32(0))
    return rows(chunk, used, hashes=packed(low, cuts))


def shared(kind: int = 0, hot: int | None = None, hot_kind: int = 1) -> Callable[[pa.Table], pa.Table]:
    """A bucket's answers: whether a hash is indexed somewhere and occurs in two places
    at least, which are two chunks or one that says so; with `hot`, in answers of another
    kind, whether more chunks than that offer it."""

    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table["hashes"]]
        offered, cuts = np.concatenate(parts), np.cumsum([len(p) for p in parts])[:-1]
        _, inverse, counts = np.unique(offered & LOW, return_inverse=True, return_counts=True)
        indexed, many = np.zeros(len(counts), bool), counts > 1
        indexed[inverse[offered & INDEXED > 0]] = True
        many[inverse[offered & MANY > 0]] = True
        out = reply(table, kind, [np.packbits(a) for a in np.split((indexed & many)[inverse], cuts)])
        if hot is None:
            return out
        often = np.split((counts > hot)[inverse], cuts)
        some = np.array([x.any() for x in often])
        return pa.concat_tables([out, reply(table.filter(pa.array(some)), hot_kind, [np.packbits(x) for x in often if x.any()])])

    return run


def reply(table: pa.Table, kind: int, answers: list[np.ndarray]) -> pa.Table:
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "kind": pa.array([kind] * table.num_rows, pa.int32()), "bits": pa.array([a.tobytes() for a in answers], pa.binary())})


def answers(table: pa.Table, kind: int, hashes: np.ndarray, buckets: int, as_type=None) -> np.ndarray:
    """The answers of one kind for the sorted hashes that the chunk offered: bits, or values of a type."""
    used, cuts = runs(bucket_of(hashes, buckets))
    out = np.zeros(len(hashes), as_type or bool)
    table = table.filter(pa.compute.equal(table["kind"], kind))
    for at, bits in zip(np.searchsorted(used, table["bucket"].to_numpy()).tolist(), table["bits"], strict=True):
        raw = np.frombuffer(bits.as_buffer(), as_type or np.uint8)
        out[cuts[at] : cuts[at + 1]] = raw if as_type else np.unpackbits(raw)[: cuts[at + 1] - cuts[at]]
    return out


def ask(dealt: DataFrame, make_offer: Callable, answer: Callable) -> DataFrame:
    """The answers to the offers that make_offer(batch, chunk) makes of each chunk."""

    def run(table: pa.Table) -> pa.Table:
        return make_offer(ordered(table), table["chunk"][0].as_py())

    return dealt.groupBy("chunk").applyInArrow(run, OFFER).groupBy("bucket").applyInArrow(answer, REPLY)


def with_replies(dealt: DataFrame, replies: DataFrame, use: Callable, schema: str) -> DataFrame:
    """use(batch, chunk, replies) for each chunk that has documents."""
    empty = dealt.sparkSession.createDataFrame([], schema)
    names = empty.columns

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return use(ordered(left), left["chunk"][0].as_py() if left.num_rows else None, right).select(names)

    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def each(batch: pa.RecordBatch, limit: int = K.STEP_BYTES):
    """(first row, slice) of the steps of a chunk."""
    first = 0
    for part in K.slices(batch, limit=limit):
        yield first, part
        first += part.num_rows
