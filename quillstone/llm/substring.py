"""Repeated word passages by fixed-block anchors.

Every document's words are cut into non-overlapping blocks of half a window's
length; the blocks are the index.  Every rolling block-long run of words probes
it.  A window of twice the block's length contains a whole block of any place
where its words stand, wherever that place's blocks begin, so a window without
a hit cannot repeat.  Hits are extended to windows: all windows around a hit
meet by a 96-bit hash of their words, the earliest place wins, and the
remaining windows of a document unite to maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import exchange as X
from quillstone.llm import kernel as K

#: Kinds of answers: whether a block is shared, and whether a window's place is its first.
_HITS, _FIRST = 0, 1
PLACES = "bucket int, chunk long, hashes binary, others binary, ids binary, starts binary"


def _rolling(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    if len(words) < k:
        return np.zeros(0, np.uint64)
    c, acc = np.uint64(0xA24BAED4963EE407 + 2 * seed), words[: len(words) - k + 1] + np.uint64(seed)
    for i in range(1, k):
        acc = acc * c + words[i : len(words) - k + 1 + i]
    return K.mix(acc)


def _planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second bytes and so on: planes that are alike compress well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _values(raw, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


class _Chunk:
    """Words of a chunk's documents, all rolling block hashes, and which of them are whole."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.window, self.block = window, window // 2
        words, counts, self.parts = [], [], []
        for _, part in X.each(batch):
            data, at = K.utf8(part.column("text"))
            starts, ends, rows = K.word_bounds(data, at)
            words.append(K.span_hashes(data, starts, ends))
            counts.append(np.diff(rows))
            self.parts.append((part, starts, ends, rows))
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.rows = np.concatenate([[0], np.cumsum(self.counts)])
        self.row_of = np.repeat(np.arange(len(self.counts)), self.counts)
        self.left = self.rows[1:][self.row_of] - np.arange(len(self.words))  # words to the document's end
        rolled = _rolling(self.words, self.block, 1)
        self.probes = np.flatnonzero(self.left[: len(rolled)] >= self.block)
        self.hashes, first, self.inverse, counts = np.unique(rolled[self.probes], return_index=True, return_inverse=True, return_counts=True)
        del first
        self.many = counts > 1
        aligned = (self.probes - self.rows[self.row_of[self.probes]]) % self.block == 0
        self.indexed = np.zeros(len(self.hashes), bool)
        self.indexed[self.inverse[aligned]] = True

    def windows(self, replies: pa.Table, buckets: int):
        """Starts of the windows with a hit, and of each its first equal one (by document and start) in this chunk."""
        hit = X.answers(replies, _HITS, self.hashes, buckets)[self.inverse]
        near = np.zeros(len(self.words) + 1, np.int32)
        at = self.probes[hit]
        np.add.at(near, np.maximum(at - (self.window - self.block), 0), 1)
        np.add.at(near, at + 1, -1)
        starts = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (self.left >= self.window))
        if not len(starts):
            none = np.zeros(0, np.uint64)
            return starts, none, none.astype(np.uint32), none.astype(np.int64), none.astype(np.int64)
        one, two = _rolling(self.words, self.window, 2)[starts], _rolling(self.words, self.window, 3)[starts].astype(np.uint32)
        order = np.lexsort((two, one))  # stable: equal windows stay in the order of documents and starts
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        firsts = order[new]
        return starts, one[firsts], two[firsts], group, firsts


def _offer(window: int, buckets: int):
    def run(batch: pa.RecordBatch, chunk: int) -> pa.Table:
        c = _Chunk(batch, window)
        return X.offer(chunk, c.hashes, c.indexed, c.many, buckets)

    return run


def _places(window: int, buckets: int):
    """The windows near hits of a chunk, each distinct one with its first place."""

    def run(batch: pa.RecordBatch, chunk: int, replies: pa.Table) -> pa.Table:
        c = _Chunk(batch, window)
        starts, one, two, _, firsts = c.windows(replies, buckets)
        at = starts[firsts]
        row = c.row_of[at] if len(at) else at
        ids, offsets = X.rank_ids(batch)[row], (at - c.rows[row]).astype(np.int32)
        used, cuts = X.runs(X.bucket_of(one, buckets))
        pack = lambda x: pa.array([_planes(x[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
        return X.rows(chunk, used, hashes=pack(one), others=pack(two), ids=pack(ids), starts=pack(offsets))

    return run


def _earliest(table: pa.Table) -> pa.Table:
    """For each offered window, whether no equal one has an earlier place."""
    get = lambda c, t: [_values(x.as_buffer(), t) for x in table[c]]
    one = get("hashes", np.uint64)
    sizes = [len(x) for x in one]
    one, two, ids, starts = np.concatenate(one), np.concatenate(get("others", np.uint32)), np.concatenate(get("ids", np.int64)), np.concatenate(get("starts", np.int32))
    order = np.lexsort((starts, ids, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # of each, the earliest equal one
    first = np.empty(len(order), bool)
    first[order] = (ids[lead] == ids[order]) & (starts[lead] == starts[order])
    return X.reply(table, _FIRST, [np.packbits(x) for x in np.split(first, np.cumsum(sizes)[:-1])])


def _cleaned(window: int, buckets: int):
    def run(batch: pa.RecordBatch, chunk: int, replies: pa.Table) -> pa.Table:
        c = _Chunk(batch, window)
        starts, one, _, group, firsts = c.windows(replies, buckets)
        repeated = np.zeros(len(starts), bool)
        if len(starts):
            first = X.answers(replies, _FIRST, one, buckets)
            ids, row = X.rank_ids(batch), c.row_of[starts]
            lead = starts[firsts][group]
            # The chunk's first place stands if the bucket says so, and with it equal rows' same places.
            own = (ids[row] == ids[c.row_of[lead]]) & (starts - c.rows[row] == lead - c.rows[c.row_of[lead]])
            repeated = ~(first[group] & own)
        cover = np.zeros(len(c.words) + window + 1, np.int32)
        cover[starts[repeated]] += 1
        np.subtract.at(cover, starts[repeated] + window, 1)
        gone = np.cumsum(cover)[: len(c.words)] > 0
        texts, removed, spans, base = [], [], [], 0
        for part, begins, ends, rows in c.parts:
            data, at = K.utf8(part.column("text"))
            kept = ~gone[base : base + len(begins)]
            mask, values = np.zeros(len(data) + 1, np.int8), data.copy()
            mask[begins[kept]] += 1
            mask[ends[kept]] -= 1
            keep = np.cumsum(mask)[:-1] > 0
            number = np.cumsum(kept) - np.concatenate([[0], np.cumsum(kept)])[rows[:-1]].repeat(np.diff(rows))
            gaps = begins[kept & (number > 1)] - 1
            keep[gaps], values[gaps] = True, 0x20
            offsets = np.concatenate([[0], np.cumsum(keep)])[at]
            texts.append(pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(values[keep].tobytes())]).cast(pa.binary()))
            total = np.concatenate([[0], np.cumsum(~kept)])
            removed.append(total[rows[1:]] - total[rows[:-1]])
            edge = gone[base : base + len(begins)].copy()
            edge[1:] &= ~gone[base : base + len(begins)][:-1] | np.isin(np.arange(1, len(edge)), rows)
            total = np.concatenate([[0], np.cumsum(edge)])
            spans.append(total[rows[1:]] - total[rows[:-1]])
            base += len(begins)
        return pa.table({
            "doc_id": batch.column("doc_id").cast(pa.int64()), "n_words": pa.array(c.counts, pa.int64()), "n_removed": pa.array(np.concatenate(removed) if removed else [], pa.int64()),
            "n_spans": pa.array(np.concatenate(spans) if spans else [], pa.int64()), "kept_text": pa.chunked_array(texts, pa.binary()),
        })

    return run


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_text (binary UTF-8: the kept words joined by one space).

    One row per row of `docs` (doc_id, text; other columns are ignored).  A word
    goes if a window of `window` (even) words over it also starts earlier: in a
    smaller doc_id, or in the same document further ahead.  Windows are judged
    on the input.  A null text has no words; a null doc_id counts as larger than
    all others; rows of one doc_id count as one document, and of windows at the
    same start in them none is the earlier.  No rows give no rows.
    """
    if window % 2 or window < 2:
        raise ValueError(f"a window is an even number of words, not {window}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt, buckets = X.deal(docs)
    hits = X.ask(dealt, _offer(window, buckets), X.shared(_HITS))
    places = X.with_replies(dealt, hits, _places(window, buckets), PLACES)
    first = places.groupBy("bucket").applyInArrow(_earliest, X.REPLY)
    return X.with_replies(dealt, hits.union(first), _cleaned(window, buckets), "doc_id long, n_words long, n_removed long, n_spans long, kept_text binary")
