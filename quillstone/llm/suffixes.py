"""Repeated byte strings between documents, from the collection's Burrows-Wheeler transform.

Windows of 50 bytes are gathered where equal ones must meet: every window is
filed under its anchor, the smallest-hashed 20-gram in it, so equal windows have
equal anchors, and a run of windows of one anchor is one short string.  Anchors
that only one document has are settled by a count.  Where very many documents
share an anchor, at the edges of a common passage each has a string of its own;
there a count of every window first cuts the strings to what some other document
has.  The strings then go to buckets by anchor; a bucket builds transform and common prefixes of its
collection column by column, and windows are equal where neighbouring suffixes
share 50 bytes.  A string's length is bounded by the window, so the number of
rounds is too, however long the documents are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import exchange as X
from quillstone.llm import kernel as K
from quillstone.llm.bwt import column_wise, suffixes

#: Bytes of an anchor.
ANCHOR = 20
#: Buckets of strings for each bucket of hashes, and collections of a bucket: one of a thousand or two strings
#: stays in a core's cache, where the rounds take a third of the time, and a chunk's share of a bucket is a list.
FINER, COLLECTIONS = 2, 24
#: An anchor that more chunks have is hot; below, a bucket gets the strings of so many chunks at most.
HOT_CHUNKS = 64
#: Kinds of answers: whether an anchor is shared, whether it is hot, whether a hot anchor's window is shared, and a
#: bit for each window of a string that a smaller doc_id has.
_SHARED, _HOT, _WINDOWS, _COVERED = 0, 1, 2, 3
#: Text bytes of a step, whose arrays stay in a core's cache.
STEP_BYTES = 1 << 17
STRINGS = "bucket int, chunk long, texts binary, sizes binary, ids binary, collections binary"


def anchored(data: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows with one anchor: its hash, first and last window start, the row, and a hash of the run's string."""
    none = np.zeros(0, np.int64)
    n = len(data) - window + 1
    if n <= 0:
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    up, down = K.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = sums[ANCHOR:] - sums[:-ANCHOR]
    hashes *= down[: len(hashes)]
    # Hash above, place below: the least of a window is its smallest hash, the leftmost of equal ones.
    least = hashes & np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(hashes), dtype=np.uint64)
    width, reach = window - ANCHOR + 1, 1
    while reach < width:
        step = min(reach, width - reach)
        least = np.minimum(least[step:], least[:-step])
        reach += step
    whole = np.zeros(len(data) + 1, np.int8)
    long = np.diff(at) >= window
    whole[at[:-1][long]] += 1
    whole[at[1:][long] - window + 1] -= 1
    starts = np.flatnonzero(np.cumsum(whole, dtype=np.int8)[:n] > 0)
    if not len(starts):
        return none.astype(np.uint64), none, none, none, none.astype(np.uint64)
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    # Mixed here: hashes that won as the least are small, and buckets are ranges.
    anchor, begin, end = K.mix(hashes[place[first]]), starts[first], starts[last]
    stop = end + window
    key = K.mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return anchor, begin, end, np.searchsorted(at, begin, "right") - 1, key


class _Chunk:
    """All runs of a chunk's documents, with byte offsets in the joined texts."""

    def __init__(self, batch: pa.RecordBatch, window: int):
        self.window = window
        parts, base, found = [], 0, []
        for row, part in X.each(batch, STEP_BYTES):
            data, at = K.utf8(part.column("text"))
            anchor, first, last, rows, key = anchored(data, at, window)
            found.append((anchor, first + base, last + base, rows + row, key))
            parts.append((data, at + base))
            base += len(data)
        self.data = np.concatenate([d for d, _ in parts]) if parts else np.zeros(0, np.uint8)
        self.at = np.concatenate([np.zeros(1, np.int64), *(a[1:] for _, a in parts)])
        self.anchor, self.first, self.last, self.row, self.key = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.uint64))

    def offer(self):
        order = np.argsort(self.anchor, kind="stable")
        hashes = self.anchor[order]
        _, cuts = X.runs(hashes)
        starts, ends = cuts[:-1], cuts[1:] - 1
        return hashes[starts], self.row[order[ends]] != self.row[order[starts]], order, starts

    def _of_runs(self, answers: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.anchor), bool)
        out[order] = np.repeat(answers, np.diff(np.append(starts, len(order))))
        return out

    def distinct(self, replies: pa.Table, buckets: int):
        """The runs with a shared anchor, the first run of each distinct string by document, each run's string, the
        document of a string's last run, and whether its anchor is hot."""
        hashes, _, order, starts = self.offer()
        hit = self._of_runs(X.answers(replies, _SHARED, hashes, buckets), order, starts)
        hot = self._of_runs(X.answers(replies, _HOT, hashes, buckets), order, starts)
        runs = np.flatnonzero(hit)
        order = np.lexsort((self.key[runs], self.anchor[runs]))  # stable: equal strings by document
        a, k = self.anchor[runs][order], self.key[runs][order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (k[1:] != k[:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        firsts, lasts = runs[order[heads]], runs[order[np.append(heads[1:], len(order)) - 1]] if len(heads) else runs
        return runs, firsts, group, self.row[lasts], hot[firsts]

    def windows(self, which: np.ndarray):
        """All windows of the strings of some runs: the string's number among them, the window's in it, and its hash."""
        counts = self.last[which] - self.first[which] + 1
        sizes = counts + self.window - 1
        owner = np.repeat(np.arange(len(which)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        joined = _gather(self.data, self.first[which], sizes)
        return owner, offset, K.rolling(joined, self.window)[(np.cumsum(sizes) - sizes)[owner] + offset]

    def pieces(self, replies: pa.Table, buckets: int):
        """What distinct() tells first, then the pieces of strings that are compared: string, first and last window,
        anchor; the first piece of each distinct one in order of anchor, and each piece's number among these.

        A string of a hot anchor is cut to its runs of windows that are shared; any other is a piece as a whole."""
        runs, firsts, group, _, hot = self.distinct(replies, buckets)
        cold, warm = np.flatnonzero(~hot), np.flatnonzero(hot)
        owner, offset, rolled = self.windows(firsts[warm])
        known, inverse = np.unique(rolled, return_inverse=True)
        kept = X.answers(replies, _WINDOWS, known, buckets)[inverse]
        together = kept[1:] & kept[:-1] & (owner[1:] == owner[:-1])
        heads, tails = np.flatnonzero(kept & ~np.append(False, together)[: len(kept)]), np.flatnonzero(kept & ~np.append(together, False)[: len(kept)])
        # The first and the last window cover a piece, so their hashes stand for it.
        cut_key = K.mix(rolled[heads] * np.uint64(0xD6E8FEB86659FD93) + rolled[tails] + (tails - heads).astype(np.uint64))
        string = np.concatenate([cold, warm[owner[heads]]])
        low = np.concatenate([np.zeros(len(cold), np.int64), offset[heads]])
        high = np.concatenate([(self.last - self.first)[firsts[cold]], offset[tails]])
        anchor, key = self.anchor[firsts[string]], np.concatenate([self.key[firsts[cold]], cut_key])
        order = np.lexsort((self.row[firsts[string]], key, anchor))
        a, k = anchor[order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (a[1:] != a[:-1]) | (k[1:] != k[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return runs, firsts, group, (string, low, high, anchor), order[new], number


def _offer(window: int, buckets: int):
    def run(batch: pa.RecordBatch, chunk: int) -> pa.Table:
        hashes, many, _, _ = _Chunk(batch, window).offer()
        return X.offer(chunk, hashes, np.ones(len(hashes), bool), many, buckets)

    return run


def _window_offer(window: int, buckets: int):
    """The windows of strings with hot anchors, each with whether two documents of the chunk have it."""

    def run(batch: pa.RecordBatch, chunk: int, replies: pa.Table) -> pa.Table:
        none = np.zeros(0, bool)
        if not pa.compute.any(pa.compute.equal(replies["kind"], _HOT)).as_py():
            return X.offer(chunk, none.astype(np.uint64), none, none, buckets)
        c = _Chunk(batch, window)
        _, firsts, _, last_row, hot = c.distinct(replies, buckets)
        owner, _, rolled = c.windows(firsts[hot])
        known, inverse = np.unique(rolled, return_inverse=True)
        low, high = np.full(len(known), len(c.at)), np.full(len(known), -1)
        np.minimum.at(low, inverse, c.row[firsts[hot]][owner])
        np.maximum.at(high, inverse, last_row[hot][owner])
        return X.offer(chunk, known, np.ones(len(known), bool), low < high, buckets)

    return run


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return data[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


def _strings(window: int, buckets: int):
    def run(batch: pa.RecordBatch, chunk: int, replies: pa.Table) -> pa.Table:
        c = _Chunk(batch, window)
        _, firsts, _, (string, low, high, anchor), lead, _ = c.pieces(replies, buckets)
        first = firsts[string[lead]]
        ids = X.rank_ids(batch)[c.row[first]]
        sizes = (high - low)[lead] + window
        fine = X.bucket_of(anchor[lead], buckets * FINER * COLLECTIONS)
        used, cuts = X.runs(fine // np.uint64(COLLECTIONS))
        # Each string's bytes follow those of the one before, so the cuts of the texts are sums of sizes.
        texts = X.packed(_gather(c.data, c.first[first] + low[lead], sizes), np.concatenate([[0], np.cumsum(sizes)])[cuts])
        return X.rows(chunk, used, texts=texts, sizes=X.packed(sizes.astype(np.uint8), cuts), ids=X.packed(ids, cuts), collections=X.packed((fine % np.uint64(COLLECTIONS)).astype(np.uint8), cuts))

    return run


def _covered(text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """A bit for each window of each string of a collection that a string of a smaller doc_id has too."""
    joined = _gather(text, starts, sizes)
    ends = np.cumsum(sizes)
    _, first, inverse = np.unique(K.span_hashes(joined, ends - sizes, ends), return_index=True, return_inverse=True)
    if (sizes[first][inverse] != sizes).any() or (_gather(text, starts[first][inverse], sizes) != joined).any():
        first = inverse = np.arange(len(ids))  # a hash of two strings: nothing is merged, and the transform finds what is equal
    order = np.argsort(inverse, kind="stable")
    owner = np.minimum.reduceat(ids[order], np.searchsorted(inverse[order], np.arange(len(first))))
    own, begin = sizes[first], (ends - sizes)[first]
    # The alphabet is pairs of bytes: half the rounds.  A string enters twice, whole and without its last
    # byte, so that every window begins at a symbol of one of the two.
    pairs = (joined[:-1].astype(np.uint16) << 8) | joined[1:]
    odd = np.repeat([0, 1], len(own))
    length_of, start_of = np.tile(own, 2) - odd, np.tile(begin, 2)
    count = length_of // 2
    start_of = start_of + (length_of & 1)
    where = np.repeat(start_of - 2 * (np.cumsum(count) - count), count) + 2 * np.arange(count.sum())
    bwt, common, _ = column_wise(pairs[where], np.concatenate([[0], np.cumsum(count)]), cap=window // 2)
    string, length = suffixes(bwt, count)
    heads = np.flatnonzero(common < window // 2)  # neighbours that share a window are one group; the first has no neighbour
    full = length >= window // 2
    least = np.repeat(np.minimum.reduceat(np.where(full, np.tile(owner, 2)[string], np.iinfo(np.int64).max), heads), np.diff(np.append(heads, len(string))))
    width = int(own.max()) - window + 1
    smallest = np.full((len(first), width), np.iinfo(np.int64).max)
    smallest[string[full] % len(own), length_of[string[full]] - 2 * length[full]] = least[full]
    bits = np.zeros(len(ids), np.uint32)
    for offset in range(width):
        bits |= (smallest[inverse, offset] < ids).astype(np.uint32) << np.uint32(offset)
    return bits


def _repeats(window: int):
    """A bucket's answers, collection by collection."""

    def run(table: pa.Table) -> pa.Table:
        get = lambda c, t: [np.frombuffer(x.as_buffer(), t) for x in table[c]]
        sizes = get("sizes", np.uint8)
        lengths = [len(x) for x in sizes]
        text, sizes, ids = np.concatenate(get("texts", np.uint8)), np.concatenate(sizes).astype(np.int64), np.concatenate(get("ids", np.int64))
        starts = np.cumsum(sizes) - sizes
        collection = np.concatenate(get("collections", np.uint8))
        bits = np.zeros(len(ids), np.uint32)
        for number in range(COLLECTIONS):
            which = np.flatnonzero(collection == number)
            if len(which):
                bits[which] = _covered(text, starts[which], sizes[which], ids[which], window)
        return X.reply(table, _COVERED, np.split(bits, np.cumsum(lengths)[:-1]))

    return run


def _cleaned(window: int, buckets: int):
    def run(batch: pa.RecordBatch, chunk: int, replies: pa.Table) -> pa.Table:
        c = _Chunk(batch, window)
        runs, firsts, group, (string, low, high, anchor), lead, number = c.pieces(replies, buckets)
        cover = np.zeros(len(c.data) + window + 1, np.int8)  # at most one window starts at a byte, so counts stay below window
        if len(runs):
            every, ids = np.uint32(0xFFFFFFFF), X.rank_ids(batch)
            bits = X.answers(replies, _COVERED, anchor[lead], buckets * FINER, np.uint32)[number]
            own = ids[c.row[firsts]]
            # A piece or a string that a smaller doc_id of this chunk has too is covered as a whole.
            bits = np.where(own[string] > own[string[lead]][number], every, bits) & (every >> (31 - high + low).astype(np.uint32))
            mask = np.zeros(len(firsts), np.uint32)
            np.bitwise_or.at(mask, string, bits << low.astype(np.uint32))
            bits = np.where(ids[c.row[runs]] > own[group], every, mask[group])
            first, last = c.first[runs], c.last[runs]
            for offset in range(window - ANCHOR + 1):
                at = first + offset
                at = at[(bits >> np.uint32(offset) & np.uint32(1)).astype(bool) & (at <= last)]
                cover[at] += 1  # a window start is in one run only
                cover[at + window] -= 1
        gone = np.cumsum(cover, dtype=np.int8)[: len(c.data)] > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        heads = c.at[:-1][c.at[:-1] < len(gone)]
        edge[heads] = gone[heads]
        removed, spans = np.searchsorted(np.flatnonzero(gone), c.at), np.searchsorted(np.flatnonzero(edge), c.at)
        offsets = c.at - removed
        kept = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(c.data[~gone].tobytes())])
        return pa.table({
            "doc_id": batch.column("doc_id").cast(pa.int64()), "n_bytes": pa.array(np.diff(c.at), pa.int64()), "n_removed": pa.array(np.diff(removed), pa.int64()),
            "n_spans": pa.array(np.diff(spans), pa.int64()), "kept_bytes": kept.cast(pa.binary()),
        })

    return run


def suffix_dedup(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_bytes (binary: the remaining bytes concatenated).

    One row per row of `docs` (doc_id, text; other columns are ignored).  A byte
    goes if a string of `window` bytes over it also starts in a document of a
    smaller doc_id; strings are judged on the input and never cross documents.
    A null text is empty; a null doc_id counts as larger than all others; rows
    of one doc_id take nothing from each other.  No rows give no rows.
    `window` is even and 22 to 50, as a string has at most 32 windows; others are an error.
    """
    if window % 2 or not ANCHOR + 2 <= window <= 50:
        raise ValueError(f"a window is even and {ANCHOR + 2} to 50, not {window}")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt, buckets = X.deal(docs)
    hits = X.ask(dealt, _offer(window, buckets), X.shared(_SHARED, HOT_CHUNKS, _HOT))
    windows = X.with_replies(dealt, hits, _window_offer(window, buckets), X.OFFER).groupBy("bucket").applyInArrow(X.shared(_WINDOWS), X.REPLY)
    known = hits.union(windows)
    strings = X.with_replies(dealt, known, _strings(window, buckets), STRINGS)
    found = strings.groupBy("bucket").applyInArrow(_repeats(window), X.REPLY)
    return X.with_replies(dealt, known.union(found), _cleaned(window, buckets), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_bytes binary")
