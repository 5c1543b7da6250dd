"""Benchmark passages in documents, by SimHash of item-sized windows.

A window of as many words as an item has is reduced to a 256-bit fingerprint of
its shingles.  Items of one size are filed by every 16-bit block of theirs, with
all values one bit away, and a window asks for its own blocks with all values one
bit away: whatever differs by two bits at most in some block is found, and so is
every fingerprint within RADIUS bits.  Where a shingle repeats in the window or
the item, a count of shared shingles finds the item instead.  The weighted
Jaccard similarity of the shingle counts then decides exactly.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K

#: Bits of a fingerprint in words of 64, blocks of 16 bits, and the radius that they guarantee: of RADIUS differing
#: bits some block has two at most.  Two windows of similarity 0.8 and distinct shingles differ in 39 bits on
#: average, and all sixteen blocks in three bits or more with probability 3e-6.  An unrelated pair passes with
#: probability 0.03.  None of this holds for repeated shingles, whose votes add up; these are found by counts.
WORDS = 4
BLOCKS = 4 * WORDS
RADIUS = 3 * BLOCKS - 1
#: Most bytes of item texts whose index, some 30 times as large, is broadcast at a time; more items take more passes.
ITEM_BYTES = 4 << 20
#: A block value itself and with any one bit changed; and shingles that vote at a time.
_NEAR = np.array([0, *(1 << b for b in range(16))], np.uint32)
_VOTES = 1 << 14


def fingerprints(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash blocks (n, BLOCKS), 16 bits each, of the `width` shingles from each of the ascending starts; a
    shingle weighs as often as it occurs."""
    out = np.empty((len(starts), 8 * WORDS), np.uint8)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(starts, base + max(_VOTES, width))))
        own, rows = shingles[base : int(starts[last - 1]) + width], starts[first:last] - base
        for word in range(WORDS):
            bits = np.unpackbits(K.mix(own + np.uint64(0x9E3779B97F4A7C15 * (word + 1) & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8), axis=1)
            sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
            out[first:last, 8 * word : 8 * word + 8] = np.packbits(2 * (sums[rows + width] - sums[rows]) > width, axis=1)
        first = last
    return out.view(np.uint16)


class _Tables:
    """The multi-index of the items of one size: (block, value) -> items, also for values one bit away."""

    def __init__(self, members: np.ndarray, prints: np.ndarray):
        self.members, self.prints = members, prints
        keys = _keys(prints).ravel()
        owner = np.repeat(np.arange(len(members), dtype=np.int32), BLOCKS * len(_NEAR))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, member) that some block brings together, each once."""
        asked = _keys(prints).ravel()
        low, high = np.searchsorted(self.keys, asked, "left"), np.searchsorted(self.keys, asked, "right")
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        at = np.repeat(low[hit] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        pairs = np.unique(np.repeat(hit // (BLOCKS * len(_NEAR)), counts) * len(self.members) + self.owner[at])
        return pairs // len(self.members), pairs % len(self.members)


def _keys(prints: np.ndarray) -> np.ndarray:
    """(n, BLOCKS, 17): block number and value of all blocks, as they are and with one bit changed."""
    return (prints.astype(np.uint32)[:, :, None] ^ _NEAR) | (np.arange(BLOCKS, dtype=np.uint32) << np.uint32(16))[None, :, None]


class Items:
    """The index of a bounded set of items: their shingles, and the multi-index of their fingerprints by size.

    `seen` counts windows, pairs of a window and an item of its size, and pairs that the multi-index lets pass."""

    def __init__(self, ids: list[int], texts: list[str], k: int):
        self.k, self.ids, self.seen = k, ids, np.zeros(3, np.int64)
        batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
        data, at = K.utf8(batch.column("text"))
        data = K.LOWER[data]
        starts, ends, rows = K.word_bounds(data, at)
        words = K.span_hashes(data, starts, ends)
        self.sizes = np.diff(rows)
        self.counts: list[Counter] = []
        self.by_size: dict[int, _Tables] = {}
        groups = defaultdict(list)
        for i, size in enumerate(self.sizes.tolist()):
            own = rolling(words[rows[i] : rows[i + 1]], min(k, size)) if size else np.zeros(0, np.uint64)
            self.counts.append(Counter(own.tolist()))
            if size:
                groups[size].append((i, fingerprints(own, np.zeros(1, np.int64), len(own))[0]))
        for size, members in groups.items():
            self.by_size[size] = _Tables(np.array([i for i, _ in members]), np.array([f for _, f in members]))
        self.short = sorted({s for s in self.by_size if s < k})
        # Postings: the distinct shingles in order, where each one's items begin, and the items.
        shingles = np.array([x for c in self.counts for x in c], np.uint64)
        owners = np.repeat(np.arange(len(self.counts), dtype=np.int32), [len(c) for c in self.counts])
        order = np.argsort(shingles, kind="stable")
        self.known, begins = np.unique(shingles[order], return_index=True)
        self.begins, self.owners = np.append(begins, len(order)), owners[order]

    def search(self, words: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int]]:
        """Item -> (similarity, first word, words) of its best window in one document."""
        best: dict[int, tuple[float, int, int]] = {}
        if not len(self.known):
            return best
        for k in [*self.short, self.k]:
            shingles = rolling(words, min(k, max(1, len(words))))
            if k < self.k and len(words) < k or not len(shingles):
                continue
            at = np.searchsorted(self.known, shingles)
            hits = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == shingles)
            if not len(hits):
                continue
            where: dict[int, list[int]] = defaultdict(list)
            for h in hits.tolist():
                for i in self.owners[self.begins[at[h]] : self.begins[at[h] + 1]].tolist():
                    where[i].append(h)
            for size in {int(self.sizes[i]) for i in where}:
                if min(size, self.k) != min(k, self.k) and len(words) >= self.k:
                    continue
                self._windows(words, shingles, hits, where, size, threshold, best)
        return best

    def _windows(self, words, shingles, hits, where, size, threshold, best) -> None:
        window = min(size, len(words))  # a document shorter than the item is one window
        k = len(words) - len(shingles) + 1
        width = window - k + 1
        if width < 1:
            return
        # Only windows that share a shingle with an item can be similar to it.
        near = np.zeros(len(shingles) + 1, np.int32)
        np.add.at(near, np.maximum(hits - width + 1, 0), 1)
        np.add.at(near, hits + 1, -1)
        starts = np.flatnonzero(np.cumsum(near)[:-1] > 0)
        starts = starts[starts <= len(shingles) - width]
        if not len(starts):
            return
        tables = self.by_size[size]
        members = tables.members
        again, counted = repeats(shingles)[starts] < starts + width, {}
        for j, item in enumerate(members.tolist()):
            if item not in where:
                continue
            total = self.counts[item].total()
            either = again | (len(self.counts[item]) < total)
            if either.any():
                # The intersection is at most the number of the window's shingles that the item has.
                shared = np.zeros(len(shingles) + 1, np.int64)
                shared[np.array(where[item]) + 1] = 1
                shared = np.cumsum(shared)
                counted[j] = np.flatnonzero(either & ((shared[starts + width] - shared[starts]) * (1 + threshold) >= threshold * (width + total) - 1e-6))
        for first in range(0, len(starts), _VOTES):
            part = starts[first : first + _VOTES]
            w, j = tables.near(fingerprints(shingles, part, width))
            self.seen += [len(part), len(part) * len(members), len(w)]
            pairs = set(zip((w + first).tolist(), j.tolist(), strict=True))
            for other, windows in counted.items():
                pairs |= {(x, other) for x in windows[(windows >= first) & (windows < first + _VOTES)].tolist()}
            self._verify(shingles, starts, width, window, members, sorted(pairs), threshold, best)

    def _verify(self, shingles, starts, width, window, members, pairs, threshold, best) -> None:
        for w, j in pairs:
            item, start = int(members[j]), int(starts[w])
            own = Counter(shingles[start : start + width].tolist())
            both = sum((own & self.counts[item]).values())
            similarity = both / (width + self.counts[item].total() - both)
            if similarity >= threshold and similarity > best.get(item, (0.0,))[0]:
                best[item] = (similarity, start, window)


def repeats(shingles: np.ndarray) -> np.ndarray:
    """For each position, where the first shingle that repeats one from there on stands, or a number beyond all."""
    order = np.argsort(shingles, kind="stable")
    same = shingles[order[1:]] == shingles[order[:-1]]
    following = np.full(len(shingles), np.iinfo(np.int64).max)
    following[order[:-1][same]] = order[1:][same]
    return np.minimum.accumulate(following[::-1])[::-1]


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words."""
    if k < 1 or len(words) < k:
        return np.zeros(0, np.uint64)
    acc = words[: len(words) - k + 1] + np.uint64(k)
    for i in range(1, k):
        acc = acc * np.uint64(0xA24BAED4963EE407) + words[i : len(words) - k + 1 + i]
    return K.mix(acc)


def _found(items: Items, part: pa.RecordBatch, threshold: float) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
    """The rows of the slice (column text) that may hold a passage, each with its search."""
    data, at = K.utf8(part.column("text"))
    data = K.LOWER[data]
    starts, ends, rows = K.word_bounds(data, at)
    words = K.span_hashes(data, starts, ends)
    # One pass over all rows tells which have any shingle of an item.
    touched = np.zeros(part.num_rows, bool)
    for k in [*items.short, items.k]:
        found = rolling(words, k)
        if len(found) and len(items.known):
            spot = np.minimum(np.searchsorted(items.known, found), len(items.known) - 1)
            touched[np.searchsorted(rows, np.flatnonzero(items.known[spot] == found), "right") - 1] = True
    if len(items.known):
        touched |= np.diff(rows) < items.k
    for r in np.flatnonzero(touched).tolist():
        if rows[r] < rows[r + 1]:
            yield r, items.search(words[rows[r] : rows[r + 1]], threshold)


def _scan(shared, threshold: float):
    def run(batches):
        items: Items = shared.value
        for batch in batches:
            for part in K.slices(batch):
                ids, out = part.column("doc_id").to_pylist(), []
                for r, best in _found(items, part, threshold):
                    out += [(ids[r], items.ids[i], s, a, n) for i, (s, a, n) in best.items()]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def _clean(shared, threshold: float):
    def run(batches):
        for batch in batches:
            for part in K.slices(batch):
                keep = np.ones(part.num_rows, bool)
                for r, best in _found(shared.value, part, threshold):
                    keep[r] = not best
                yield part.filter(pa.array(keep))

    return run


class _Shared:
    """A broadcast index, loaded once in a worker process."""

    _loaded: tuple[int, Items] | None = None

    def __init__(self, broadcast):
        self.broadcast, self.number = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return {"broadcast": self.broadcast, "number": self.number}

    @property
    def value(self) -> Items:
        if _Shared._loaded is None or _Shared._loaded[0] != self.number:
            _Shared._loaded = self.number, pickle.loads(self.broadcast.value)
        return _Shared._loaded[1]


def _built(k: int):
    """The index of a block of items, made in a task of its own."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item_id", "ascending"), ("text", "ascending")])
        index = Items(table["item_id"].to_pylist(), table["text"].to_pylist(), k)
        return pa.table({"block": table["block"][:1], "index": pa.array([pickle.dumps(index, pickle.HIGHEST_PROTOCOL)], pa.binary())})

    return run


def _indexes(docs: DataFrame, items: DataFrame, k: int) -> Iterator[_Shared]:
    """Broadcast indexes of the items, of at most about ITEM_BYTES of texts each.  Tasks build them; the driver only
    passes on one after the other."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) // ITEM_BYTES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    some = False
    for row in dealt.groupBy("block").applyInArrow(_built(k), "block int, index binary").toLocalIterator():
        some = True
        yield _Shared(docs.sparkSession.sparkContext.broadcast(bytes(row["index"])))
    if not some:
        yield _Shared(docs.sparkSession.sparkContext.broadcast(pickle.dumps(Items([], [], k))))


def find_leaks(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each document for each item
    with a weighted Jaccard similarity of k-word shingle counts of at least `threshold`.

    `docs` has doc_id and text, `items` item_id and text; other columns are
    ignored.  Words are ASCII lower-cased.  An item of fewer than k words is one
    shingle; a document shorter than an item is a window as a whole.  Null texts,
    texts without words and null item_ids match nothing; a null doc_id is
    reported as null; repeated rows are reported each; of equal similarities the
    first window counts.  Empty tables give no rows.  The scan of docs is narrow;
    items beyond ITEM_BYTES are split into blocks, each with a scan of its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for index in _indexes(docs, items, k):
        part = docs.mapInArrow(_scan(index, threshold), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of `docs` (text string; other columns stay as they are) in which find_leaks has no passage.

    Every row is judged by its own text, whatever its doc_id.  The scan is narrow, one for each block of items."""
    for index in _indexes(docs, items, k):
        docs = docs.mapInArrow(_clean(index, threshold), docs.schema)
    return docs
