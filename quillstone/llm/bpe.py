"""Byte-level BPE encoding and decoding.

Texts are split without a regular expression.  Every code point gets a class
from a table; neighbours refine it (an apostrophe before a contraction, the
last white space before other text).  An automaton of eight states then finds
the boundaries.  A class acts on the states as a function, and functions
compose associatively, so the states at all block starts come from a parallel
scan over composed blocks, and one more pass gives the boundaries.  Slices go
through a cache of finished merges.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K

#: The code points of Unicode's White_Space property.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: What may follow an apostrophe as a token of its own.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Ranges of letters and numbers that Unicode 16 added; the merges' public splitter knows them.
LETTERS_16 = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NUMBERS_16 = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, GLUE, LONE = range(8)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, GLUED, ONE_MORE, TWO_MORE = range(8)
#: Finished pieces that the cache of one Python worker keeps.
CACHE_PIECES = 400_000
#: Bytes up to which a piece is merged by looking at all its pairs.
SHORT_PIECE = 48
#: Text bytes of a step: its pieces are Python strings for a while.
STEP_BYTES = 1 << 20
_LANE = 256


@cache
def class_table() -> np.ndarray:
    """Class of every code point: the standard library's categories, and what Unicode 16 adds to them."""
    kinds = np.full(0x110000, OTHER, np.uint8)
    first = {"L": LETTER, "N": NUMBER}
    for point in range(0x110000):
        kind = first.get(unicodedata.category(chr(point))[0])
        if kind is not None:
            kinds[point] = kind
    for low, high in LETTERS_16:
        kinds[low : high + 1] = LETTER
    for low, high in NUMBERS_16:
        kinds[low : high + 1] = NUMBER
    kinds[list(WHITE_SPACE)] = SPACE
    return kinds


@cache
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a token starts, by class (plus 8 at a text's first character) and state."""
    step, opens = np.zeros((16, 8), np.uint8), np.ones((16, 8), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT: IN_OTHER, LONG: IN_OTHER}
    for state in range(8):
        for kind, run in runs.items():
            step[kind, state], opens[kind, state] = run, state not in (run, GLUED)
        if state not in (IN_OTHER, GLUED):
            step[SHORT, state], step[LONG, state] = ONE_MORE, TWO_MORE
        step[SPACE, state], opens[SPACE, state] = IN_SPACE, state != IN_SPACE
        step[GLUE, state], step[LONE, state] = GLUED, FRESH
    step[LETTER, ONE_MORE], opens[LETTER, ONE_MORE] = FRESH, False
    step[LETTER, TWO_MORE], opens[LETTER, TWO_MORE] = ONE_MORE, False
    step[8:] = step[:8, FRESH][:, None]
    return step, opens


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions where tokens start, in the code points of joined texts that begin at `firsts`."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = class_table()[points]
    head = np.zeros(n + 1, bool)
    head[firsts[firsts < n]] = True
    head[n] = True
    after = np.zeros(n + 2, np.uint32)
    after[:n] = points
    for i in np.flatnonzero(points == 0x27):
        if head[i + 1]:
            continue
        if chr(after[i + 1]) in CONTRACTIONS:
            kinds[i] = SHORT
        elif i + 2 < n and not head[i + 2] and chr(after[i + 1]) + chr(after[i + 2]) in CONTRACTIONS:
            kinds[i] = LONG
    space = np.flatnonzero(kinds == SPACE)
    last = space[~head[space + 1]]
    last = last[kinds[last + 1] != SPACE]
    kinds[last] = np.where(points[last] == 0x20, GLUE, LONE)
    kinds[head[:n]] += 8

    step, opens = automaton()
    flat, lanes = step.ravel(), -(-n // _LANE)
    padded = np.full(lanes * _LANE, LETTER, np.uint8)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(lanes, _LANE).T).astype(np.int32) * 8
    maps = np.tile(np.arange(8, dtype=np.int32), (lanes, 1))
    for row in columns:
        maps = flat[row[:, None] + maps].astype(np.int32)
    reach = 1
    while reach < lanes:  # an inclusive scan: each map after those of all lanes before
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].copy(), axis=1)
        reach *= 2
    state = np.zeros(lanes, np.int32)
    state[1:] = maps[:-1, FRESH]
    out = np.empty((_LANE, lanes), bool)
    flags = opens.ravel()
    for i, row in enumerate(columns):
        at = row + state
        out[i] = flags[at]
        state = flat[at].astype(np.int32)
    return np.flatnonzero(out.T.ravel()[:n])


@cache
def vocabulary(path: str) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Ranks, and all tokens' bytes joined in order of rank with their offsets."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT_PIECE:
        return _merge_short(piece, ranks)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(ranks[piece[i : i + 2]], i, i + 1, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, j, stop = heapq.heappop(heap)
        if not alive[i] or j >= n or not alive[j] or after[i] != j or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
            rank = ranks.get(piece[i : end[after[j]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, after[j], end[after[j]]))
        if before[i] >= 0:
            rank = ranks.get(piece[before[i] : stop])
            if rank is not None:
                heapq.heappush(heap, (rank, before[i], i, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """merge() for pieces of a few bytes, where looking at all pairs costs less than a heap."""
    get, none = ranks.get, 1 << 60
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i] += parts.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


class _Pieces(dict):
    """Piece -> its ids as int32 bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.ranks = vocabulary(path)[0]

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_PIECES:
            self.clear()
        found = np.array(merge(piece.encode(), self.ranks), np.int32).tobytes()
        if len(piece) <= 64:
            self[piece] = found
        return found


@cache
def _pieces(path: str) -> _Pieces:
    return _Pieces(path)


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, kind))


def _encode(path: str):
    def run(batches):
        pieces = _pieces(path)
        for batch in batches:
            for part in K.slices(batch, limit=STEP_BYTES):
                data, at, text = K.valid(part)
                firsts = K.code_points(data)[at]
                cuts = boundaries(np.frombuffer(text.encode("utf-32-le"), np.uint32), firsts[:-1])
                stops = np.append(cuts[1:], len(text))[: len(cuts)]  # none where all texts are empty
                found = list(map(pieces.__getitem__, [text[a:b] for a, b in zip(cuts.tolist(), stops.tolist(), strict=True)]))
                sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
                rows = np.searchsorted(cuts, firsts)
                total = np.concatenate([[0], np.cumsum(sizes)])
                ids = np.frombuffer(b"".join(found), np.int32)
                starts = cuts - np.repeat(firsts[:-1], np.diff(rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(np.diff(total[rows]), ids, pa.int32()), _lists(np.diff(rows), starts.astype(np.int32), pa.int32())], ["doc_id", "ids", "piece_starts"])

    return run


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes of a sequence of ids."""
    _, joined, offsets = vocabulary(path)
    sizes = np.diff(offsets)[ids]
    if not len(ids):
        return b""
    return joined[np.repeat(offsets[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())].tobytes()


def _decode(path: str, kept: list[str]):
    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            rows = [decode_ids(ids[i].values.to_numpy() if ids[i].is_valid else np.zeros(0, np.int32), path) for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, pa.binary())], [*kept, "decoded"])

    return run


def encode_documents(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids array<int>, piece_starts array<int> (code-point offsets of the pre-tokens).

    One row per row of `docs` (doc_id, text; other columns are ignored), narrow,
    without a shuffle.  A null or empty text has no ids; any doc_id, null or
    repeated, is carried along; no rows give no rows.  The vocabulary file must
    be readable at the same path on every executor.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_encode(vocabulary_path), "doc_id long, ids array<int>, piece_starts array<int>")


def decode_tokens(tokens: DataFrame, vocabulary_path: str) -> DataFrame:
    """`tokens` (doc_id, ids) with decoded binary, the bytes that the ids stand for; null ids decode to none."""
    tokens = tokens.select("doc_id", "ids")
    return tokens.mapInArrow(_decode(vocabulary_path, ["doc_id", "ids"]), "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, ids, decoded: encode_documents and decode_tokens one after the other in one Python worker."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encode, decode = _encode(vocabulary_path), _decode(vocabulary_path, ["doc_id", "ids"])
    return docs.mapInArrow(lambda batches: decode(encode(batches)), "doc_id long, ids array<int>, decoded binary")
