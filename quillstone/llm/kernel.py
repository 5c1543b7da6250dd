"""Vectorised text kernels shared by the corpus operators.

Everything here works on the UTF-8 buffer of an Arrow string column, so a
batch of documents is handled by a few NumPy passes and no Python string is
made.  Nulls read as the empty text.  Word hashes, shingle hashes and rolling
byte hashes are 64-bit polynomial hashes finished by an avalanche mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Most text bytes that one vectorised step takes, unless one row alone has more.
STEP_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
#: Word separators: space, tab, line feed, vertical tab, form feed, carriage return.
_SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(_SEPARATORS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, STEP_BYTES + 64)
        up, down = np.full(size, _BASE, _U), np.full(size, pow(_BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most `limit` text bytes, or of one row."""
    at = utf8(batch.column(column))[1]
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 offsets of the rows among the words."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = _IS_WORD[data]
    before, after = inside[:-2].copy(), inside[2:].copy()
    if n:
        before[at[:-1][at[:-1] < n]] = False
        ends_at = at[1:] - 1
        after[ends_at[ends_at >= 0]] = False
    starts = np.flatnonzero(inside[1:-1] & ~before)
    ends = np.flatnonzero(inside[1:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and do not overlap.

    Works in blocks of spans, so one very long text needs no long tables."""
    out = np.empty(len(starts), _U)
    first = 0
    while first < len(starts):
        base = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, base + STEP_BYTES, "right")))
        stop = int(ends[last - 1])
        up, down = powers(stop - base + 1)
        sums = np.zeros(stop - base + 1, _U)
        np.cumsum((data[base:stop].astype(_U) + _U(1)) * up[: stop - base], out=sums[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = (sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)
        first = last
    return mix(out)


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at each position where k bytes follow."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.empty(n, _U)
    for first in range(0, n, STEP_BYTES):
        last = min(n, first + STEP_BYTES)
        part = data[first : last + k - 1]
        up, down = powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * up[: len(part)], out=sums[1:])
        out[first:last] = (sums[k:] - sums[:-k]) * down[: last - first]
    return mix(out)


def shingles(words: np.ndarray, rows: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of one row, their first word, and the rows' offsets among them.

    A row of one to k - 1 words has one shingle, its whole sequence."""
    n, lengths = len(words), np.diff(rows)
    c = _U(0xA24BAED4963EE407 + 2 * seed)
    rolled = np.zeros(n, _U)
    if n >= k:
        acc = words[: n - k + 1] + _U(seed)
        for i in range(1, k):
            acc = acc * c + words[i : n - k + 1 + i]
        rolled[: n - k + 1] = acc
    counts = np.where(lengths >= k, lengths - k + 1, np.minimum(lengths, 1))
    starts = np.repeat(rows[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    out = mix(rolled[starts]) if len(starts) else np.zeros(0, _U)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    for i in np.flatnonzero((lengths > 0) & (lengths < k)):
        acc = _U(seed)
        with np.errstate(over="ignore"):
            for w in words[rows[i] : rows[i + 1]]:
                acc = acc * c + w
            out[offsets[i]] = mix(np.array([acc + _U(int(lengths[i]))], _U))[0]
    return out, starts, offsets


def valid(part: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray, str]:
    """Bytes, row offsets and the joined text of a string column; invalid UTF-8 reads as U+FFFD."""
    data, at = utf8(part.column(column))
    try:
        return data, at, data.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        rows = [data[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace") for i in range(len(at) - 1)]
        raw = [r.encode() for r in rows]
        return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw], dtype=np.int64)]), "".join(rows)


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte offset (and the end), the number of code points before it."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
