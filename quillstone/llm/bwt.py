"""Column-wise construction of the Burrows-Wheeler transform of many strings.

All strings are aligned at their ends.  A round inserts one symbol of every
string that is long enough: the symbol in front of the suffix that the round
adds to the sorted list of all suffixes so far.  Where it goes follows from the
transform itself: the list position of a new suffix is the rank of its first
symbol among the symbols of the transform before.  The common prefix of a new
suffix with its neighbours is one more than the least common prefix between
the neighbouring occurrences of that symbol.  Transform and common prefixes lie
in files that every round reads and writes from front to back.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


class _Pairs:
    """The list's symbols and common prefixes, one number an entry, in a file; a round reads the old
    file and writes the next one, both from front to back."""

    def __init__(self, folder: str, kind: type):
        self.kind = kind
        self.files = [open(os.path.join(folder, f"pairs.{i}"), "wb+", buffering=0) for i in (0, 1)]  # noqa: SIM115
        self.sizes, self.now = [0, 0], 0

    def read(self) -> np.ndarray:
        out = np.empty(self.sizes[self.now], self.kind)
        self.files[self.now].seek(0)
        view = memoryview(out).cast("B")
        while view:
            view = view[self.files[self.now].readinto(view) :]
        return out

    def write(self, pairs: np.ndarray) -> None:
        self.now ^= 1
        self.files[self.now].seek(0)
        view = memoryview(pairs).cast("B")
        while view:
            view = view[self.files[self.now].write(view) :]
        self.sizes[self.now] = len(pairs)

    def close(self) -> None:
        for f in self.files:
            f.close()


def column_wise(text: np.ndarray, offsets: np.ndarray, cap: int = 255, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted suffixes of the strings text[offsets[i] : offsets[i + 1]], of bytes or 16-bit symbols.

    Returns the transform in dense symbols (0 ends a string), the common prefix of
    every suffix with the one before, at most `cap` (a byte), and the dense code of each symbol.
    """
    m, lengths = len(offsets) - 1, np.diff(offsets)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    # A byte for the symbols where it suffices, as they are sorted once a round.
    small, pair = (np.uint8, np.uint16) if len(used) < 256 else (np.uint16, np.uint32) if len(used) < 65536 else (np.uint32, np.uint64)
    code = np.zeros(int(used[-1]) + 1 if len(used) else 1, small)
    code[used] = np.arange(1, len(used) + 1)
    symbols = code[text] if len(text) else np.zeros(1, small)
    ends = offsets[1:]

    def before(which: np.ndarray, length: int) -> np.ndarray:
        """The symbol in front of the suffix of that length, 0 where the suffix is the whole string."""
        at = ends[which] - length - 1
        return np.where(lengths[which] > length, symbols[np.maximum(at, 0)], 0).astype(pair)

    with tempfile.TemporaryDirectory(dir=folder) as place:
        pairs = _Pairs(place, pair)
        everyone, lengths_sorted = np.arange(m), np.sort(lengths)
        pairs.write(before(everyone, 0) << 8 if m else np.zeros(0, pair))
        new_at, new_string = everyone, everyone  # list positions of the last round's suffixes, ascending, and their strings
        for length in range(1, int(lengths.max(initial=0)) + 1):
            old = pairs.read()
            symbol, n = (old >> 8).astype(small), len(old)
            order = np.argsort(symbol, kind="stable")  # by symbol, then position: the list order of the suffixes they begin
            zeros = int(np.searchsorted(lengths_sorted, length - 1, "right"))  # strings that have ended
            # The last round's symbols in list order of the suffixes they begin; finished strings (0) add none.
            last = symbol[new_at]
            going = last != 0
            turn = np.argsort(last, kind="stable")[len(last) - np.count_nonzero(going) :]
            here, which = new_at[turn], new_string[turn]
            is_new = np.zeros(n, bool)
            is_new[here] = True
            k = np.flatnonzero(is_new[order])
            by_place = np.empty(len(last), np.int64)
            by_place[turn] = np.arange(len(turn))
            by_place = by_place[going]
            at = m + k - zeros  # where the new suffixes stand in the list with them
            # Least common prefix from the same symbol's previous occurrence to this one, and from this one to the next.
            back, ahead = order[np.maximum(k - 1, 0)], order[np.minimum(k + 1, n - 1)]
            same_back, same_ahead = (k > zeros) & (symbol[back] == symbol[here]), (k + 1 < n) & (symbol[ahead] == symbol[here])
            common = np.empty(n + 1, np.uint8)
            common[:n], common[n] = old & 0xFF, 0
            with_back, with_ahead = _least(common, back, here, same_back, by_place), _least(common, here, ahead, same_ahead, by_place)
            keep = np.ones(n + len(k), bool)
            keep[at] = False
            fresh = np.empty(n + len(k) + 1, pair)
            fresh[:-1][keep] = old
            fresh[at + 1] = fresh[at + 1] >> 8 << 8 | np.where(same_ahead, np.minimum(with_ahead.astype(pair) + 1, cap), 0).astype(pair)
            fresh[at] = before(which, length) << 8 | np.where(same_back, np.minimum(with_back.astype(pair) + 1, cap), 0).astype(pair)
            pairs.write(fresh[:-1])
            new_at, new_string = at, which
        found = pairs.read()
        pairs.close()
        return (found >> 8).astype(small), (found & 0xFF).astype(np.uint8), code


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray, use: np.ndarray, by_place: np.ndarray) -> np.ndarray:
    """min(values[low + 1 : high + 1]) where `use` holds; by_place lists the entries by their places."""
    out = np.zeros(len(low), np.uint8)
    which = by_place[use[by_place]]
    if len(which):
        pairs = np.empty(2 * len(which), np.int64)
        pairs[::2], pairs[1::2] = low[which] + 1, high[which] + 1
        out[which] = np.minimum.reduceat(values, pairs)[::2]
    return out


def suffixes(bwt: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """String and suffix length of each list position, by walking all strings from their ends at once."""
    n, m = len(bwt), len(lengths)
    order = np.argsort(bwt, kind="stable")
    zeros = n - np.count_nonzero(bwt)
    step = np.empty(n, np.int64)
    step[order] = m + np.arange(n) - zeros
    string, length = np.empty(n, np.int32), np.empty(n, np.int32)
    at, who = np.arange(m), np.arange(m)
    for size in range(int(lengths.max(initial=0)) + 1):
        string[at], length[at] = who, size
        going = lengths[who] > size
        who, at = who[going], step[at[going]]
    return string, length
