"""Repeated byte strings and word passages against brute force; the transform against sorting."""

import hashlib
import os
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bwt, exchange, suffixes
from quillstone.llm.substring import substring_dedup
from quillstone.llm.suffixes import suffix_dedup
from tests.llm.fixtures import WORD, frame, odd_rows

LAST = 1 << 63


def by_bytes(rows, window=50):
    first = {}
    for i, text in rows:
        raw = (text or "").encode()
        for s in range(len(raw) - window + 1):
            key = raw[s : s + window]
            first[key] = min(first.get(key, LAST), LAST if i is None else i)
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            if first[raw[s : s + window]] < (LAST if i is None else i):
                gone[s : s + window] = b"\1" * window
        spans = sum(1 for part in bytes(gone).split(b"\0") if part)
        out.append((i, len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def by_words(rows, window=20):
    first, texts = {}, [WORD.findall(t or "") for _, t in rows]
    for (i, _), words in zip(rows, texts):
        for s in range(len(words) - window + 1):
            key, place = tuple(words[s : s + window]), (LAST if i is None else i, s)
            first[key] = min(first.get(key, place), place)
    out = []
    for (i, _), words in zip(rows, texts):
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            if first[tuple(words[s : s + window])] < (LAST if i is None else i, s):
                gone[s : s + window] = [True] * window
        out.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g).encode()))
    return out


def key(row):
    return tuple((x is None, x) if not isinstance(x, bytes) else hashlib.sha1(x).hexdigest() for x in row)


def test_byte_strings(spark):
    rows = odd_rows()
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in suffix_dedup(frame(spark, rows)).collect()]
    assert sorted(map(key, found)) == sorted(map(key, by_bytes(rows)))


def test_word_passages(spark):
    rows = odd_rows()
    found = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in substring_dedup(frame(spark, rows)).collect()]
    assert sorted(map(key, found)) == sorted(map(key, by_words(rows)))


@pytest.mark.parametrize("hot", [0, 2, 16])
def test_passages_of_many_documents(spark, monkeypatch, hot):
    """A passage in every document with contexts of their own, copies of whole documents, over many small chunks."""
    monkeypatch.setattr(exchange, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 5000)
    monkeypatch.setattr(suffixes, "HOT_CHUNKS", hot)
    rng = random.Random(hot)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    passage, copy = " ".join(word() for _ in range(40)), " ".join(word() for _ in range(120))
    rows = [(i, " ".join(word() for _ in range(30)) + f" {passage} " + " ".join(word() for _ in range(30))) for i in range(150)]
    rows += [(200 + i, copy) for i in range(60)] + [(300 + i, copy[: 100 + 7 * i] + " end") for i in range(20)] + odd_rows()
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in suffix_dedup(frame(spark, rows)).collect()]
    assert sorted(map(key, found)) == sorted(map(key, by_bytes(rows)))
    found = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text)) for r in substring_dedup(frame(spark, rows)).collect()]
    assert sorted(map(key, found)) == sorted(map(key, by_words(rows)))


def test_texts_longer_than_a_chunk(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600_000)]
    one = " ".join(words)  # more than 4 MB
    two = " ".join([*words[400_000:], "middle", *words[:50_000]])
    rows = [(4, one), (7, two), (2, " ".join(words[100:150]))]
    found = {r.doc_id: r for r in suffix_dedup(frame(spark, rows)).collect()}
    assert found[2].n_removed == 0 and found[4].n_removed == len(" ".join(words[100:150])) + 2 or found[4].n_removed >= len(" ".join(words[100:150]))
    assert bytes(found[7].kept_bytes).strip() == b"middle"
    found = {r.doc_id: r for r in substring_dedup(frame(spark, rows)).collect()}
    assert (found[2].n_removed, found[4].n_removed, bytes(found[7].kept_text)) == (0, 50, b"middle")


def test_cost_of_an_offer_depends_on_its_own_hashes():
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2))
    none = np.zeros(len(hashes), bool)

    def seconds(buckets):
        best = 9.0
        for _ in range(5):
            start = time.perf_counter()
            made = exchange.offer(0, hashes, none, none, buckets)
            best = min(best, time.perf_counter() - start)
        assert sum(len(x.as_py()) for x in made["hashes"]) == 4 * len(hashes)
        return best

    assert seconds(100_000_000) < 5 * seconds(1_000_000)
    for buckets in (1, 7, 1000):
        assert (np.diff(exchange.bucket_of(hashes, buckets).astype(np.int64)) >= 0).all() and exchange.bucket_of(hashes, buckets).max() < buckets
    assert exchange.sizes(100 << 40)[0] < 100 << 20 and exchange.sizes(0) == (8, 8)


@pytest.mark.parametrize("window", [20, 51, 52, 23])
def test_windows_out_of_range(spark, window):
    with pytest.raises(ValueError):
        suffix_dedup(frame(spark, []), window)
    if window % 2:
        with pytest.raises(ValueError):
            substring_dedup(frame(spark, []), window)


def test_no_rows(spark):
    assert suffix_dedup(frame(spark, [])).collect() == [] and substring_dedup(frame(spark, [])).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=8).map(lambda b: bytes(97 + x % 3 for x in b)), min_size=1, max_size=9))
def test_column_wise_transform_sorts_all_suffixes(strings):
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    transform, common, _ = bwt.column_wise(np.frombuffer(b"".join(strings), np.uint8), offsets)
    which, length = bwt.suffixes(transform, np.diff(offsets))
    expected = sorted((s[len(s) - n :], i) for i, s in enumerate(strings) for n in range(len(s) + 1))
    assert [(strings[i][len(strings[i]) - n :], i) for i, n in zip(which, length)] == expected
    assert list(common) == [0] + [len(os.path.commonprefix([a[0], b[0]])) for a, b in zip(expected, expected[1:])]
