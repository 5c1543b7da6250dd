import numpy as np
import pyarrow as pa
import pytest

from quillstone.llm import minhash
from quillstone.llm.components import connected_components
from tests.llm.fixtures import LOWER, WORD, frame, odd_rows


def brute(rows, num, den, k=5):
    sets = {}
    for i, text in rows:
        if i is None:
            continue
        words = WORD.findall((text or "").translate(LOWER))
        found = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
        sets.setdefault(i, []).append(found)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, group in sets.items() for s in group if s]
    for a, (i, s) in enumerate(flat):
        for j, t in flat[:a]:
            if den * len(s & t) >= num * len(s | t):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in sets}, sets


@pytest.mark.parametrize("num", [80, 85])
def test_classes_equal_brute_force(spark, num):
    rows = odd_rows()
    expected, sets = brute(rows, num, 100)
    found = minhash.minhash_dedup(frame(spark, rows), num=num).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == expected[r.doc_id], r
            assert r.kept == (r.component_id == r.doc_id)
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def test_a_text_longer_than_a_slice(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in rng.integers(0, 1 << 30, 400_000)]
    near = [*words[:200_000], "other", *words[200_001:]]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (4, " ".join(words[:300_000])), (9, "short")]
    found = {r.doc_id: (r.component_id, r.n_shingles) for r in minhash.minhash_dedup(frame(spark, rows), num=85).collect()}
    assert found == {5: (3, 399_996), 3: (3, 399_996), 4: (4, 299_996), 9: (9, 1)}


def test_no_rows(spark):
    assert minhash.minhash_dedup(frame(spark, [])).collect() == []


@pytest.mark.parametrize("size", ["BLOCK_SHINGLES", "EVEN_SHINGLES"])
def test_many_members_in_blocks(spark, monkeypatch, size):
    """Residual buckets of more shingles than a block are compared in pairs of blocks."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 450 if size == "BLOCK_SHINGLES" else 1 << 20)
    monkeypatch.setattr(minhash, "EVEN_SHINGLES", 300 if size == "EVEN_SHINGLES" else 1 << 20)
    rng = np.random.default_rng(3)
    core = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(core)
        for p in rng.choice(60, 2, replace=False):
            words[p] = f"x{i}_{p}"
        rows.append((i, " ".join(words)))
    expected, _ = brute(rows, 70, 100)
    found = {r.doc_id: r.component_id for r in minhash.minhash_dedup(frame(spark, rows), num=70, rows=3).collect()}
    assert found == expected


def test_links_of_a_tile_that_spans_two_blocks(monkeypatch):
    """A tile [0, 90 | 0, 0] has one component at its ends and another in its middle."""
    monkeypatch.setattr(minhash, "_TILE", 4)
    members = [(i, 0, 0) for i in range(5)] + [(90, 90, 0)] + [(i, 0, 1) for i in range(10, 22)]
    sets = [np.arange(20 * i, 20 * i + 20, dtype=np.uint64) for i, _, _ in members]
    sets[5] = np.append(sets[-1][:-1], np.uint64(9999))  # 90 is near 21 only
    node, comp, block = (pa.array(c, pa.int64()) for c in zip(*members, strict=True))
    ends = [pa.array([x] * len(members), pa.int32()) for x in (0, 1)]
    table = pa.table({"p": ends[0], "q": ends[1], "node": node, "comp": comp, "block": block, "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    assert minhash._residual(80, 100)(table).to_pylist() == [{"a": 90, "b": 21}]


def test_min_max_signature_estimates_jaccard():
    rng = np.random.default_rng(9)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = np.unique(pool[:2000]), np.unique(pool[1000:])
    keys = minhash.signatures([a, b], bands=600, rows=1)
    assert abs((keys[0] == keys[1]).mean() - 1 / 3) < 0.06


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (3, None)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100
    assert connected_components(edges.limit(0)).collect() == []
