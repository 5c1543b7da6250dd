"""Near-duplicate documents by min-max hashing.

Every permutation gives two signature values, the smallest and the largest
permuted shingle, so a signature of 2P values costs P hash evaluations and
both values collide with the Jaccard similarity.  A band takes the minima and
maxima of neighbouring permutations.  Bands only propose; links are confirmed
on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm import kernel as K
from quillstone.llm.components import connected_components
from quillstone.llm.storage import cut

#: Bands and signature values a band.  With 30 bands of 5 values a pair of
#: similarity 0.85 shares no band with probability 2e-8, one of 0.80 with 7e-6.
BANDS, ROWS = 30, 5
#: Shingles (8 bytes each) of the members of a residual bucket that one task compares with as many others; smaller
#: buckets too are cut into a few blocks of EVEN_SHINGLES or EVEN_ROWS, so that tasks are even.
BLOCK_SHINGLES, EVEN_SHINGLES, EVEN_ROWS, FEW_BLOCKS = 2 << 20, 1 << 16, 256, 8
_TILE, _COLUMNS = 512, 8192
#: Documents for which an intermediate table without texts has a file (up to the session's number of partitions), and
#: the fewest files.
FILE_ROWS, FEWEST_FILES = 4000, 12


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batch (column text) with the sorted distinct shingle hashes of each row."""
    for part in K.slices(batch):
        data, at = K.utf8(part.column("text"))
        data = K.LOWER[data]
        starts, ends, rows = K.word_bounds(data, at)
        hashes, _, offsets = K.shingles(K.span_hashes(data, starts, ends), rows, k)
        yield part, [np.unique(hashes[offsets[i] : offsets[i + 1]]) for i in range(part.num_rows)]


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band keys, one row of `bands` for each (non-empty) set."""
    n_perm = (bands * rows + 1) // 2
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    values, signature = np.concatenate(sets), np.empty((len(sets), 2 * n_perm), np.uint64)
    for j, a in enumerate(_multipliers(n_perm)):
        permuted = values * a
        np.minimum.reduceat(permuted, offsets, out=signature[:, 2 * j])
        np.maximum.reduceat(permuted, offsets, out=signature[:, 2 * j + 1])
    keys = np.zeros((len(sets), bands), np.uint64)
    for r in range(rows):
        keys = keys * np.uint64(0x9FB21C651E98DF25) + signature[:, r : bands * rows : rows]
    keys += np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xC13FA9A902A6328F)
    return K.mix(keys)


def _profile(k: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for part, sets in shingle_sets(batch, k):
                sizes = np.array([len(s) for s in sets], np.int64)
                raw = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
                full = [s for s in sets if len(s)]
                keys = signatures(full, bands, rows).view(np.int64) if full else np.zeros((0, bands), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((sizes > 0) * bands)]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes), pa.array(raw[:, 0].copy()), pa.array(raw[:, 1].copy()), lists], ["doc_id", "n_shingles", "k1", "k2", "bands"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for part, sets in shingle_sets(batch, k):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    return run


def _linked(inter: int, a: int, b: int, num: int, den: int) -> bool:
    return den * inter >= num * (a + b - inter)


def _confirm(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(a), len(b)) * den >= num * max(len(a), len(b)):
                    small, large = (a, b) if len(a) < len(b) else (b, a)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    keep[i] = _linked(int((large[at] == small).sum()), len(a), len(b), num, den)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _residual(num: int, den: int):
    """Links across components between the members of one bucket, or of two of its blocks, from exact
    intersections: products of 0/1 tiles over the shingles that at least two members have."""

    def run(table: pa.Table) -> pa.Table:
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        node, comp, block = (table[c].to_numpy() for c in ("node", "comp", "block"))
        order = np.lexsort((node, comp, block))
        raw = table["shingles"].combine_chunks()
        sets = [np.frombuffer(raw[int(i)].as_buffer(), np.uint64) for i in order]
        node, comp, block = node[order], comp[order], block[order]
        sizes = np.array([len(s) for s in sets], np.int64)
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count > 1
        column = (np.cumsum(shared) - 1)[code]
        column[~shared[code]] = -1
        at, width = np.concatenate([[0], np.cumsum(sizes)]), int(shared.sum())
        root = {int(c): int(c) for c in np.unique(comp)}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        def tile(first: int, last: int, low: int, high: int) -> np.ndarray:
            out = np.zeros((last - first, high - low), np.float32)
            c = column[at[first] : at[last]]
            hit = (c >= low) & (c < high)
            out[np.repeat(np.arange(last - first), sizes[first:last])[hit], c[hit] - low] = 1
            return out

        found: list[tuple[int, int]] = []
        left = range(0, len(node), _TILE)
        for i in left:
            for j in left:
                ie, je = min(i + _TILE, len(node)), min(j + _TILE, len(node))
                # Where block p ends and q starts, a tile's ends may be of one component and its middle of others.
                if j < i or min(comp[i:ie].min(), comp[j:je].min()) == max(comp[i:ie].max(), comp[j:je].max()):
                    continue
                want = comp[i:ie, None] != comp[None, j:je]
                want &= (np.minimum.outer(sizes[i:ie], sizes[j:je]) * den) >= num * np.maximum.outer(sizes[i:ie], sizes[j:je])
                if p != q:
                    want &= block[i:ie, None] != block[None, j:je]
                if not want.any():
                    continue
                inter = np.zeros((ie - i, je - j), np.float32)
                for low in range(0, width, _COLUMNS):
                    high = min(width, low + _COLUMNS)
                    inter += tile(i, ie, low, high) @ tile(j, je, low, high).T
                inter = inter.astype(np.int64)
                want &= den * inter >= num * (sizes[i:ie, None] + sizes[None, j:je] - inter)
                for x, y in zip(*np.nonzero(want), strict=True):
                    a, b = find(int(comp[i + x])), find(int(comp[j + y]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        found.append((int(node[i + x]), int(node[j + y])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return run


def minhash_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of `docs` (doc_id long, text string; other columns are ignored):
    doc_id, n_shingles, component_id, kept.

    Documents whose sets of k-word shingles (ASCII lower-cased; a text of fewer
    words is one shingle) have den * intersection >= num * union are linked;
    component_id is the smallest doc_id reachable and kept says that it is the
    row's own.  Defined cases: a null or wordless text has n_shingles 0 and
    links with nothing; a null doc_id takes no part (component_id null, kept
    true); repeated rows give repeated result rows; rows that share a doc_id
    with different texts are one node with the links of all its texts; no rows,
    no result rows.

    Plan: one pass makes set keys and band keys.  Equal sets collapse by their
    128-bit key, so thousands of copies are one representative from there on.
    A bucket first tests only its smallest member against the others (a star).
    What stays in different components in buckets of three and more is compared
    exactly in tiles, in pairs of blocks, and once where buckets have the same
    members; pairs are never emitted.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = cut(docs.mapInArrow(_profile(k, bands, rows), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"), "profile")
    files = max(FEWEST_FILES, -(-base.count() // FILE_ROWS))
    usable = base.where("n_shingles > 0 and doc_id is not null")
    nodes = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("n_shingles").alias("size"))
    nodes = cut(nodes.coalesce(files), "nodes")
    members = nodes.select("node", "size", F.explode("bands").alias("key"))
    sized = members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot"), F.max("node").alias("top")).where("n > 1 and pivot <> top").drop("top")
    members = cut(members.join(sized, "key").coalesce(files), "members")

    star = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = cut(star.coalesce(files), "star")
    asked = star.select(F.col("a").alias("doc_id")).union(star.select("b")).distinct()
    # A merge join at every size: how much text moves must not hinge on a broadcast threshold.
    sets = docs.join(asked.hint("merge"), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).mapInArrow(_sets(k), "node long, shingles binary")
    sets = cut(sets, "sets")
    pairs = star.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    links = cut(pairs.mapInArrow(_confirm(num, den), "a long, b long"), "links")

    found = connected_components(links)
    rest = members.where("n > 2 and node <> pivot").join(found.toDF("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rest = cut(rest.select("key", "node", "size", "comp").coalesce(files), "rest")
    # Buckets of the same members, as the bands of one group of near copies often are, are compared once.
    mixed = rest.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.sum("size").alias("size"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("low <> high")
    mixed = mixed.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.max("size").alias("size"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK_SHINGLES), F.least(F.lit(FEW_BLOCKS), F.greatest(F.ceil(F.col("size") / EVEN_SHINGLES), F.ceil(F.col("n") / EVEN_ROWS))))
    rest = rest.drop("size").join(mixed.select("key", blocks.cast("int").alias("blocks")), "key")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", "node", "comp", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    rest = rest.join(sets, "node")
    more = rest.groupBy("key", "p", "q").applyInArrow(_residual(num, den), "a long, b long")
    more = cut(more, "links")
    final = connected_components(links.union(more))

    classes = nodes.join(final, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    shared = base.select("doc_id", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
    # The set of no shingles has a key too; it has no class.  A doc_id with several texts takes the smallest class.
    out = shared.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
