"""SimHash near-duplicates by anchor-point covering.

Two 23-bit blocks of a 64-bit fingerprint are read as points of the binary Golay
code's space. That code is perfect with covering radius 3: every point has exactly
one codeword, its home, within 3 bits. The anchors are the pairs of codewords.

Let x and y differ in d <= 2 bits. y is replicated to every anchor within covering
radius plus threshold, where the excess over radius 3, summed over both blocks, is
at most 2; x's home is among these, since moving y by d bits reaches x. So x as
resident of its home and y as visitor meet at an anchor, and there the full 64 bits
are compared. As the pair would meet at both homes, visitors only go to anchors at
or behind their own home.

Only distinct fingerprints are compared, so a group of equal texts counts once.
At an anchor, links are thinned to a spanning forest before they leave the worker:
never more than one row per fingerprint and anchor. Components grow by large-star
and small-star rounds over a written table, in logarithmically many rounds.

Edge cases: a null or wordless text has fingerprint zero and is linked like any
other; one or two words form one shingle; repeated rows give repeated rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import first_rows, fresh, numbered
from ..session import cut_lineage
from . import overlap
from .common import slices

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code [23, 12, 7].
GENERATOR = 0b101011100011
BLOCK, CHECK, RADIUS = 23, 11, 3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Residents times visitors compared in one step at an anchor.
STEP = 1 << 21
#: Edges that a task gets in a round of ``components``.
ROUND_ROWS = 20_000


# Fingerprints


def _fingerprints(texts: list[bytes], shingle: int, seed: int) -> np.ndarray:
    """One uint64 per text: the bits set in over half of its shingles' hashes."""
    from xxhash import xxh64_intdigest as digest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.translate(_LOWER).split()
        if len(words) > shingle:
            grams = [b" ".join(g) for g in zip(*(words[k:] for k in range(shingle)), strict=False)]
        else:
            grams = [b" ".join(words)] if words else []
        counts[i] = len(grams)
        hashes += [digest(g, seed) for g in grams]
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    all_hashes = np.array(hashes, np.uint64)
    starts = np.concatenate([[0], np.cumsum(counts[full])])
    # Sums per text over bit columns, a bounded number of hashes at a time.
    at = 0
    while at < len(full):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + 200_000, side="right")) - 1)
        part = all_hashes[starts[at] : starts[to]]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, (starts[at:to] - starts[at]).astype(np.int64), axis=0, dtype=np.int64)
        most = sums * 2 > counts[full[at:to], None]
        out[full[at:to]] = np.packbits(most, axis=1).view(">u8").ravel().astype(np.uint64)
        at = to
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_fingerprints(texts, shingle, seed).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# Anchors


def _syndromes(points: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator: zero for codewords, equal within a coset."""
    rest = points.copy()
    for bit in range(BLOCK - 1, CHECK - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - CHECK))
    return rest


@lru_cache(maxsize=2)
def _cosets(excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Error patterns of weight <= radius + excess, sorted by syndrome then weight; their weights; the syndromes' starts."""
    points = np.arange(1 << BLOCK, dtype=np.int64)
    weights = np.bitwise_count(points)
    low = points[weights <= RADIUS + excess]
    syndrome = _syndromes(low)
    order = np.lexsort((low, np.bitwise_count(low), syndrome))
    starts = np.searchsorted(syndrome[order], np.arange((1 << CHECK) + 1))
    return low[order], np.bitwise_count(low[order]).astype(np.int64), starts


def _near(points: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codewords within radius + excess of each point: row numbers, codewords' message bits, excess used."""
    patterns, weights, starts = _cosets(excess)
    syndrome = _syndromes(points)
    n = starts[syndrome + 1] - starts[syndrome]
    rows = np.repeat(np.arange(len(points)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = starts[syndrome][rows] + within
    return rows, (points[rows] ^ patterns[at]) >> CHECK, np.maximum(weights[at] - RADIUS, 0)


def _anchors(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor that a fingerprint resides at or visits."""
    mask = (1 << BLOCK) - 1
    first, second = ((fps >> np.uint64(s)).astype(np.int64) & mask for s in (0, BLOCK))
    r1, c1, e1 = _near(first, max_bits)
    r2, c2, e2 = _near(second, max_bits)
    n2 = np.bincount(r2, minlength=len(fps))
    start2 = np.cumsum(n2) - n2
    times = n2[r1]
    left = np.repeat(np.arange(len(r1)), times)
    right = start2[r1][left] + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    reach = e1[left] + e2[right] <= max_bits
    left, right = left[reach], right[reach]
    rows, anchors = r1[left], (c1[left] << (BLOCK - CHECK)) | c2[right]
    home = (e1[left] == 0) & (e2[right] == 0)  # perfect code: one codeword within the radius in each block
    own = np.zeros(len(fps), np.int64)
    own[rows[home]] = anchors[home]
    ahead = anchors >= own[rows]
    return rows[ahead], anchors[ahead], home[ahead]


def _spread(batches: Iterable[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            fps = part.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            nodes = part.column("node").to_numpy(zero_copy_only=False)
            rows, anchors, home = _anchors(fps, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(fps[rows].view(np.int64)), pa.array(nodes[rows]), pa.array(home)], ["anchor", "fp", "node", "home"])


def _forest(fps: np.ndarray, nodes: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links at one anchor between residents and all that meet them, thinned to a spanning forest."""
    residents = np.flatnonzero(home)
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []
    step = max(1, STEP // len(fps))
    for at in range(0, len(residents), step):
        own = residents[at : at + step]
        near = np.bitwise_count(fps[own, None] ^ fps[None, :]) <= max_bits
        a, b = np.nonzero(near)
        a = own[a]
        new = (a != b) & (~home[b] | (a < b))
        for i, j in zip(a[new].tolist(), b[new].tolist(), strict=True):
            ri, rj = root(i), root(j)
            if ri != rj:
                parent[max(ri, rj)] = min(ri, rj)
                left.append(i)
                right.append(j)
    return nodes[left], nodes[right]


def _meet(batches: Iterable[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links per anchor; batches come sorted by anchor."""
    held: list[pa.RecordBatch] = []

    def links(table: list[pa.RecordBatch]) -> pa.RecordBatch:
        anchor, fps, nodes, home = (np.concatenate([t.column(c).to_numpy(zero_copy_only=False) for t in table]) for c in ("anchor", "fp", "node", "home"))
        fps = fps.view(np.uint64)
        cuts = np.flatnonzero(np.diff(anchor)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(anchor)]])
        has = np.add.reduceat(home.astype(np.int64), starts) > 0
        a, b = [], []
        for s, e in zip(starts[has & (ends - starts > 1)].tolist(), ends[has & (ends - starts > 1)].tolist(), strict=True):
            left, right = _forest(fps[s:e], nodes[s:e], home[s:e], max_bits)
            a.append(left)
            b.append(right)
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(anchor, anchor[-1]))
        if last:  # all but the last anchor are complete
            yield links([*held, batch.slice(0, last)])
            held = []
        elif held and held[-1].column("anchor")[-1].as_py() != anchor[-1]:
            yield links(held)
            held = []
        held.append(batch.slice(last))
    if held:
        yield links(held)


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) between nodes whose fingerprints differ in at most ``max_bits`` bits.

    ``distinct`` has one row (node, fp) per fingerprint. The links keep what is
    connected, not every pair.
    """
    spread = distinct.select("node", "fp").mapInArrow(lambda it: _spread(it, max_bits), "anchor long, fp long, node long, home boolean")
    met = spread.repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(lambda it: _meet(it, max_bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge: component is the smallest node it reaches.

    Large-star then small-star until nothing moves; each round is written to the
    checkpoint folder. No round has more edges than the one before, so it is dealt over
    as many partitions as those need: the last rounds, of few edges, are a few tasks
    that shuffle nothing, instead of all shuffle partitions several times over.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if tuple(state) == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = tuple(state)
        parts = -(-state[0] // ROUND_ROWS)
        beside = F.broadcast if parts == 1 else lambda df: df
        both = now.coalesce(parts).select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(beside(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        star = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = large.join(beside(low), "u").select(F.inline(star)).where("u <> v").distinct()
        now = cut_lineage(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).coalesce(parts))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, node (smallest doc_id with that fingerprint), component_id for every row."""
    marked = cut_lineage(fingerprints(docs))
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    unclear = distinct.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("node IS NULL OR n > 1")
    if unclear.isEmpty():
        grown = components(links(distinct, max_bits))
        labels = distinct.join(grown, "node", "left").select("fp", "node", F.coalesce("component", "node").alias("component_id"))
        return marked.join(labels, "fp")
    # Fingerprints without a doc_id, or with one that others have too, need numbers of their own.
    placed = cut_lineage(numbered(distinct.withColumnRenamed("node", "least"), [F.col("least").asc_nulls_last(), F.col("fp")], "node"))
    grown = components(links(placed, max_bits))
    first = placed.select(F.col("node").alias("component"), F.col("least").alias("component_id"))
    part = placed.join(grown, "node", "left").select("fp", F.col("least").alias("node"), F.coalesce("component", "node").alias("component"))
    return marked.join(part.join(first, "component").drop("component"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component of texts with 5-word shingles of Jaccard similarity 0.8 or more the document with the smallest doc_id.

    Repeated rows of one doc_id count once, the first by all columns; rows without a doc_id
    stay, one per text. A null or empty text is as good as another; extra columns, whatever
    their names, come back unchanged; a very long text is handled whole; no rows give none.
    Anchors find what lies within ``MAX_BITS``; such texts are often further apart, so ``overlap``
    adds candidates by MinHash bands, and checks all candidates exactly.
    """
    gone, text = fresh("gone", docs), fresh("text_sha", docs)
    out = overlap.near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    left = docs.join(out, docs["doc_id"] == out[gone], "left_anti")
    nameless = F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256))
    return first_rows(left.withColumn(text, nameless), ["doc_id", text]).drop(text)
