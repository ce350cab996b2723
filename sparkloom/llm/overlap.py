"""Near-duplicates by overlap: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal sets count once. Candidates come from SimHash by anchor-point covering
(``simhash.links``): what is connected by fingerprints that differ in at most ``MAX_BITS``
bits shares a key. Texts of that similarity may lie further apart, so MinHash bands give
``BANDS`` more keys, of ``ROWS`` least hashes each: a pair of similarity 0.8 shares none of
them once in 190 000. An exact check follows. A task answers its own equal keys first and sends one row per key, so a large group
stays small on the way. Candidates' components are the units of the exact check: the
sets of one meet in a task, are compared where they share a key and aren't yet linked,
and fall into the components of the similarity itself.

A unit of more than ``UNIT_ROWS`` rows or ``UNIT_BYTES`` bytes is dealt in blocks of about
that size, and about ``PIVOTS`` of its rows go to every block, so that what belongs
together is linked through them. What this leaves open are
keys whose rows lie in several components. Of such a key only the rows outside its
largest component are compared, with each other and with that one, block by block. So
the result is that of one task for the whole unit.

Edge cases: a null or wordless text has the empty set, equal to any other such; up to
five words form one shingle; very long texts are handled whole; rows without a doc_id
link nothing, those of one doc_id are one document; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import counted
from ..session import cut_lineage
from .common import byte_lengths, slices

SHINGLE = 5
#: Least similarity, as a fraction so that the check stays in whole numbers.
LEAST = (4, 5)
BANDS, ROWS = 40, 6
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_KEYS = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2**64, (2, BANDS * ROWS), dtype=np.uint64)
#: Hashes taken at once.
STEP = 100_000
#: A block of the exact check: at most so many rows and bytes of text (or one row).
UNIT_ROWS, UNIT_BYTES = 256, 32_000_000
#: Rows of a unit, in expectation, that meet all its blocks.
PIVOTS = 16


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest as digest

    words = (text or b"").translate(_LOWER).split()
    if len(words) > SHINGLE:
        return np.unique(np.array([digest(b" ".join(g), SEED) for g in zip(*(words[k:] for k in range(SHINGLE)), strict=False)], np.uint64))
    return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys, one row per set; none of the sets is empty."""
    least = np.empty((len(sets), BANDS * ROWS), np.uint64)
    ends = np.cumsum([len(s) for s in sets])
    at = 0
    while at < len(sets):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + STEP, side="right")))
        flat = np.concatenate(sets[at:to])
        starts = np.concatenate([[0], ends[at : to - 1] - before]).astype(np.int64)
        for k in range(BANDS * ROWS):
            least[at:to, k] = np.minimum.reduceat((flat ^ _KEYS[0, k]) * (_KEYS[1, k] | np.uint64(1)), starts)
        at = to
    keys = np.zeros((len(sets), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = (keys ^ least[:, k::ROWS]) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from . import simhash

    for part in slices(batches, "text"):
        sets = [shingles(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
        full = [i for i, s in enumerate(sets) if len(s)]
        bands: list[bytes] = [b""] * len(sets)
        for i, keys in zip(full, _bands([sets[i] for i in full]) if full else (), strict=True):
            bands[i] = keys.tobytes()
        fps = simhash._fingerprints([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], simhash.SHINGLE, simhash.SEED).view(np.int64)
        alike = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        size = pa.array(byte_lengths(part.column("text")))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(alike, pa.binary()), pa.array(bands, pa.binary()), size, pa.array(fps)], ["doc_id", "alike", "bands", "size", "fp"])


def _keys_of(batch: pa.RecordBatch) -> np.ndarray:
    """How many keys each row's ``bands`` hold."""
    return byte_lengths(batch.column("bands")) // 8


def _spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (band, a, b): each band's first node here with itself, and links (a, b) to the other nodes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), _keys_of(batch))
        band = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        order = np.lexsort((node, band))
        band, own = band[order], node[order]
        fresh = np.concatenate([[True], band[1:] != band[:-1]])
        first = own[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        links = np.unique(np.stack([first, own])[:, ~fresh], axis=1)
        a, b = np.concatenate([own[fresh], links[0]]), np.concatenate([own[fresh], links[1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([band[fresh], links[0] ^ links[1]])), pa.array(a), pa.array(b)], ["band", "a", "b"])


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between a band's nodes and its first; batches come sorted by band, then a."""
    last, head = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        band, a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("band", "a", "b"))
        single = a == b
        left, right = [a[~single]], [b[~single]]
        band, node = band[single], a[single]
        if len(node):
            fresh = np.concatenate([[last is None or band[0] != last], band[1:] != band[:-1]])
            known = node if head is None else np.concatenate([[head], node])
            at = np.maximum.accumulate(np.where(fresh, np.arange(len(node)), -1)) + (head is not None)
            first = known[np.maximum(at, 0)]
            left.append(first[first != node])
            right.append(node[first != node])
            last, head = band[-1], first[-1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of sorted distinct hashes have the least similarity."""
    top, bottom = LEAST
    small, large = sorted((len(x), len(y)))
    if small * bottom < large * top:
        return False
    both = small + large - len(np.union1d(x, y))
    return both * bottom >= (small + large - both) * top


def linked(nodes: list[int], sets: list[np.ndarray], known: list[int] | None = None, near: list[int] | None = None) -> list[int]:
    """For each set the node that stands for its component: the smallest, where no ``known`` components are given.

    With ``known`` components all sets are compared, else those that share a band key or a number in ``near``.
    """
    seen: dict[int, int] = {}
    parent = [seen.setdefault(c, i) for i, c in enumerate(known or nodes)]  # the rows of one doc_id are one document

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    met: dict[int, dict[int, list[int]]] = {}  # per band key the sets seen, by root
    every = _bands(sets).tolist() if known is None else [[0]] * len(sets)
    if known is None and near is not None:
        every = [[*keys, key] for keys, key in zip(every, near, strict=True)]
    for i, keys in enumerate(every):
        failed: set[int] = set()
        for key in keys:
            groups = met.setdefault(key, {})
            for r in [r for r in groups if root(r) != r]:
                members = groups.pop(r)
                groups.setdefault(root(r), []).extend(members)
            for r, members in groups.items():
                if root(r) == root(i):
                    continue
                for j in members:
                    if j not in failed:
                        if similar(sets[i], sets[j]):
                            p, q = root(i), root(j)
                            first, second = (p, q) if nodes[p] < nodes[q] else (q, p)
                            parent[second] = first
                            break
                        failed.add(j)
            groups.setdefault(root(i), []).append(i)
    return [nodes[root(i)] for i in range(len(nodes))]


def _check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(unit, node, component) of each block in turn; rows come sorted by unit, i and j."""
    block, nodes, sets, known, near = None, [], [], [], []

    def done() -> pa.RecordBatch:
        found = linked(nodes, sets, None if known[0] is None else known, near)
        return pa.RecordBatch.from_arrays([pa.array([block[0]] * len(nodes), pa.int64()), pa.array(nodes, pa.int64()), pa.array(found, pa.int64())], ["unit", "node", "component"])

    for part in slices(batches, "text"):
        columns = (part.column(c).to_pylist() for c in ("unit", "i", "j", "node", "known", "near"))
        for u, i, j, node, component, key, text in zip(*columns, part.column("text").cast(pa.binary()).to_pylist(), strict=True):
            if (u, i, j) != block and nodes:
                yield done()
                nodes, sets, known, near = [], [], [], []
            block = (u, i, j)
            nodes.append(node)
            sets.append(shingles(text))
            known.append(component)
            near.append(key)
    if nodes:
        yield done()


def _checked(rows: DataFrame, dealt: DataFrame) -> DataFrame:
    """(unit, node, component) from the texts of ``dealt``: rows (unit, i, j, node, known, near), (unit, i, j) naming a block."""
    texts = rows.join(dealt, rows["doc_id"] == dealt["node"]).select("unit", "i", "j", "node", "known", "near", "text").distinct()
    blocks = texts.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
    return cut_lineage(blocks.mapInArrow(_check, "unit long, node long, component long").distinct())


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (band, node, known, size) for each band key of a node."""
    for batch in batches:
        if batch.num_rows:
            node, known, size = (pa.array(np.repeat(batch.column(c).to_numpy(zero_copy_only=False), _keys_of(batch))) for c in ("node", "known", "size"))
            band = pa.array(np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64))
            yield pa.RecordBatch.from_arrays([band, node, known, size], ["band", "node", "known", "size"])


def _open_keys(members: DataFrame, unit_rows: int, unit_bytes: int) -> DataFrame:
    """Blocks (unit, i, j, node, known) of the band keys whose rows lie in several known components.

    Block i of the rows outside the largest component meets every block j that is not
    before it, of these rows and of the largest component's.
    """
    keyed = cut_lineage(members.mapInArrow(_keyed, "band long, node long, known long, size long"))
    parts = lambda rows, size: F.greatest(F.lit(1), F.ceil(rows / unit_rows), F.ceil(size / unit_bytes))
    each = keyed.groupBy("band", "known").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    largest = F.max(F.struct("n", "known", "size")).alias("top")
    keys = each.groupBy("band").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.sum("size").alias("size"), largest).where("parts > 1")
    keys = keys.select(
        "band",
        F.col("top.known").alias("major"),
        (parts(F.col("n"), F.col("size")) == 1).alias("whole"),
        parts(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("minors"),
        parts(F.col("top.n"), F.col("top.size")).alias("majors"),
    )
    apart, dealt = F.col("known") != F.col("major"), F.xxhash64("node", F.lit(SEED))
    own = F.when(F.col("whole"), 0).when(apart, F.pmod(dealt, "minors")).otherwise(F.col("minors") + F.pmod(dealt, "majors"))
    most = F.when(F.col("whole"), 1).when(apart, F.col("minors") + F.col("majors")).otherwise(F.col("minors"))
    met = keyed.join(counted(cut_lineage(keys)), "band").select("band", "node", "known", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), most - 1)).alias("other"))
    return met.select(F.col("band").alias("unit"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "known").distinct()


def _with_near_keys(distinct: DataFrame) -> DataFrame:
    """``distinct`` with ``near``, a key of what fingerprints within ``MAX_BITS`` connect, also behind the ``bands`` of a full set."""
    from . import simhash

    full = distinct.where("node IS NOT NULL AND length(bands) > 0")
    placed = cut_lineage(full.groupBy("fp").agg(F.min("node").alias("first")))
    one = cut_lineage(placed.select(F.col("first").alias("node"), "fp"))
    grown = simhash.components(simhash.links(one)).withColumnRenamed("node", "first")
    keys = placed.join(grown, "first", "left").select("fp", F.xxhash64(F.coalesce("component", "first"), F.lit("near")).alias("near"))
    marked = distinct.join(keys, "fp", "left")
    return marked.withColumn("bands", F.when(F.length("bands") > 0, F.concat("bands", F.unhex(F.lpad(F.hex("near"), 16, "0")))).otherwise(F.col("bands")))


def near_duplicates(docs: DataFrame, unit_rows: int = UNIT_ROWS, unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """doc_id and component_id, the smallest doc_id of its component, for every row."""
    from .simhash import components

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = cut_lineage(rows.mapInArrow(_marks, "doc_id long, alike binary, bands binary, size long, fp long"))
    alike = cut_lineage(marked.groupBy("alike").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.max("size").alias("size"), F.min("fp").alias("fp")))
    distinct = cut_lineage(_with_near_keys(alike))
    spread = distinct.where("node IS NOT NULL AND length(bands) > 0").select("node", "bands").mapInArrow(_spread, "band long, a long, b long")
    links = spread.repartition("band").sortWithinPartitions("band", "a").mapInArrow(_meet, "a long, b long")
    found = components(links)
    units = found.select("node", F.col("component").alias("unit")).unionByName(found.select(F.col("component").alias("node"), F.col("component").alias("unit")).distinct())
    members = cut_lineage(units.join(distinct.where("length(bands) > 0"), "node"))
    sizes = members.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    large = counted(cut_lineage(sizes.where((F.col("n") > unit_rows) | (F.col("bytes") > unit_bytes)).select("unit", "n", F.greatest(F.ceil(F.col("n") / unit_rows), F.ceil(F.col("bytes") / unit_bytes)).alias("parts"))))
    pivot = (F.col("node") == F.col("unit")) | (F.pmod(F.xxhash64("node", F.lit(SEED + 1)), "n") < PIVOTS)
    one = F.array(F.coalesce(F.pmod(F.xxhash64("node", F.lit(SEED)), "parts"), F.lit(0).cast("long")))
    blocks = F.when(F.col("parts").isNotNull() & pivot, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(one)
    dealt = members.select("unit", "node", "near").distinct().join(large, "unit", "left").select("unit", F.explode(blocks).alias("i"), F.lit(0).cast("long").alias("j"), "node", F.lit(None).cast("long").alias("known"), "near")
    grown = _checked(rows, dealt)
    if not large.isEmpty():
        small = grown.join(large, "unit", "left_anti").select("node", "component")
        within = grown.join(large, "unit", "left_semi").select(F.col("node").alias("a"), F.col("component").alias("b"))
        known = components(within).withColumnRenamed("component", "known")
        left = members.join(large, "unit", "left_semi").join(known, "node", "left").select("node", F.coalesce("known", "node").alias("known"), "size", "bands")
        opened = cut_lineage(_open_keys(left, unit_rows, unit_bytes))
        if not opened.isEmpty():
            across = _checked(rows, opened.withColumn("near", F.lit(None).cast("long"))).select(F.col("node").alias("a"), F.col("component").alias("b"))
            known = components(known.select(F.col("node").alias("a"), F.col("known").alias("b")).unionByName(across)).withColumnRenamed("component", "known")
        grown = small.unionByName(known.withColumnRenamed("known", "component"))
    # A node's own text: the one row of that doc_id that has the node's set.
    named = marked.join(distinct.select("alike", "node"), "alike").select("doc_id", "node")
    return named.join(grown.select("node", "component"), "node", "left").select("doc_id", F.coalesce("component", "node").alias("component_id"))
