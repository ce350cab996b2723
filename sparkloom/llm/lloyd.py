"""Centroid clustering by Lloyd rounds that only look at what changed, in whole numbers.

Vectors become integers and are packed into blocks (a matrix of up to ``BLOCK`` vectors per
row), which are dealt and written once. Beside them a state per block is kept: each vector's
owner and its squared distance to it. A round takes the centroids that its predecessor
changed. A vector whose owner stood still is compared with the changed centroids only: the
others lost to its owner before and still do. A vector whose owner moved is compared with
all. Vectors that change hands leave signed transfers (minus their components and count
from the old owner, plus to the new one), summed in the block, then by Spark; added to the
global sums they give the next centroids. The driver holds sums and centroids only, that is
``k`` times the dimension.

Blocks and states are tables bucketed alike in the warehouse, so their join needs no shuffle:
a round moves and writes some bytes per vector, never the vectors, and a lost executor costs
one round. The tables are dropped when the result stands in the checkpoint folder. Where no
centroid changes any more, later rounds would change nothing and aren't run.

Edge cases: vectors of another dimension, null ones, and those with a null or non-finite
component are left out; with fewer vectors than ``k`` there are fewer centroids; equal
vectors may start as two centroids, of which the one with the smaller number gets all; a
centroid without vectors stays where it is; repeated rows and rows without a vec_id count
like any other (without one they come last in the choice of the first centroids); an empty
table gives an empty result; other columns, whatever their names, are ignored. A component
beyond 2^27 in whole numbers is an error, since distances would not fit a long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

BLOCK = 1024
#: Largest component: 64 squares of twice as much still fit a signed long.
LARGEST = 1 << 27
#: Whole numbers up to here are exact in a double.
_EXACT = 1 << 53


@dataclass(frozen=True)
class Clustering:
    """What a run leaves: one row per vector and the centroids."""

    assigned: DataFrame  # vec_id, cluster, distance
    centroids: np.ndarray  # k x dimension
    rounds: int  # rounds that were run until nothing changed


def whole_numbers(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, v): the usable vectors, each component floor(scale * x)."""
    x = F.col("embedding")
    usable = F.size(x) == dim
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = vectors.select("vec_id", x.cast("array<double>").alias("embedding")).where(usable & finite)
    return kept.select("vec_id", F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c)).alias("v"))


def first_centroids(whole: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ``seed:vec_id`` has the smallest SHA-256, in that order."""
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = whole.select(lot.alias("lot"), "v").orderBy(F.col("lot").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def pack(whole: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, ids, matrix): up to ``size`` vectors a row, as little-endian 32-bit numbers; written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, min(size, batch.num_rows - at))
                values = part.column("v").flatten().to_numpy(zero_copy_only=False)
                if len(values) and max(-int(values.min()), int(values.max())) > LARGEST:
                    raise ValueError(f"a component is beyond {LARGEST} in whole numbers")
                ids = pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([values.astype("<i4").tobytes()], pa.binary())], ["ids", "matrix"])

    packed = whole.select(F.col("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, "ids array<long>, matrix binary")
    # Written with its number, so that dealing it later can't draw another one.
    return cut_lineage(packed.withColumn("block", F.monotonically_increasing_id()))


class Buckets:
    """Tables of one run, all bucketed by block alike."""

    def __init__(self, spark: SparkSession, count: int):
        self.spark, self.count, self.name, self.made = spark, count, f"lloyd_{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        self.made += 1
        table = f"{self.name}_{self.made}"
        df.write.bucketBy(self.count, "block").format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def drop(self, which: int) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{which}")


def squared_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one column per centroid; by a product of doubles where that is exact."""
    v, c = vectors.astype(np.int64), centroids.astype(np.int64)
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if most * most * v.shape[1] < _EXACT:
        dot = (v.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
        return (v * v).sum(1)[:, None] - 2 * dot + (c * c).sum(1)[None, :]
    out = np.empty((len(v), len(c)), np.int64)
    for k, one in enumerate(c):
        out[:, k] = ((v - one) ** 2).sum(1)
    return out


def reassign(vectors: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New owners and distances, and how many distances were computed."""
    owner, distance = owner.copy(), distance.copy()
    moved = np.isin(owner, changed) | (owner < 0)
    compared = 0
    full = np.flatnonzero(moved)
    if len(full):
        d = squared_distances(vectors[full], centroids)
        owner[full] = d.argmin(1)  # the first of equal ones
        distance[full] = d[np.arange(len(full)), owner[full]]
        compared += d.size
    rest = np.flatnonzero(~moved)
    if len(rest) and len(changed):
        d = squared_distances(vectors[rest], centroids[changed])
        best = d.argmin(1)
        near, who = d[np.arange(len(rest)), best], changed[best]
        wins = (near < distance[rest]) | ((near == distance[rest]) & (who < owner[rest]))
        owner[rest[wins]], distance[rest[wins]] = who[wins], near[wins]
        compared += d.size
    return owner, distance, compared


def transfers(vectors: np.ndarray, old: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """Signed sums of what changed hands: per centroid the components and, last, the count."""
    out = np.zeros((k, vectors.shape[1] + 1), np.int64)
    went = np.flatnonzero(old != new)
    if len(went):
        rows = np.concatenate([vectors[went].astype(np.int64), np.ones((len(went), 1), np.int64)], 1)
        np.add.at(out, new[went], rows)
        had = old[went] >= 0
        np.subtract.at(out, old[went][had], rows[had])
    return out


def _step(dim: int, centroids: np.ndarray, changed: np.ndarray) -> Column:
    """(owner, distance, moved): the state of a block after one round and the transfers that it makes."""

    def run(matrix: pd.Series, owner: pd.Series, distance: pd.Series) -> pd.DataFrame:
        rows = []
        for m, o, d in zip(matrix, owner, distance, strict=True):
            v = np.frombuffer(m, "<i4").reshape(-1, dim)
            before = np.full(len(v), -1, np.int64) if o is None else np.asarray(o, np.int64)
            far = np.zeros(len(v), np.int64) if d is None else np.asarray(d, np.int64)
            now, near, _ = reassign(v, before, far, centroids, changed)
            rows.append((now.astype(np.int32), near, transfers(v, before, now, len(centroids)).ravel()))
        return pd.DataFrame(rows, columns=["owner", "distance", "moved"])

    return F.pandas_udf(run, "owner array<int>, distance array<long>, moved array<long>")("matrix", "owner", "distance")  # type: ignore[call-overload]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024) -> Clustering:
    """``rounds`` rounds of assigning and moving centroids, and a last assignment, over (vec_id, embedding)."""
    spark = vectors.sparkSession
    whole = whole_numbers(vectors, dim, scale)
    centroids = first_centroids(whole, k, seed)
    if not len(centroids):
        return Clustering(spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.zeros((0, dim), np.int64), 0)
    k = len(centroids)
    blocks = pack(whole)
    tables = Buckets(spark, max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count())))
    packed = tables.written(blocks.repartition(tables.count, "block"))
    state = packed.select("block", F.lit(None).cast("array<int>").alias("owner"), F.lit(None).cast("array<long>").alias("distance"))
    sums = np.zeros((k, dim + 1), np.int64)
    changed, done = np.arange(k), 0
    for done in range(rounds + 1):
        last = tables.made
        state = tables.written(one_round(packed, state, dim, centroids, changed))
        if last > 1:
            tables.drop(last)
        if done == rounds:
            break
        sums += _summed(state, k, dim)
        held = np.flatnonzero(sums[:, dim])
        after = centroids.copy()
        after[held] = sums[held, :dim] // sums[held, dim:]  # floor, also below zero
        changed = np.flatnonzero((after != centroids).any(1))
        centroids = after
        if not len(changed):
            break
    one = _met(packed.select("block", "ids"), state).select(F.explode(F.arrays_zip("ids", "owner", "distance")).alias("r"))
    assigned = cut_lineage(one.select(F.col("r.ids").alias("vec_id"), F.col("r.owner").alias("cluster"), F.col("r.distance").alias("distance")))
    for which in (1, tables.made):
        tables.drop(which)
    return Clustering(assigned, centroids, done)


def _met(packed: DataFrame, state: DataFrame) -> DataFrame:
    """Blocks with their states, bucket by bucket, the states (the smaller rows) looked up."""
    return packed.join(state.select("block", "owner", "distance").hint("shuffle_hash"), "block")


def one_round(packed: DataFrame, state: DataFrame, dim: int, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The blocks' state after a round: block, owner, distance and the transfers made."""
    both = _met(packed.select("block", "matrix"), state)
    return both.select("block", _step(dim, centroids, changed).alias("s")).select("block", "s.owner", "s.distance", "s.moved")


def _summed(state: DataFrame, k: int, dim: int) -> np.ndarray:
    """The transfers of all blocks: k * (dim + 1) sums, added up by Spark."""
    each = state.select(F.posexplode("moved").alias("at", "v")).where("v <> 0").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(k * (dim + 1), np.int64)
    for r in each.collect():  # k * (dim + 1) rows at most
        out[r["at"]] = r["v"]
    return out.reshape(k, dim + 1)


def digest(found: Clustering) -> DataFrame:
    """vec_id, cluster, distance, the cluster's and the whole inertia, and the digest of the centroid."""
    spark = found.assigned.sparkSession
    rows = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids.tolist())]
    named = spark.createDataFrame(rows, "cluster int, centroid_sha256 string")
    sums = found.assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = found.assigned.agg(F.sum("distance").alias("inertia"))
    each = sums.join(F.broadcast(total)).join(F.broadcast(named), "cluster")  # one row; one row per centroid
    return found.assigned.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
