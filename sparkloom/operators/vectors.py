"""An inverted-file index for vectors, searched by cosine in a few of its lists.

The index is fitted on a bounded sample (``SAMPLE`` vectors, those with the smallest hash of
their id): some rounds of k-means over directions give the lists' centres. Every vector is
then put into the list of its nearest centre; nothing is left out of the index. A search
looks into the ``probes`` lists nearest to each query: each task takes its own vectors list
by list, multiplies them with the queries that look there, and sends on its ``k`` best per
query. The queries are a stated set, told to every task in blocks; vectors aren't dealt, so
a list of any size is spread over the tasks that hold it.

Edge cases: vectors without a direction (null, empty, all zero, not finite) are nowhere near
anything and stay out, as do those of another dimension than most of the sample; equal
similarities go by vec_id; repeated rows count by themselves; without vectors or queries
there is no result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import MAX_BROADCAST_ROWS
from . import cosines

#: Vectors that the centres are fitted on.
SAMPLE = 10_000


@dataclass(frozen=True)
class Index:
    """``rows`` (vec_id, embedding, list), and the lists' centres."""

    rows: DataFrame
    centres: np.ndarray


def _directions(column: Iterable) -> np.ndarray:
    v = np.array([np.asarray(x, np.float64) for x in column], np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


def _nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of each direction's nearest centre, a slice at a time."""
    return np.concatenate([(v[at : at + cosines.QUERIES] @ centres.T).argmax(1).astype(np.int32) for at in range(0, len(v), cosines.QUERIES)])


def _usable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    size = F.aggregate(x, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return vectors.select("vec_id", "embedding").where((size > 0) & (size < float("inf")))


def fit(vectors: DataFrame, lists: int = 0, rounds: int = 10) -> np.ndarray:
    """Centres of about ``lists`` lists (default: the square root of all vectors, 4096 at most)."""
    own = _usable(vectors)
    sample = own.select("embedding", F.xxhash64("vec_id").alias("h")).orderBy("h").limit(SAMPLE).select("embedding").toPandas()["embedding"]  # SAMPLE rows
    if not len(sample):
        return np.zeros((0, 0))
    dims = sample.map(len)
    v = _directions(sample[dims == dims.mode()[0]])
    k = min(len(v), lists or max(1, min(4096, int(own.count() ** 0.5))))
    centres = v[:k].copy()
    for _ in range(rounds):
        near = _nearest(v, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, v)
        norm = np.sqrt((sums * sums).sum(1))
        held = norm > 0
        centres[held] = sums[held] / norm[held, None]
    return centres


def build(vectors: DataFrame, lists: int = 0) -> Index:
    """Every usable vector with the number of its list."""
    centres = fit(vectors, lists)
    if not len(centres):
        return Index(vectors.select("vec_id", "embedding", F.lit(0).alias("list")).limit(0), centres)

    def nearest_list(column: pd.Series) -> pd.Series:
        return pd.Series(_nearest(_directions(column), centres), index=column.index) if len(column) else pd.Series([], dtype="int32")

    own = _usable(vectors).where(F.size("embedding") == centres.shape[1])
    return Index(own.withColumn("list", F.pandas_udf(nearest_list, "int")("embedding")), centres)  # type: ignore[call-overload]


def write(index: Index, path: str) -> None:
    """The rows as Parquet, a folder per list, so that a search reads only the folders it looks into."""
    index.rows.write.partitionBy("list").parquet(path)


def search(index: Index, queries: DataFrame, k: int = 3, probes: int = 0) -> DataFrame:
    """(q_id, vec_id, similarity, rn): about the k nearest vectors of each query (q_id, q), from ``probes`` lists
    each (default: half the lists, at least 8)."""
    dim = index.centres.shape[1] if len(index.centres) else 0
    asked = queries.select("q_id", "q").where(F.size("q") == dim)
    blocks = -(-asked.count() // MAX_BROADCAST_ROWS) if dim else 0
    schema = "q_id long, vec_id long, similarity double"
    found = None
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("q_id"), F.lit(blocks)) == b)
        own = part.toPandas()  # a block of queries
        if not len(own):
            continue
        most = min(len(index.centres), probes or max(8, len(index.centres) // 2))
        best = index.rows.select("vec_id", "embedding", "list").mapInPandas(_scan(own["q_id"].to_numpy(), cosines.matrix(own["q"]), index.centres, most, k), schema)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return asked.select(F.col("q_id").cast("long"), F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rn")).limit(0)
    order = Window.partitionBy("q_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def _scan(ids: np.ndarray, q: np.ndarray, centres: np.ndarray, most: int, k: int):  # type: ignore[no-untyped-def]
    """What keeps, of a task's vectors, the k best for each query that looks into their list.

    A task holds which lists each query looks into (a byte each), the k best per query, and
    one product of bounded size.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looks = np.zeros((len(centres), len(q)), bool)
        for at in range(0, len(q), cosines.QUERIES):
            own = q[at : at + cosines.QUERIES]
            near = np.argsort(-(own / np.sqrt((own * own).sum(1))[:, None] @ centres.T), axis=1, kind="stable")[:, :most]
            looks[near, np.arange(at, at + len(own))[:, None]] = True
        parts = [(at, cosines.Best(q[at : at + cosines.QUERIES], k)) for at in range(0, len(q), cosines.QUERIES)]
        for batch in batches:
            for number, rows in batch.groupby("list"):
                for start in range(0, len(rows), cosines.ROWS):
                    some = rows.iloc[start : start + cosines.ROWS].sort_values("vec_id")
                    v = cosines.matrix(some["embedding"])
                    for at, part in parts:
                        who = np.flatnonzero(looks[int(number), at : at + cosines.QUERIES])
                        if len(who):
                            part.take(v, "vec_id", some[["vec_id"]], who)
        for at, part in parts:
            if (held := part.best()) is not None:
                yield pd.DataFrame({"q_id": ids[at + held["query"].to_numpy()], "vec_id": held["vec_id"].to_numpy(), "similarity": held["unit"].to_numpy() / 1e5})

    return run


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact (q_id, vec_id) pairs that a search found."""
    hit = exact.select("q_id", "vec_id").join(found.select("q_id", "vec_id"), ["q_id", "vec_id"], "left_semi")
    return hit.count() / max(1, exact.count())
