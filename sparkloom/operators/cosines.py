"""The exact nearest rows by cosine, by matrix products: all rows against a stated set of queries.

Each task multiplies its rows, a slice at a time, with the queries, a slice at a time; what
comes near a query's k-th best so far is scored again in the order of the components, as a sum
over an array is, and the k best are held. Only they are sent, so what a task holds and sends
is bounded by the queries, however many rows there are.

Edge cases: ties in the rounded cosine go by the rows' key; of equal vectors in a slice only the
k first can be among the best, so many copies cost no pairs; vectors of length zero have no
cosine and must be left out; all vectors must have one dimension and finite components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import MAX_BROADCAST_ROWS

#: Rows and queries of one product: its cosines take 16 MB.
ROWS, QUERIES = 2048, 1024
#: Rows that wait for the next choice of the best.
PENDING = 100_000
#: Products and sums in another order differ by far less, rounding to five places by up to half of the rest.
_MARGIN = 2e-5


def regular(column: str, dim: int):  # type: ignore[no-untyped-def]
    """Whether a vector has ``dim`` finite components and a length whose square is neither 0 nor infinite."""
    x = F.col(column)
    size = F.aggregate(x, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return F.coalesce((F.size(x) == dim) & (size > 1e-200) & (size < 1e200), F.lit(False))


def rounded(x: np.ndarray, digits: int = 5) -> np.ndarray:
    """``x`` in whole units of the last digit, halves away from zero, by its shortest decimal form as Spark has it."""
    scaled = np.abs(x) * 10.0**digits
    out = np.floor(scaled + 0.5)
    for i in np.flatnonzero(np.abs(scaled + 0.5 - np.round(scaled + 0.5)) < 1e-6):
        out[i] = float(Decimal(repr(float(abs(x[i])))).scaleb(digits).to_integral_value(ROUND_HALF_UP))
    return np.sign(x) * out


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of the rows of two matrices, each summed from the first component to the last."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def matrix(column: Iterable) -> np.ndarray:
    return np.array([np.asarray(x, np.float64) for x in column], np.float64)


class Best:
    """The k best rows of each query so far: their cosines, keys and other columns.

    What may be among them is gathered until there is ``PENDING`` of it, then the best are kept.
    """

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.length = np.sqrt(in_order(q, q))
        self.direction = q / self.length[:, None]
        self.least = np.full(len(q), -np.inf)
        self.held: list[pd.DataFrame] = []
        self.waiting, self.key = 0, ""

    def take(self, v: np.ndarray, key: str, rows: pd.DataFrame, who: np.ndarray | None = None) -> None:
        """Another slice of rows, in the order of their key, for all queries or those of some numbers."""
        _, first, same = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
        if len(first) < len(v):
            place = pd.Series(same.ravel()).groupby(same.ravel()).cumcount().to_numpy()
            v, rows = v[place < self.k], rows[place < self.k]
        length = np.sqrt(in_order(v, v))
        near = (v / length[:, None]) @ (self.direction if who is None else self.direction[who]).T
        edge = self.least if who is None else self.least[who]
        if len(v) > self.k and np.isinf(edge).any():
            edge = np.maximum(edge, np.partition(near, len(v) - self.k, axis=0)[len(v) - self.k])
        at, hit = np.nonzero(near >= edge[None, :] - _MARGIN)
        if not len(at):
            return
        hit = hit if who is None else who[hit]
        cosine = in_order(v[at], self.q[hit]) / (length[at] * self.length[hit])
        self.held.append(rows.iloc[at].reset_index(drop=True).assign(query=hit, cosine=cosine, unit=rounded(cosine)))
        self.waiting, self.key = self.waiting + len(at), key
        if self.waiting > PENDING or np.isinf(self.least).all():
            self.best()

    def best(self) -> pd.DataFrame | None:
        """The k best of each query, by rounded cosine, then by key."""
        if not self.held:
            return None
        both = pd.concat(self.held, ignore_index=True).sort_values(["query", "unit", self.key], ascending=[True, False, True], kind="stable", ignore_index=True)
        place = both.groupby("query").cumcount()
        last = both[place == self.k - 1]
        self.least[last["query"].to_numpy()] = last["unit"].to_numpy() / 1e5
        self.held, self.waiting = [both[place < self.k]], 0
        return self.held[0]


def _best(q: np.ndarray, asked: pd.DataFrame, vector: str, key: str, k: int):  # type: ignore[no-untyped-def]
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(at, Best(q[at : at + QUERIES], k)) for at in range(0, len(q), QUERIES)]
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                rows = batch.iloc[at : at + ROWS].sort_values(key)
                v = matrix(rows[vector])
                for _, part in parts:
                    part.take(v, key, rows.drop(columns=vector))
        for at, part in parts:
            if (held := part.best()) is not None:
                told = asked.iloc[at + held["query"].to_numpy()].reset_index(drop=True)
                yield pd.concat([told, held.drop(columns=["query", "unit"]).reset_index(drop=True)], axis=1)

    return run


def nearest(rows: DataFrame, vector: str, key: str, queries: DataFrame, asked: str, k: int) -> DataFrame:
    """The columns of ``queries`` and ``rows`` but their vectors, and ``cosine`` (not rounded): for each query the
    ``k`` rows of every task with the highest rounded cosine, ties by ``key``. A larger set of queries goes in blocks.
    """
    fields = [f for df, c in ((queries, asked), (rows, vector)) for f in df.schema if f.name != c]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", cosine double"
    blocks = -(-queries.count() // MAX_BROADCAST_ROWS)
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(*queries.columns), F.lit(blocks)) == b)
        own = part.toPandas()  # a block of queries
        if len(own):
            found = rows.mapInPandas(_best(matrix(own[asked]), own.drop(columns=asked), vector, key, k), schema)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.drop(vector).join(queries.drop(asked)).select(*[f.name for f in fields], F.lit(0.0).alias("cosine")).limit(0)
    return out
