"""Helpers over whole rows: names that clash with nothing, first rows, counted broadcasts, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .session import cut_lineage

#: Rows of a side that may be broadcast.
MAX_BROADCAST_ROWS = 10_000


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of the frames (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_order(df: DataFrame) -> list[Column]:
    """A total order of rows up to equal ones: every column, those without an order of their own as JSON."""
    return [F.col(f"`{f.name}`") if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(F.col(f"`{f.name}`"))) for f in df.schema]


def first_rows(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per key: the first by ``order``, then by all columns; the same one however the rows are dealt.

    Columns that have an order of their own are sent once, as rank and as value.
    """
    rank = ([F.col(order)] if order else []) + whole_order(df)
    first, kept = len(rank) - len(df.columns), fresh("row", df)
    plain = [isinstance(f.dataType, AtomicType) for f in df.schema]
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(rank)])
    if all(plain):
        best = F.min(ranked)
        values = [F.col(f"{kept}.o{first + i}").alias(c) for i, c in enumerate(df.columns)]
    else:
        other = [F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(df.columns) if not plain[i]]
        best = F.min_by(F.struct(ranked.alias("r"), *other), ranked)
        values = [F.col(f"{kept}.r.o{first + i}" if plain[i] else f"{kept}.v{i}").alias(c) for i, c in enumerate(df.columns)]
    return df.groupBy(*keys).agg(best.alias(kept)).select(*values)


def counted(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with the place of each row in the order, from 0, over range partitions: no task sees all rows."""
    own = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn(name, F.monotonically_increasing_id())
    part, before = fresh("part", own), fresh("before", own)
    sizes = {r[0]: r[1] for r in own.groupBy(F.shiftright(name, 33)).agg(F.count(F.lit(1))).collect()}  # one row per partition
    starts, at = [], 0
    for p in sorted(sizes):
        starts.append((p, at))
        at += sizes[p]
    offsets = df.sparkSession.createDataFrame(starts or [(0, 0)], f"{part} long, {before} long")
    return own.withColumn(part, F.shiftright(name, 33)).join(F.broadcast(offsets), part).withColumn(name, F.col(before) + F.col(name).bitwiseAND((1 << 33) - 1)).drop(part, before)


#: Bins of one round of ``median``.
MEDIAN_BINS = 4096


def median(df: DataFrame, column: Column) -> float | None:
    """The exact median of a numeric column (of two middle values the mean), null where there is none.

    By narrowing histograms: a round counts the values in equal bins, with the least and largest
    of each, and goes on inside the bin that holds the wanted rank. What crosses the network is
    bins, never values; no task sees more than its own rows.
    """
    values = df.select(column.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    least, largest, n = values.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()  # type: ignore[misc]
    if not n:
        return None
    ranks = sorted({(n - 1) // 2, n // 2})
    found = []
    for rank in ranks:
        low, high, before = least, largest, 0
        while low < high:
            width = (high - low) / MEDIAN_BINS
            place = F.least(F.floor((F.col("v") - low) / width), F.lit(MEDIAN_BINS - 1)) if 0 < width < float("inf") else F.when(F.col("v") <= low / 2 + high / 2, 0).otherwise(1)
            inside = values.where((F.col("v") >= low) & (F.col("v") <= high))
            for _, a, b, count in sorted(inside.groupBy(place.alias("bin")).agg(F.min("v"), F.max("v"), F.count(F.lit(1))).collect()):  # a row per bin
                if before + count > rank:
                    low, high = a, b
                    break
                before += count
        found.append(low)
    return sum(found) / len(found)
