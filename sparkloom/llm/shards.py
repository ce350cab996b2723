"""Shards of equal bytes, by sampled splitters.

Rows are ordered by (digest of the text, doc_id, row number), so equal texts stand
together and a shard is a fair mix of everything else. A sample in which a row's chance
grows with its weight (its bytes, and the mean of all rows for the row itself) is numbered
in that order by Spark, and every ``PER_RANGE``-th key becomes a splitter: the ranges in
between weigh about the same. Ranges that turn out overfull are sampled again, each sampled
key a splitter, until none is left; what one row weighs alone doesn't count, since it can't be
divided. A group of equal texts, and of repeated doc_ids, is cut like anything else.

The ranges' exact bytes add up to what stands before each, and the rows of a range are
dealt to one task, ordered and summed: a row's middle byte says which shard it falls into.
So shards differ by no more than the rows at their edges, however rough the sample was.
The driver holds splitters, sums and offsets: some numbers per range, of which there are
``shards * 16`` or four per task, or one per ``RANGE_BYTES`` of text where that is more.

Edge cases: a null text has no bytes and size 1, like an empty one; rows without a doc_id
come first among equal texts; repeated rows are rows of their own; a very long text is kept
whole, and a shard may hold nothing where one text is longer than a shard's share; an
empty table gives an empty result; the record holds all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import numbered
from ..session import cut_lineage

SHARDS = 8
#: Sampled keys per range; more give more even ranges.
PER_RANGE = 8
RANGE_BYTES = 64_000_000
#: A range is overfull at this many times the mean weight.
OVERFULL = 2
KEY = ["lot", "id", "row"]


def text_order(text: Column) -> Column:
    """The first 60 bits of the text's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def size_of(text: Column) -> Column:
    """UTF-8 bytes and one."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _packed(lot: np.ndarray, ident: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The three numbers as 24 bytes that sort as they do."""
    out = np.empty((len(lot), 3), ">u8")
    for k, part in enumerate((lot, ident, row)):
        out[:, k] = np.asarray(part, np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out.view("S24").ravel()


def _range_of(splitters: np.ndarray) -> Column:
    """The number of a row's range: how many splitters are at or before its key."""

    def run(lot: pd.Series, ident: pd.Series, row: pd.Series) -> pd.Series:
        keys = _packed(lot.to_numpy(), ident.to_numpy(), row.to_numpy())
        return pd.Series(np.searchsorted(splitters, keys, side="right").astype(np.int32))

    return F.pandas_udf(run, "int")(*KEY)  # type: ignore[call-overload]


def _drawn(keys: DataFrame, weight: Column, target: float, salt: int, every: int = PER_RANGE) -> np.ndarray:
    """Splitters: of a weighted sample, ``every`` for ``target`` of weight, every so many-th key in order."""
    chance = weight * (every / target)
    lot = F.pmod(F.xxhash64(*KEY, F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)
    placed = numbered(keys.where(lot < chance).select(*KEY), KEY, "place")
    rows = placed.where(F.col("place") % every == every // 2).select(*KEY).toPandas()  # one row per range
    return np.sort(_packed(*(rows[c].to_numpy(np.int64) for c in KEY)))


def _range_sums(keys: DataFrame, splitters: np.ndarray) -> pd.DataFrame:
    """bytes, rows and largest size per range, in order; ranges without rows have zeros."""
    sums = keys.select(_range_of(splitters).alias("range"), "size").groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.max("size").alias("largest"))
    return sums.toPandas().set_index("range").reindex(range(len(splitters) + 1), fill_value=0).astype("int64")  # one row per range


def split_points(keys: DataFrame, n_ranges: int, total: int, n_rows: int) -> tuple[np.ndarray, pd.DataFrame]:
    """Splitters between ranges of which none is overfull, and the ranges' sums."""
    mean = total // n_rows
    weight = F.col("size") + F.lit(mean)
    target = (total + mean * n_rows) / n_ranges
    splitters, salt = _drawn(keys, weight, target, 0), 0
    while True:
        sums = _range_sums(keys, splitters)
        heavy = np.flatnonzero(sums["bytes"] + mean * (sums["rows"] - 1) - sums["largest"] > OVERFULL * target)
        if not len(heavy):
            return splitters, sums
        salt += 1
        inside = keys.withColumn("range", _range_of(splitters)).join(F.broadcast(keys.sparkSession.createDataFrame([(int(h),) for h in heavy], "range int")), "range", "left_semi")
        # Here each sampled key splits, so that a range of a few heavy rows comes apart too.
        splitters = np.unique(np.concatenate([splitters, _drawn(inside, weight, target, salt, 1)]))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(record, size, shard, slot): each row of ``docs`` as a struct, its shard and its place there, from 0."""
    spark = docs.sparkSession
    # Written with a number of their own, by which equal rows are told apart in all passes.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"))
    keyed = whole.select("record", text_order(F.col("record.text")).alias("lot"), F.coalesce(F.col("record.doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), size_of(F.col("record.text")).alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = cut_lineage(keyed)
    keys = cut_lineage(rows.select(*KEY, "size"))
    n_rows, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()  # type: ignore[misc]
    if not n_rows:
        return rows.select("record", "size", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    splitters, sums = split_points(keys, max(16 * shards, 4 * parts, total // RANGE_BYTES), total, n_rows)
    offsets = _offsets(keys, splitters, sums, total, shards)
    placed = _inside(rows.withColumn("range", _range_of(splitters)), offsets, total, shards)
    slot = F.element_at("bases", F.col("shard") - F.col("low") + 1) + F.col("rn")
    return placed.select("record", "size", "shard", slot.alias("slot"))


def _inside(ranged: DataFrame, offsets: DataFrame, total: int, shards: int) -> DataFrame:
    """The rows with their number inside the range (from 0) and their shard."""
    order = Window.partitionBy("range").orderBy(*KEY)
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    own = ranged.withColumn("ahead", before).withColumn("rn", F.row_number().over(order) - 1).join(F.broadcast(offsets), "range")  # a row per range
    middle = 2 * (F.col("bytes_before") + F.col("ahead")) + F.col("size")
    # Whole numbers throughout, in one division.
    return own.withColumn("middle", middle).withColumn("shard", F.expr(f"cast(least({shards - 1}L, ({shards}L * middle) div {2 * total}L) as int)"))


def _offsets(keys: DataFrame, splitters: np.ndarray, sums: pd.DataFrame, total: int, shards: int) -> DataFrame:
    """Per range: bytes before it, its lowest shard, and per shard in it what to add to a row's number to get its slot."""
    spark = keys.sparkSession
    held = [(int(r), int(s["bytes"]), int(s["rows"])) for r, s in sums.iterrows() if s["rows"]]
    schema = "range int, bytes_before long, low int, bases array<long>"
    at, ranges = 0, []
    for r, size, n in held:
        low = min(shards - 1, shards * (2 * at + 1) // (2 * total))
        high = min(shards - 1, shards * (2 * (at + size) - 1) // (2 * total))
        ranges.append((r, at, low, high, n))
        at += size
    # Ranges that an edge may cut are summed by shard: no more of them than there are edges.
    cut = [(r, b, low, [0]) for r, b, low, high, _ in ranges if low != high]
    counts: dict[int, dict[int, int]] = {}
    if cut:
        edge = spark.createDataFrame(cut, schema)
        near = keys.withColumn("range", _range_of(splitters)).join(F.broadcast(edge.select("range")), "range", "left_semi")
        for r, s, n in _inside(near, edge, total, shards).groupBy("range", "shard").agg(F.count(F.lit(1))).collect():  # a few rows per edge
            counts.setdefault(r, {})[s] = n
    have, out = [0] * shards, []
    for r, b, low, high, n in ranges:
        own = counts.get(r, {low: n})
        bases, below = [], 0
        for s in range(low, high + 1):
            bases.append(have[s] - below)
            below += own.get(s, 0)
            have[s] += own.get(s, 0)
        out.append((r, b, low, bases))
    return spark.createDataFrame(out, schema)


def write(found: DataFrame, path: str, shard: str = "shard") -> None:
    """The records as Parquet, one folder per shard; ``shard`` names the folders' column."""
    found.select("record.*", F.col("shard").alias(shard)).write.partitionBy(shard).parquet(path)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, size, checksum of the text as it lies in its shard, law, shard and slot."""
    text = F.coalesce(F.col("record.text"), F.lit("")).cast("binary")
    return found.select(F.col("record.doc_id").alias("doc_id"), "size", F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
