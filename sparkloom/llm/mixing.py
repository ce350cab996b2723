"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words and a schedule: how its weight changes
over the training time u from 0 to 1. The integral of the schedule, scaled to the
target, is the source's cumulative demand D(u). Documents of a source stand in a
fixed pseudo-random order; the word at cumulative count c is due at D^-1(c). A
source whose target is above its size runs through its documents again.

No step gathers a source in one task: documents are cut by (source, slice of the
pseudo-random order), slice totals are summed with map-side combining, and only
the small table of slice totals is prefix-summed over whole sources.

Edge cases: a null text has size 0; a null source is a source of its own, last in
order; a document of size 0 is never taken and has no position; repeated rows are
placed separately; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import fresh
from ..session import cut_lineage
from .common import WORD, whole_text

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more often than this.
MAX_EPOCHS = 3
#: Schedules by rank of the source, repeating: weight at u = 0, at u = 1/2, at u = 1.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Rows that one slice of a source's order holds on average, at most.
SLICE_ROWS = 1_000
_SLICES = 65_536


def word_count(text: Column) -> Column:
    """Number of words of a text."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, n_docs, source_size, rank, weight and target.

    All sizes together are shared by weight; a target stops at ``MAX_EPOCHS`` times
    its source's size and the excess is shared again by weight. That fixed point is
    found in one pass over the sources in order of cap / weight, the order in which
    they fill up.
    """
    every = Window.partitionBy()
    ranked = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("rank") % len(WEIGHTS) + 1)
    before = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    filled = (
        ranked.withColumn("weight", weight)
        .withColumn("cap", MAX_EPOCHS * F.col("source_size"))
        .withColumn("fills_at", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("full", F.col("cap").cast("double") * open_weight.cast("double") <= F.col("weight").cast("double") * left.cast("double"))
    )
    rest = F.sum("source_size").over(every) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    rest_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    level = rest.cast("double") / F.nullif(rest_weight, F.lit(0)).cast("double")
    return filled.withColumn("target", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * level)).select("source", "n_docs", "source_size", "rank", "weight", "target")


def due(share: Column, schedule: tuple[float, float, float]) -> Column:
    """Training time at which a source has used up ``share`` of its target.

    The schedule is linear between its knots, so its integral is quadratic on each
    half; the inverse is the root that stays exact where the slope is zero.
    """
    first, middle, last = schedule
    half, whole = (first + middle) / 4, (first + 2 * middle + last) / 4

    def inverse(area: Column, start: float, end: float) -> Column:
        return 2 * area / (start + F.sqrt(F.greatest(F.lit(0.0), F.lit(start * start) + area * (4 * (end - start)))))

    area = share * whole
    return F.when(area <= half, inverse(area, first, middle)).otherwise(0.5 + inverse(area - half, middle, last))


def place(docs: DataFrame, schedules: tuple = SCHEDULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, taken and position of every row, and the columns ``keep``.

    ``epochs`` is how often the mix takes the document, ``position`` the training
    time in [0, 1] at which it first comes up, null if it never does.
    """
    sized = cut_lineage(docs.select("doc_id", "source", word_count(whole_text()).alias("size"), *keep))
    targets = cut_lineage(source_targets(sized))
    most = targets.agg(F.max("n_docs")).first()[0] or 0
    n_slices = min(_SLICES, 1 << max(0, int(most // SLICE_ROWS)).bit_length())
    lot = F.md5(F.col("doc_id").cast("string"))
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), "source"))
    dealt = sized.select("*", key.alias("key"), F.coalesce(lot, F.lit("")).alias("lot")).withColumn("slice", F.floor(F.coalesce(F.conv(F.substring("lot", 1, 4), 16, 10).cast("long"), F.lit(0)) * n_slices / _SLICES))
    sums = dealt.groupBy("key", "slice").agg(F.sum("size").alias("slice_size"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0))).join(targets.select(key.alias("key"), "source_size", "rank", "target"), "key")
    inside = Window.partitionBy("key", "slice").orderBy("lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["key", "slice"])
    middle = F.col("offset") + F.col("inside") + F.col("size") / 2.0
    epochs = sum((F.when(middle + F.lit(e) * F.col("source_size") <= F.col("target"), 1).otherwise(0) for e in range(MAX_EPOCHS)), F.lit(0))
    chosen = F.when(F.col("size") > 0, epochs).otherwise(0)
    share = middle / F.col("target")
    position = F.coalesce(*[F.when(F.col("rank") % len(schedules) == k, due(share, s)) for k, s in enumerate(schedules)])
    return (
        run.withColumn("epochs", chosen.cast("long"))
        .withColumn("position", F.when(F.col("epochs") > 0, F.round(position, 9)))
        .select("doc_id", "source", "size", "source_size", "target", "rank", "epochs", (F.col("epochs") * F.col("size")).alias("taken"), middle.alias("middle"), "position", *keep)
    )


def range_sorted(placed: DataFrame) -> DataFrame:
    """The rows in order of position over range partitions; untaken rows last.

    doc_id is part of the range key, so that the many untaken rows don't share one.
    """
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


def curriculum(docs: DataFrame, schedules: tuple = SCHEDULES) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as it is taken, in training order.

    Rows count by themselves: repeated doc_ids and null ones are taken like any other.
    ``docs``' columns, whatever their names, come back unchanged; rows without a word are
    never taken; no rows give none.
    """
    row, at, nth = fresh("row", docs), fresh("due", docs), fresh("nth", docs)
    # The key must be the same in both uses below, so the rows are written with it.
    keyed = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    placed = place(keyed.select("doc_id", "source", "text", F.col(row).alias("row")), schedules, keep=("row",)).where("epochs > 0")
    again = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), (F.col("epochs") - 1).cast("int"))))
    share = (F.col("middle") + F.col("epoch") * F.col("source_size")) / F.col("target")
    when = F.coalesce(*[F.when(F.col("rank") % len(schedules) == k, due(share, s)) for k, s in enumerate(schedules)])
    times = again.select(F.col("row").alias(row), F.round(when, 9).alias(at), F.col("epoch").alias(nth))
    order = [at, "doc_id", row]
    return keyed.join(times, row).repartitionByRange(*order).sortWithinPartitions(*order, nth).select(*docs.columns)
