"""Sinks: append what is new, keyed upsert, CSV, JSON, graphs, vectors and ledgers of ids.

An upsert keeps one row per key, the one with the highest ``order`` value. It writes
to a new folder: the caller swaps it in, so readers never see half a table. Of rows
that tie the first or last by all columns counts, so the outcome never depends on how
the rows are dealt.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..columns import first_rows, fresh, whole_order


def new_rows(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key isn't in ``existing``; of equal keys the first by all columns."""
    return first_rows(incoming, [key]).join(existing.select(key), key, "left_anti").select(*incoming.columns)


def append_new(incoming: DataFrame, existing: DataFrame, key: str, path: str) -> None:
    new_rows(incoming, existing, key).write.mode("append").parquet(path)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Both tables, one row per key: the one with the highest ``order``, of these the incoming one.

    Rows that still tie are ranked by all their columns, the last one counts.
    """
    new, place = fresh("new", existing, incoming), fresh("place", existing, incoming)
    both = existing.withColumn(new, F.lit(0)).unionByName(incoming.withColumn(new, F.lit(1)))
    rank = [F.col(order).desc_nulls_last()] if order else []
    best = Window.partitionBy(*keys).orderBy(*rank, F.desc(new), *[c.desc() for c in whole_order(existing)])
    return both.withColumn(place, F.row_number().over(best)).where(F.col(place) == 1).drop(place, new)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines; with ``by`` one folder per value, of which only those in ``df`` are replaced."""
    writer = df.write.mode("overwrite")
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy(by) if by else writer).json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table that may not be there yet: then it has no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


DONE = "chunk_id string"


def done_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the chunks that earlier runs have taken."""
    return stored(spark, path, DONE).distinct()


def mark_done(chunks: DataFrame, path: str) -> None:
    """Add the chunks' ids to those taken; an id that is added twice counts once."""
    chunks.select(F.col("chunk_id").cast("string").alias("chunk_id")).write.mode("append").parquet(path)
