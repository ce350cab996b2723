"""Incremental ingest: file streams, de-duplication, keyed upserts, running trends.

State is what the sinks hold: a run that starts again from its checkpoint writes the
same rows again and the keys absorb them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from ..columns import first_rows, fresh
from ..sources.sinks import new_rows, upsert


def stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def timed(rows: DataFrame, column: str = "ts", late: str = "1 day") -> DataFrame:
    """With a watermark; a time without zone is read in the session's zone first."""
    return rows.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def deduplicated(rows: DataFrame, key: str) -> DataFrame:
    return rows.dropDuplicatesWithinWatermark([key])


def daily_trend(rows: DataFrame, time: str = "ts", label: str = "event_type") -> DataFrame:
    """Counts by day and label, each day final once the watermark has passed it."""
    return rows.groupBy(F.window(time, "1 day"), label).agg(F.count(F.lit(1)).alias("cnt")).select(F.col("window.start").alias("period"), label, "cnt")


#: What ``as_instant`` and ``as_local`` count from.
_INSTANT, _LOCAL = "timestamp'1970-01-01T00:00:00Z'", "timestamp_ntz'1970-01-01 00:00:00'"


def as_instant(column: str) -> Column:
    """A time without zone as the instant at which UTC clocks show it, whatever the session's zone."""
    return F.expr(f"{_INSTANT} + (`{column}` - {_LOCAL})")


def as_local(column: str) -> Column:
    """What UTC clocks show at an instant; undoes ``as_instant``."""
    return F.expr(f"{_LOCAL} + (`{column}` - {_INSTANT})")


def closed_trend(rows: DataFrame, key: str, target: str, checkpoint: str, time: str = "ts", label: str = "event_type", late: str = "1 day") -> StreamingQuery:
    """Append (period, label, cnt) to ``target`` for every day that is closed: the watermark, ``late`` behind the
    newest time seen, has passed it. Rows with one key count once.

    State is bounded by the watermark: keys are held for ``late`` beyond their row's time, counts for the days that
    are still open. A row that comes in behind the watermark, a repeat or not, is dropped. What is out
    of order within one batch is never late: the watermark moves between batches. A run goes on from
    its checkpoint, and the file sink's log writes each batch once.

    Rows without a time belong to no day; rows without a key are told apart by all their columns;
    a label that is null is a label; without rows nothing is appended.
    """
    if isinstance(rows.schema[time].dataType, TimestampNTZType):
        rows = rows.withColumn(time, as_instant(time))
    other = fresh("other", rows)
    marked = rows.where(F.col(time).isNotNull()).withColumn(other, F.when(F.col(key).isNull(), F.sha2(F.to_json(F.struct(*rows.columns)), 256)))
    once = marked.withWatermark(time, late).dropDuplicatesWithinWatermark([key, other])
    return daily_trend(once, time, label).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_unseen(rows: DataFrame, key: str, target: str, checkpoint: str) -> StreamingQuery:
    """Append the rows whose key the target doesn't have yet, batch by batch."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(target)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            first_rows(batch, [key]).write.parquet(target)
            return
        new_rows(batch, seen, key).write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_versions(rows: DataFrame, keys: list[str], order: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row per key; every batch writes a new version folder ``v=<batch>``."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number == 0:
            latest = upsert(batch.limit(0), batch, keys, order)
        else:
            latest = upsert(spark.read.parquet(f"{target}/v={number - 1}"), batch, keys, order)
        latest.write.mode("overwrite").parquet(f"{target}/v={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class BucketedTable:
    """A keyed table in buckets by a hash of the key, of which an upsert rewrites only those it touches.

    ``data/`` holds folders of bucket files, ``manifest/<number>.json`` says which folder each
    bucket is read from. An upsert writes the touched buckets to a new folder, then the manifest
    under a name of its own, then renames it: readers see all of a batch or nothing. A batch
    whose manifest stands is done, so a stream that starts again skips it; data without a
    manifest (a crash in between) is never read, and ``vacuum`` removes it. One stream writes a
    table at a time; its batch numbers are the manifests'.

    Rows without a key are a key of their own, repeated keys leave the row with the highest
    ``order`` (ties: the incoming row, then the last by all columns), an empty batch writes a
    manifest and no data.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: list[str], order: str | None = None, buckets: int = 64):  # type: ignore[no-untyped-def]
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.empty = spark.createDataFrame([], schema)
        self.bucket = fresh("bucket", self.empty)

    def _fs(self, path: str):  # type: ignore[no-untyped-def]
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _listed(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._listed("manifest") if n.endswith(".json"))

    def manifest(self) -> dict[str, str]:
        """Folder of each bucket that has rows, by the newest manifest."""
        done = self.versions()
        if not done:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest/{done[-1]}.json", wholetext=True).collect()))  # one file

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.empty.schema).parquet(*folders) if folders else self.empty

    def rows(self) -> DataFrame:
        return self._read([f"{self.path}/{f}" for f in self.manifest().values()])

    def upsert(self, batch: DataFrame, number: int) -> None:
        if number in self.versions():
            return
        held = self.manifest()
        key = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in batch.select(key).distinct().collect()]  # a row per bucket
        if touched:
            old = self._read([f"{self.path}/{held[str(b)]}" for b in touched if str(b) in held])
            latest = upsert(old, batch.select(*self.empty.columns), self.keys, self.order)
            folder = f"data/{number}-{uuid.uuid4().hex}"
            latest.withColumn(self.bucket, key).repartition(min(len(touched), self.buckets), self.bucket).write.partitionBy(self.bucket).parquet(f"{self.path}/{folder}")
            held = held | {str(b): f"{folder}/{self.bucket}={b}" for b in touched}
        self._swap(number, held)

    def _swap(self, number: int, held: dict[str, str]) -> None:
        fs, there = self._fs(f"{self.path}/manifest/{number}.json")
        _, made = self._fs(f"{self.path}/manifest/.{number}-{uuid.uuid4().hex}")
        out = fs.create(made)
        out.write(bytearray(json.dumps(held).encode()))
        out.close()
        if not fs.rename(made, there):
            raise OSError(f"manifest {number} was not put in place")

    def vacuum(self) -> list[str]:
        """Remove data folders that the newest manifest doesn't name; what was removed. No reader may be at older rows."""
        named = {f.split("/")[1] for f in self.manifest().values()}
        gone = [n for n in self._listed("data") if n not in named]
        for n in gone:
            fs, p = self._fs(f"{self.path}/data/{n}")
            fs.delete(p, True)
        return gone


def upsert_stream(rows: DataFrame, table: BucketedTable, checkpoint: str) -> StreamingQuery:
    """Upsert a stream into a bucketed table, batch by batch; what has come in so far, then it ends."""
    return rows.writeStream.foreachBatch(lambda batch, number: table.upsert(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
