"""A data source for listings: the best posts of each group, from landed pages, as a batch or a stream.

Pages are Parquet files under one folder per group (``subreddit=<name>/...``, as ``land`` writes
them). ``spark.read.format("listing").schema(...)`` reads them with one task per page; the schema
names the columns to read. Options: ``limit``, so many posts of each group, by score, then id, are
all a page gives (the whole listing's cut follows in ``top``); ``retries`` and ``wait``, how often a
page that the store refuses is asked for again, and after how many seconds, doubled each time.
Filters on the group leave out the folders of other groups, the lower bounds of a score rows.

Edge cases: posts without a group are a group of their own, posts without a score come last; an
empty or missing folder has no rows. A page that can't be read is an error; a schema with a column
``error`` asks for a row instead, with that page's group and what went wrong.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition
from pyspark.sql.types import StructType

from ..columns import fresh
from ..operators.content import first_per_group

GROUP = "subreddit"
POSTS = "id string, subreddit string, title string, score long"
#: Attempts at a page and the seconds before the second.
RETRIES, WAIT = 2, 15.0
#: Rows of a page, which a task holds whole until it has been read to its end.
PAGE_ROWS = 200_000
#: The folder of posts without a group.
NO_GROUP = "__HIVE_DEFAULT_PARTITION__"


def attempted(get: Callable[[], Any], retries: int = RETRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> Any:
    """``get()``, up to ``retries`` times while the store refuses; the last refusal is raised, so are other errors at once."""
    for attempt in range(max(1, retries)):
        try:
            return get()
        except (FileNotFoundError, PermissionError):
            raise
        except OSError:
            if attempt + 1 >= retries:
                raise
            sleep(wait * 2**attempt)


@dataclass
class Page(InputPartition):
    path: str
    group: str | None

    def __init__(self, path: str, group: str | None):
        super().__init__(path)
        self.path, self.group = path, group


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if ":/" in folder else (pafs.LocalFileSystem(), folder)


def _listed(folder: str) -> list[tuple[int, str, str | None]]:
    """(time, path, group) of each page."""
    store, root = _store(folder)
    out = []
    for info in store.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)):
        parts = info.path[len(root) :].split("/")
        if info.is_file and info.path.endswith(".parquet") and not any(p.startswith(("_", ".")) for p in parts):
            name = next((p.split("=", 1)[1] for p in parts if p.startswith(f"{GROUP}=")), NO_GROUP)
            out.append((info.mtime_ns or 0, info.path, None if name == NO_GROUP else unquote(name)))
    return sorted(out, key=lambda x: x[:2])


def _best(rows: pa.Table, limit: int) -> pa.Table:
    """The first ``limit`` rows of each group by score, then id; what has no score comes last."""
    rows = rows.sort_by([("score", "descending"), ("id", "ascending")])
    codes = pc.dictionary_encode(rows[GROUP].combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    by_group = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rows.take(np.sort(by_group[place < limit]))


class _Pages:
    """What batch and stream have in common: reading one page."""

    def __init__(self, options: dict, schema: StructType):
        self.folder = options["path"]
        self.retries, self.wait = int(options.get("retries", RETRIES)), float(options.get("wait", WAIT))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.least: int | None = None
        self.columns = [f.name for f in schema]
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)

    def rows(self, page: Page) -> Iterator[pa.RecordBatch]:
        try:
            # a page is yielded once it is read, so that a page asked for again gives its rows once
            batches = attempted(lambda: list(self._read(page)), self.retries, self.wait)
        except (OSError, pa.ArrowException) as e:
            if "error" not in self.columns:
                raise
            values = {GROUP: page.group, "error": f"{type(e).__name__}: {e}".splitlines()[0]}
            batches = pa.Table.from_pylist([{c: values.get(c) for c in self.columns}], self.schema).to_batches()
        yield from batches

    def _read(self, page: Page) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.folder)
        wanted = [c for c in self.columns if c not in (GROUP, "error")]
        best = None
        with store.open_input_file(page.path) as raw, pq.ParquetFile(raw) as file:
            held = [c for c in dict.fromkeys([*wanted, "id", "score"]) if c in file.schema_arrow.names]
            for batch in file.iter_batches(columns=held):
                rows = pa.Table.from_batches([batch])
                rows = rows.append_column(GROUP, pa.array([page.group] * len(rows), pa.string()))
                if self.least is not None:
                    rows = rows.filter(pc.greater_equal(rows["score"], self.least))
                if self.limit is None:
                    yield from self._shaped(rows)
                else:
                    best = _best(rows if best is None else pa.concat_tables([best, rows]), self.limit)
        if best is not None:
            yield from self._shaped(best)

    def _shaped(self, rows: pa.Table) -> list[pa.RecordBatch]:
        columns = [rows[f.name].cast(f.type) if f.name in rows.column_names else pa.nulls(len(rows), f.type) for f in self.schema]
        return pa.Table.from_arrays(columns, schema=self.schema).to_batches()


class PageReader(_Pages, DataSourceReader):
    groups: set | None = None

    def pushFilters(self, filters: list[Filter]):  # type: ignore[no-untyped-def]
        """Narrows groups and scores; Spark still applies every filter itself."""
        for f in filters:
            match f:
                case EqualTo((name,), value) if name == GROUP:
                    self._narrow([value])
                case In((name,), values) if name == GROUP:
                    self._narrow(values)
                case (GreaterThanOrEqual(("score",), value) | GreaterThan(("score",), value)) if isinstance(value, int):
                    self.least = value if self.least is None else max(self.least, value)
            yield f

    def _narrow(self, values) -> None:  # type: ignore[no-untyped-def]
        # the empty name has no folder of its own
        wanted = {v or None for v in values}
        self.groups = wanted if self.groups is None else self.groups & wanted

    def partitions(self) -> list[InputPartition]:
        found = attempted(lambda: _listed(self.folder), self.retries, self.wait)
        return [Page(path, group) for _, path, group in found if self.groups is None or group in self.groups]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        if partition is not None:  # without pages Spark asks once, for nothing
            yield from self.rows(partition)


class PageStream(_Pages, DataSourceStreamReader):
    """Pages in the order in which they landed; those younger than ``settle`` seconds wait for the next batch."""

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        if self.limit is not None:
            raise ValueError("a stream has no limit: its listing is never whole")
        self.settle = float(options.get("settle", 1.0))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.settle * 1e9)
        landed = [(t, p) for t, p, _ in _listed(self.folder) if t <= until]
        return {"time": landed[-1][0], "path": landed[-1][1]} if landed else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = (start["time"], start["path"]), (end["time"], end["path"])
        return [Page(p, g) for t, p, g in _listed(self.folder) if first < (t, p) <= last]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:  # type: ignore[override]
        yield from self.rows(partition)


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return POSTS

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options, schema)

    def streamReader(self, schema: StructType) -> PageStream:
        return PageStream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make the format known to the session; its filters are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Listing)


def land(posts: DataFrame, folder: str) -> None:
    """Append posts as pages of at most ``PAGE_ROWS`` rows, a folder per group."""
    posts.write.mode("append").option("maxRecordsPerFile", PAGE_ROWS).partitionBy(GROUP).parquet(folder)


def top(spark: SparkSession, folder: str, limit: int, groups: list[str] | None = None, schema: str = POSTS, **options) -> DataFrame:  # type: ignore[no-untyped-def]
    """The best ``limit`` posts of each group: cut page by page, then over what the pages give."""
    register(spark)
    pages = spark.read.format("listing").schema(schema).options(limit=limit, **options).load(folder)
    if groups is not None:
        pages = pages.where(F.col(GROUP).isin(groups))
    if "error" in pages.columns:
        failed = fresh("failed", pages)
        pages = pages.withColumn(failed, F.col("error").isNotNull())
        best = first_per_group(pages, [GROUP, failed], [F.desc_nulls_last("score"), F.col("id")], limit)
        return pages.where(failed).drop(failed).unionByName(best.where(~F.col(failed)).drop("rn", failed))
    return first_per_group(pages, [GROUP], [F.desc_nulls_last("score"), F.col("id")], limit).drop("rn")
