"""Paged pulls: a feed that gives its records page by page, as a table or as a stream that resumes at a stored page.

Tasks ask for the pages, within limits on calls (see `model.Limits`). `pull` writes what it gets and its place in the feed;
a call that ended early, or a feed that has grown, goes on from there.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siftstone.folders import exists
from siftstone.sources.listing import _local
from siftstone.sources.model import Asking, Limits

SCHEMA = "page bigint, position int, record string"
_ARROW = pa.schema([("page", pa.int64()), ("position", pa.int32()), ("record", pa.string())])


class PageClient(Protocol):
    def pages(self) -> int:
        """How many pages the feed has now; it never falls."""
        ...

    def page(self, number: int) -> list[str]:
        """The records of a page, from 0 on. Raises `model.Refused` where it should be asked again later."""
        ...


class RecordedPages:
    """Pages kept as files of a folder, one record a line: the n-th file by name is page n. Names that begin with _ or . don't count."""

    def __init__(self, folder: str):
        local = _local(folder)
        self.store, self.folder = (arrow_fs.LocalFileSystem(), local) if local is not None else (arrow_fs.FileSystem.from_uri(folder)[0], urlsplit(folder).path)
        infos = self.store.get_file_info(arrow_fs.FileSelector(self.folder, allow_not_found=True))
        self.files = sorted(i.path for i in infos if i.type == arrow_fs.FileType.File and i.base_name[0] not in "_.")

    def pages(self) -> int:
        return len(self.files)

    def page(self, number: int) -> list[str]:
        with self.store.open_input_stream(self.files[number]) as f:
            text = f.read().decode("utf-8", "replace")
        return text.removesuffix("\n").split("\n") if text else []


class Stretch(InputPartition):
    """Pages from one up to another one, every `step`-th."""

    def __init__(self, first: int, end: int, step: int):
        self.first, self.end, self.step = first, end, step


def stretches(first: int, end: int, tasks: int) -> list[Stretch]:
    """The pages dealt to at most `tasks` tasks, in turn, so that one slow part of a feed is shared out; one empty stretch without pages."""
    n = max(min(tasks, end - first), 1)
    return [Stretch(first + k, end, n) for k in range(n)]


def fetched(client: Callable[[], PageClient], limits: Limits, part: Stretch) -> Iterator[pa.RecordBatch]:
    """Rows of the stretch's pages, some pages side by side; a page without records leaves one row with nulls. A page that can't be had ends the task."""
    asking = Asking(client, limits, None if limits.per_second is None else limits.per_second / max(limits.tasks, 1))
    numbers = list(range(part.first, part.end, part.step))
    for at in range(0, len(numbers), limits.at_once):
        some = numbers[at : at + limits.at_once]
        for number, (records, error) in zip(some, asking.answers([lambda c, n=n: c.page(n) for n in some])):
            if records is None:
                raise RuntimeError(f"page {number}: {error}")
            rows = records or [None]
            yield pa.record_batch([pa.array([number] * len(rows), pa.int64()), pa.array(range(len(rows)) if records else [None], pa.int32()), pa.array(rows, pa.string())], schema=_ARROW)


def source(client: Callable[[], PageClient], limits: Limits = Limits(tasks=8), window: int = 100, done: int = 0) -> type[DataSource]:
    """A data source of the feed, for reading once or as a stream whose batches have at most `window` pages.

    done: pages that an earlier run of the stream has stored; the stream's own log says where it goes on, and this keeps the
    first window behind that place.
    """
    title = f"pages_{uuid.uuid4().hex}"

    class Once(DataSourceReader):
        def partitions(self):
            return stretches(0, client().pages(), limits.tasks)

        def read(self, partition):
            return fetched(client, limits, partition)

    class Growing(DataSourceStreamReader):
        def __init__(self):
            self.done = done

        def initialOffset(self):
            return {"page": 0}

        def latestOffset(self):
            return {"page": max(self.done, min(self.done + window, client().pages()))}

        def partitions(self, start, end):
            self.done = max(self.done, end["page"])
            return stretches(start["page"], end["page"], limits.tasks)

        def read(self, partition):
            return fetched(client, limits, partition)

    class Pages(DataSource):
        @classmethod
        def name(cls):
            return title

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            return Once()

        def streamReader(self, schema):
            return Growing()

    return Pages


def read(spark: SparkSession, client: Callable[[], PageClient], limits: Limits = Limits(tasks=8)) -> DataFrame:
    """(page, position, record) of all pages that the feed has now; lazy, so every action asks again."""
    feed = source(client, limits)
    spark.dataSource.register(feed)
    return spark.read.format(feed.name()).load().where("position IS NOT NULL")


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """What `pull` has written so far, with the rows of empty pages; null without any."""
    return spark.read.schema(SCHEMA).parquet(f"{folder}/records") if exists(spark, f"{folder}/records/_spark_metadata/0") else None


def pull(spark: SparkSession, client: Callable[[], PageClient], folder: str, limits: Limits = Limits(tasks=8), window: int = 100) -> DataFrame:
    """(page, position, record) of the feed, each page asked for once and kept in `folder`, which driver and executors share.

    Pages come in windows; a whole window is written, or nothing of it. A call that fails (a page that can't be had, a lost
    driver) leaves the windows before, and the next call with the same folder goes on behind them, as it does when the feed
    has grown. One call at a time may work on a folder. A feed without pages gives no rows; records keep their order by
    (page, position), repeated records stay.
    """
    had = stored(spark, folder)
    done = 0 if had is None else had.agg(F.coalesce(F.max("page") + 1, F.lit(0))).first()[0]
    feed = source(client, limits, window, done)
    spark.dataSource.register(feed)
    stream = spark.readStream.format(feed.name()).load()
    running = stream.writeStream.format("parquet").option("path", f"{folder}/records").option("checkpointLocation", f"{folder}/progress").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    rows = stored(spark, folder)
    return (spark.createDataFrame([], SCHEMA) if rows is None else rows).where("position IS NOT NULL")
