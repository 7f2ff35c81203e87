"""Listing a tree of files by tasks, level by level.

Folders of a level are dealt to tasks, which list them; what they find is written, and folders found there are the next
level. Ignored folders are never entered. Unlike Spark's own readers this sees empty files, says of every file why it was
skipped, and holds no list of files on the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from operator import or_
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.folders import file_system, work_folder
from siftstone.sources.files import EMAIL, IMAGE, TEXT, ignored, kind_of, scan_root

#: Bytes of a file without a known extension that tell its kind.
HEAD = 512
#: Rows that the driver writes at once, where it lists.
CHUNK = 20_000
ENTRIES = "path string, relative string, folder boolean, size bigint, modified bigint, head binary, error string"
KNOWN = {*TEXT, *IMAGE, *EMAIL}


def ignored_folder(relative: Column, patterns: list[str]) -> Column:
    """Whether all that lies in a folder is ignored, so that it needn't be entered."""
    tests = [F.lit(False)]
    for p in patterns:
        if "*" not in p:
            tests.append(ignored(relative, [p]))
        elif p.endswith("**") and p.count("**") == 1 and not p.startswith("*."):
            tests.append(F.concat(relative, F.lit("/")).startswith(p[:-2].rstrip("/")))
    return reduce(or_, tests)


def _local(path: str) -> str | None:
    """A path of this machine's file system; null for others."""
    parts = urlsplit(path)
    return None if parts.scheme not in ("", "file") else path[5:] if path.startswith("file:/") and not path.startswith("file://") else re.sub("^file://", "", path)


def _known(name: str) -> bool:
    return "." in name[1:] and name.rsplit(".", 1)[-1].lower() in KNOWN


def _start(opened) -> bytes:
    with opened as f:
        return f.read(HEAD)


def _entries(folder: str, relative: str) -> Iterator[tuple]:
    """(path, relative, folder, size, modified, head, error) of what lies in a folder; links are passed over."""
    below = f"{relative}/" if relative else ""
    if (local := _local(folder)) is not None:
        with os.scandir(local) as found:
            for e in sorted(found, key=lambda e: e.name):
                if e.is_dir(follow_symlinks=False):
                    yield f"{folder.rstrip('/')}/{e.name}", below + e.name, True, None, None, None, None
                elif e.is_file(follow_symlinks=False):
                    try:
                        stat = e.stat(follow_symlinks=False)
                        head = None if _known(e.name) or not stat.st_size else _start(open(e.path, "rb"))
                        yield f"{folder.rstrip('/')}/{e.name}", below + e.name, False, stat.st_size, stat.st_mtime_ns // 1000, head, None
                    except OSError as error:
                        yield f"{folder.rstrip('/')}/{e.name}", below + e.name, False, None, None, None, str(error)
        return
    store, inside = arrow_fs.FileSystem.from_uri(folder)
    base = folder.rstrip("/")
    for info in sorted(store.get_file_info(arrow_fs.FileSelector(inside)), key=lambda i: i.base_name):
        if info.type == arrow_fs.FileType.Directory:
            yield f"{base}/{info.base_name}", below + info.base_name, True, None, None, None, None
        elif info.type == arrow_fs.FileType.File:
            head = None if _known(info.base_name) or not info.size else _start(store.open_input_stream(info.path))
            yield f"{base}/{info.base_name}", below + info.base_name, False, info.size, (info.mtime_ns or 0) // 1000, head, None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.strip().split(" ")[0] for c in ENTRIES.split(",")])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, relative in zip(*(batch.column(c).to_pylist() for c in ("path", "relative"))):
            rows: list[tuple] = []
            try:
                for row in _entries(folder, relative):
                    rows.append(row)
                    if len(rows) == 10_000:  # a folder of any number of files
                        yield _batch(rows)
                        rows = []
            except (OSError, pa.ArrowException) as error:
                rows.append((folder, relative, True, None, None, None, str(error)))
            yield _batch(rows)


def _reachable(path: str) -> bool:
    """Whether tasks can list this file system themselves."""
    if _local(path) is not None:
        return True
    try:
        arrow_fs.FileSystem.from_uri(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _listed_by_driver(spark: SparkSession, folders: DataFrame, place: str) -> None:
    """The same for stores that only Spark's JVM reaches: the driver lists folder after folder and writes a bounded number of rows at a time."""

    def keep(rows: list[tuple]) -> None:
        spark.createDataFrame(rows, ENTRIES).write.mode("append").parquet(place)

    rows: list[tuple] = []
    keep(rows)
    for folder in folders.toLocalIterator():
        files, here = file_system(spark, folder["path"])
        below = f"{folder['relative']}/" if folder["relative"] else ""
        for s in files.listStatus(here):
            name = s.getPath().getName()
            if s.isSymlink():
                continue
            head = None
            if not s.isDirectory() and s.getLen() and not _known(name):
                data = files.open(s.getPath())
                try:
                    head = bytes(data.readNBytes(HEAD))
                finally:
                    data.close()
            rows.append((f"{folder['path'].rstrip('/')}/{name}", below + name, s.isDirectory(), None if s.isDirectory() else s.getLen(), s.getModificationTime() * 1000, head, None))
            if len(rows) >= CHUNK:
                keep(rows)
                rows = []
    if rows:
        keep(rows)


def tree(spark: SparkSession, path: str, patterns: list[str] | None = None) -> DataFrame:
    """Everything below a folder: path, relative, folder, size, modified (microseconds), head, error, ignored. A path that isn't there is an error.

    Ignored folders are in it, but nothing of what they hold. A folder that can't be listed has an error, and so has a file
    that can't be read. Of a path that is a file, that file.
    """
    patterns, root = patterns or [], scan_root(path)
    files, here = file_system(spark, root)
    if not files.exists(here):
        raise FileNotFoundError(root)
    base = work_folder(spark, "tree")
    if files.getFileStatus(here).isFile():
        name, size = here.getName(), files.getFileStatus(here).getLen()
        head = None if _known(name) or not size else bytes(files.open(here).readNBytes(HEAD))
        one = spark.createDataFrame([(root, name, False, size, files.getFileStatus(here).getModificationTime() * 1000, head, None)], ENTRIES)
        return one.withColumn("ignored", ignored(F.col("relative"), patterns))
    skip = F.when(F.col("folder"), ignored_folder(F.col("relative"), patterns)).otherwise(ignored(F.col("relative"), patterns))
    frontier, level, by_tasks = spark.createDataFrame([(root, "")], "path string, relative string"), 0, _reachable(root)
    made = []
    while True:
        place = f"{base}/{level}"
        if by_tasks:
            # As many tasks as there are folders, up to the session's number: a hash puts a folder's listing anywhere.
            frontier.repartition("path").mapInArrow(_listed, ENTRIES).write.parquet(place)
        else:
            _listed_by_driver(spark, frontier, place)
        made.append(place)
        found = spark.read.schema(ENTRIES).parquet(place).withColumn("ignored", skip)
        frontier = found.where("folder AND error IS NULL AND NOT ignored").select("path", "relative")
        level += 1
        if frontier.isEmpty():
            break
    return spark.read.schema(ENTRIES).parquet(*made).withColumn("ignored", skip)


def discover_tree(spark: SparkSession, path: str, most_bytes: int = 100 * 1024 * 1024, kinds: list[str] | None = None, patterns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) below a folder: files are path, relative, kind, size, modified; skipped counts the others by reason.

    Reasons, the first that holds: unreadable, too large, empty, ignored (a file), ignored folder (one each, whatever it
    holds), unknown kind, other kind. A file without a known extension has the kind that its first bytes tell.
    """
    rows = tree(spark, path, patterns)
    kind = kind_of(F.col("relative"), F.col("head"))
    rows = rows.withColumn("kind", kind).where("folder IS FALSE OR ignored OR error IS NOT NULL")
    why = (
        F.when(F.col("error").isNotNull(), "unreadable")
        .when(F.col("folder"), "ignored folder")
        .when(F.col("size") > most_bytes, "too large")
        .when(F.col("size") == 0, "empty")
        .when(F.col("ignored"), "ignored")
        .when(F.col("kind") == "unknown", "unknown kind")
        .when(~F.col("kind").isin(kinds) if kinds and "all" not in kinds else F.lit(False), "other kind")
    )
    rows = rows.withColumn("reason", why)
    skipped = rows.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return rows.where("reason IS NULL").select("path", "relative", "kind", "size", F.timestamp_micros("modified").alias("modified")), skipped


def with_content(files: DataFrame, most_bytes: int = 100 * 1024 * 1024) -> DataFrame:
    """`files` with their bytes as `content`, read by tasks, and `error` where one can't be read; at most `most_bytes` of each.

    For file systems that tasks reach; those that only Spark's JVM does are read with Spark's binaryFile source instead.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, path in enumerate(batch.column("path").to_pylist()):  # one file in memory at a time
                data, error = None, None
                try:
                    if (local := _local(path)) is not None:
                        with open(local, "rb") as f:
                            data = f.read(most_bytes)
                    else:
                        store, inside = arrow_fs.FileSystem.from_uri(path)
                        with store.open_input_stream(inside) as f:
                            data = f.read(most_bytes)
                except (OSError, pa.ArrowException) as e:
                    error = str(e)
                one = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([data], pa.binary()), pa.array([error], pa.string())], names=[*one.schema.names, "content", "error"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(read, f"{fields}, content binary, error string")
