"""Folders that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, deleted when the application ends; where that is unset and the master local, in a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="siftstone-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        at = f"file://{_own[0]}"
    path = f"{at}/siftstone-{name}-{uuid.uuid4().hex}"
    files, here = file_system(spark, path)
    files.deleteOnExit(here)
    return path


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in it."""
    here = spark._jvm.org.apache.hadoop.fs.Path(path)
    return here.getFileSystem(spark._jsc.hadoopConfiguration()), here


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, in order; empty if it isn't there."""
    files, here = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(here)) if files.exists(here) else []


def exists(spark: SparkSession, path: str) -> bool:
    files, here = file_system(spark, path)
    return files.exists(here)


def remove(spark: SparkSession, path: str) -> None:
    files, here = file_system(spark, path)
    files.delete(here, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Whether `old` is now `new`; false if that isn't possible, as when `new` is there."""
    files, here = file_system(spark, old)
    there = file_system(spark, new)[1]
    files.mkdirs(there.getParent())
    return not files.exists(there) and files.rename(here, there)
