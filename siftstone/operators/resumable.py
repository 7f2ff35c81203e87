"""Results that grow batch by batch and survive a restart.

A folder holds one subfolder a batch, `batch=<name>`. A batch is written beside them under a name that readers pass over, and
renamed when it is whole, so a batch is there with all its rows or not at all, and a name is taken once. A restart reads
what is there, leaves out what is done, and goes on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftstone.folders import children, exists, remove, rename
from siftstone.operators.corpus import not_done

BATCH = "batch="


def commit(rows: DataFrame, folder: str, name: str) -> bool:
    """Write `rows` as the batch `name`; false, and nothing is computed, if that batch is there already."""
    spark, place = rows.sparkSession, f"{folder.rstrip('/')}/{BATCH}{name}"
    if _whole(spark, place):
        return False
    stage = f"{folder.rstrip('/')}/_stage-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(stage)
    if exists(spark, place):  # a copy that broke off, where a rename isn't one step
        remove(spark, place)
    if not rename(spark, stage, place):
        remove(spark, stage)
        return False
    return True


def _whole(spark: SparkSession, place: str) -> bool:
    return exists(spark, f"{place}/_SUCCESS")


def batch_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the whole batches, in order."""
    return [c.removeprefix(BATCH) for c in children(spark, folder) if c.startswith(BATCH) and _whole(spark, f"{folder.rstrip('/')}/{c}")]


def committed(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All rows of all whole batches, with the batch's name as `batch`; batches that come later aren't in it."""
    empty = spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("string"))
    base = folder.rstrip("/")
    paths = [f"{base}/{BATCH}{n}" for n in batch_names(spark, folder)]
    return spark.read.schema(empty.schema).option("basePath", base).parquet(*paths) if paths else empty


def latest(rows: DataFrame, key: str, failed: Column) -> DataFrame:
    """One row a key of `committed`: the first that didn't fail, else the last failure. No key's rows meet in one task."""
    bad = F.coalesce(failed, F.lit(False))
    first = rows.where(~bad).groupBy(F.col(key).alias("k")).agg(F.min_by(F.struct(*rows.columns), "batch").alias("r"))
    last = rows.where(bad).groupBy(F.col(key).alias("k")).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r"))
    return first.unionByName(last.join(first.select("k"), "k", "left_anti")).select("r.*")


def evaluate(todo: DataFrame, work: Callable[[DataFrame], DataFrame], folder: str, key: str, failed: str = "error IS NOT NULL", batch_rows: int = 100_000, keep_failed: bool = False) -> DataFrame:
    """Results of `work` for all rows of `todo`, as far as they aren't in `folder` yet; one row a key.

    work: from rows of `todo` to results, which keep the column `key`; a result for which `failed` holds is done again by the
    next call, unless keep_failed. Rows are dealt by the key's hash to batches of about `batch_rows`; each is there once it
    is whole, so a call that is stopped loses the batch at hand at most, and the next call does the rest only. One call at
    a time may work on a folder. Rows without a key are left out; a repeated key has one result.
    """
    spark = todo.sparkSession
    schema = work(todo.limit(0)).schema
    for name in children(spark, folder):
        if name.startswith("_stage-") or name.startswith(BATCH) and not _whole(spark, f"{folder.rstrip('/')}/{name}"):
            remove(spark, f"{folder.rstrip('/')}/{name}")  # what a stopped call has left
    before = batch_names(spark, folder)
    run = 1 + max((int(n.split("-")[0]) for n in before), default=0)
    rest = not_done(todo.where(F.col(key).isNotNull()), committed(spark, folder, schema), key, None if keep_failed else F.expr(failed))
    batches = -(-rest.count() // batch_rows)
    for b in range(batches):
        mine = rest.where(F.pmod(F.xxhash64(key), F.lit(batches)) == b)
        commit(work(mine), folder, f"{run:06d}-{b:06d}")
    return latest(committed(spark, folder, schema), key, F.expr(failed))


def stream_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch once, also where a restarted stream delivers one again."""

    def write(rows: DataFrame, number: int) -> None:
        commit(rows, folder, f"{number:012d}")

    return write
