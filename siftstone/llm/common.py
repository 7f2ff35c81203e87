"""Shared pieces: the shared work folder, written intermediate tables, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast (a few columns of longs: some 10 MB); beyond it Spark shuffles.
BROADCAST_ROWS = 200_000
#: A key is hot that has more rows than HOT_ROWS and than the HOT_KEYS-th part of all rows; so at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 10_000, 100_000


_own: list[str] = []
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; where that is unset and the master local, one of our own."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="siftstone-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: lineage is cut and nothing is computed twice.

    What isn't deleted by `scratch` or `forget`, because a lazy result reads it, goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siftstone-{name}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    files, at = _file_system(spark, path)
    files.deleteOnExit(at)
    back = spark.read.schema(df.schema).parquet(path)
    back._siftstone_path, back._siftstone_rows = path, seen.get["rows"]
    for made in _scopes:
        made.append(back)
    return back


@contextlib.contextmanager
def scratch():
    """Tables written within are deleted at the end, but for those taken off the list."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes[:] = [s for s in _scopes if s is not made]
        for table in made:
            forget(table)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def forget(df: DataFrame | None) -> None:
    """Delete a table made by `written` that nothing reads any more."""
    if path := getattr(df, "_siftstone_path", None):
        files, at = _file_system(df.sparkSession, path)
        files.delete(at, True)


def small_or_shuffled(df: DataFrame, most: int | None = None) -> DataFrame:
    """A table with a broadcast hint if it has few rows, else as it is: `most` bounds them, else they are counted (of a written table)."""
    return F.broadcast(df) if (row_count(df) if most is None else most) <= BROADCAST_ROWS else df


def row_count(table: DataFrame) -> int:
    """Rows of a written table, as seen when it was written (after lost tasks perhaps more: a bound), else counted."""
    return table._siftstone_rows if hasattr(table, "_siftstone_rows") else table.count()


def bundled(rows: DataFrame, by: list[str], bundles: int, work, schema: str) -> DataFrame:
    """`work` on the rows of every value of `by`, an Arrow table each; small groups are handed to Python many at once, in about so many bundles."""

    def each(bundle: pa.Table) -> pa.Table:
        bundle = bundle.sort_by([(c, "ascending") for c in by])
        new = np.zeros(bundle.num_rows, bool)
        for c in by:
            x = bundle[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cut = [0, *np.flatnonzero(new).tolist(), bundle.num_rows]
        out = pa.concat_tables([work(bundle.slice(a, b - a)) for a, b in zip(cut, cut[1:])])
        give_back()
        return out

    number = F.pmod(F.xxhash64(*by), F.lit(max(1, bundles))).alias("bundle")
    return rows.select("*", number).groupBy("bundle").applyInArrow(each, schema)


def counted_join(rows: DataFrame, side: DataFrame, on: list[str], total: int, how: str = "inner") -> DataFrame:
    """`rows` joined (inner or left) to `side`: one row a key, with the number of `rows` of that key, 1 or more, as `rows`.

    A side is broadcast that can't have many rows, as `total` is small, or was written and counted and has few. Of
    a large one the hot keys are, at most HOT_KEYS of them as no more can be hot among `total` rows; their rows stay where
    they are. The rest is shuffled, and no key there has many rows.
    """
    if total <= BROADCAST_ROWS or row_count(side := written(side, "side")) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(side.drop("rows")), on, how)
    hot = F.col("rows") > max(HOT_ROWS, total // HOT_KEYS)
    few, many = side.where(hot).drop("rows"), side.where(~hot).drop("rows")
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(many, on, how)
    return rows.join(F.broadcast(few), on).unionByName(rest)


def free_name(taken, base: str) -> str:
    """A column name like `base` that none of `taken` has, upper case or not."""
    low, name = {c.lower() for c in taken}, base
    while name.lower() in low:
        name += "_"
    return name


def held_out(column: str, modulus: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves `rest`; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == rest, F.lit(False))


def batches(texts: pa.ChunkedArray | pa.Array, most: int = 2 << 20, rows: int = 1 << 62):
    """Row ranges (first, end) of about `most` bytes of text and at most `rows` rows; a longer text is a range of its own."""
    off = offsets(texts)
    first, n = 0, len(off) - 1
    while first < n:
        end = int(np.searchsorted(off, off[first] + most, "right")) - 1
        end = min(max(end, first + 1), first + rows, n)
        yield first, end
        first = end


def text_array(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One large-string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in a row, and each row's first byte there (n + 1 entries)."""
    off = offsets(texts)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Return a worker's freed memory to the system: workers live on after a task, beside others on their machine."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def conf_int(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble (public splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
