"""Shared pieces for vector operators: valid rows, second moments summed by Spark, blocks of bounded size along a coordinate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(column: str) -> Column:
    """Whether the vector is there, not empty, and all its components are finite numbers."""
    x = F.col(column)
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def rotations(vectors: DataFrame, prepare) -> dict[int, np.ndarray]:
    """For each number of dimensions, the principal directions (columns, falling variance) of prepare(rows).

    vectors: (dim, v). Partitions sum second moments, Spark sums the partitions' cells; dim * dim numbers reach the driver.
    """

    def work(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in incoming:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                x = prepare(matrix(batch.column("v").filter(pa.array(dims == d))))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int32)), pa.array(s.ravel())], names=["dim", "cell", "s"])

    rows = vectors.select("dim", "v").mapInArrow(work, "dim int, cell int, s double").groupBy("dim", "cell").agg(F.sum("s").alias("s")).toArrow()
    dim, cell, s = (rows[c].to_numpy() for c in ("dim", "cell", "s"))
    out = {}
    for d in np.unique(dim).tolist():
        m = np.zeros(d * d)
        m[cell[dim == d]] = s[dim == d]
        out[d] = np.linalg.eigh(m.reshape(d, d))[1][:, ::-1]
    return out


def in_blocks(rows: DataFrame, group: list[str], coordinate: str, width: float, size: int, salt: str) -> DataFrame:
    """`rows` with a column block: runs of about `size` rows of a group along the coordinate, at most about twice that.

    From a histogram with bins of `width`; a bin with more rows is dealt over several blocks by the hash of `salt`. No
    group is sorted or counted in one task.
    """
    rows = rows.withColumn("bin", F.floor(F.col(coordinate) / width))
    bins = rows.groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("bin")) - F.col("n")
    bins = bins.select(*[F.col(c).alias(f"b_{c}") for c in [*group, "bin"]], F.expr(f"(n + {size - 1}) DIV {size}").alias("pieces"), before.alias("before"))
    bins = bins.withColumn("base", F.expr(f"before DIV {size}"))
    on = [F.col(c) == F.col(f"b_{c}") for c in [*group, "bin"]]
    return rows.join(bins, on).withColumn("block", F.col("base") + F.pmod(F.xxhash64(salt), F.col("pieces"))).drop("bin", "base", "pieces", "before", *[f"b_{c}" for c in [*group, "bin"]])
