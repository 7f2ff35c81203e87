"""Registry of this library's queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftstone.queries import base, corpora, evaluating, explaining, feeding, making_files, reporting, scanning  # noqa: F401  (each registers its queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by category and severity of a scan of all documents."""
    return scanning.scan_rollup(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
