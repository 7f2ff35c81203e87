"""Extensions beyond batch scans: files that land in a folder, and counts of alerts over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions.rules import RULES, rule_numbers
from siftstone.schema import severity_rank
from siftstone.sources.files import decoded


def landing(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream of (path, modified, text)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_a_batch).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", F.col("modificationTime").alias("modified"), decoded(F.col("content")).alias("text"))


def alerts(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row a rule that speaks first for its subcategory: all columns but the text, rule, subcategory, severity, sev_rank."""
    names, subs, severities = (F.array(*[F.lit(r[k]) for r in RULES]) for k in (0, 1, 2))
    hit = rows.withColumn("n", F.explode_outer(rule_numbers(F.col(text)))).where("n IS NOT NULL").drop(text)
    of = lambda array: F.element_at(array, F.col("n") + 1)
    return hit.select("*", of(names).alias("rule"), of(subs).alias("subcategory"), of(severities).alias("severity")).withColumn("sev_rank", severity_rank(F.col("severity"))).drop("n")


def alert_counts(rows: DataFrame, time: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window_start, subcategory, n) of alerts, late ones up to `late`."""
    return rows.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), "subcategory").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "subcategory", "n")
