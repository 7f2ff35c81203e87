"""Merging and choosing findings, nested or one a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.functions.text import once
from siftstone.schema import FINDINGS, finding

SAFE = "safe"


def merge_nested(findings: Column) -> Column:
    """One finding for each category and subcategory, the most severe, the first among equals; safe ones only without others, and then all."""
    same = lambda a, b: (a["category"] == b["category"]) & a["subcategory"].eqNullSafe(b["subcategory"])
    numbered = lambda risky: F.transform(risky, lambda g, j: F.struct(g.alias("g"), j.alias("j")))
    best = lambda risky: once(numbered(risky), lambda others: F.filter(risky, lambda f, i: ~F.exists(others, lambda o: same(o["g"], f) & ((o["g"]["sev_rank"] > f["sev_rank"]) | ((o["g"]["sev_rank"] == f["sev_rank"]) & (o["j"] < i))))))
    return once(findings, lambda found: once(F.filter(found, lambda f: f["category"] != SAFE), lambda risky: F.when(F.size(risky) > 0, best(risky)).otherwise(found)))


def merge_rows(findings: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("chunk_no", "pos")) -> DataFrame:
    """The same over rows: of each document, category and subcategory the most severe row, the first by `order` among equals.

    Only minima are taken, so a document or key with many rows is combined before the shuffle.
    """
    columns = findings.columns
    risky = findings.where(F.col("category") != SAFE)
    # Maps have no order, so the row itself is a value, and the minimum is of what it is ordered by.
    place = F.struct((-F.col("sev_rank")).alias("severity"), *order)
    best = risky.groupBy(doc, "category", "subcategory").agg(F.min_by(F.struct(*columns), place).alias("b")).select("b.*").select(*columns)
    quiet = findings.where(F.col("category") == SAFE).join(risky.select(F.col(doc).alias("__doc")).distinct(), F.col(doc) == F.col("__doc"), "left_anti")
    return best.unionByName(quiet)


def primary(findings: Column) -> Column:
    """The most severe finding that isn't safe, the first among equals; else the first; null without any."""
    risky = F.filter(findings, lambda f: f["category"] != SAFE)
    ranked = F.transform(risky, lambda f, i: F.struct((-f["sev_rank"]).alias("r"), i.alias("i")))
    return F.coalesce(F.get(risky, F.array_min(ranked)["i"]), F.get(findings, F.lit(0)))


def enriched(findings: Column, path: Column, content: Column) -> Column:
    """Findings with their file in the extracted data, and the text's start as evidence where a risky one has none."""
    with_file = lambda f: F.map_concat(F.map_filter(f["extracted_data"], lambda k, v: k != "source_file"), F.create_map(F.lit("source_file"), path))
    evidence = lambda f: F.when((f["category"] != SAFE) & (F.coalesce(f["evidence"], F.lit("")) == ""), F.substring(content, 1, 150)).otherwise(f["evidence"])
    return F.transform(findings, lambda f: f.withField("evidence", evidence(f)).withField("extracted_data", with_file(f)))


def with_default(findings: Column, content: Column) -> Column:
    """One safe finding for a text without any, or for an empty text."""
    empty = F.array(finding(F.lit(SAFE), F.lit("safe.empty"), F.lit("The document is empty."), F.lit("info"), F.lit("scanner"))).cast(FINDINGS)
    clean = F.array(finding(F.lit(SAFE), F.lit("safe.documentation"), F.lit("Nothing of concern found."), F.lit("info"), F.lit("scanner"))).cast(FINDINGS)
    blank = F.trim(F.coalesce(content, F.lit(""))) == ""
    return F.when(blank, empty).when(F.size(findings) > 0, findings).otherwise(clean)


def labels(findings: Column) -> Column:
    """struct<categories, severity>: distinct risky categories as they come, and the greatest severity among risky findings."""
    risky = F.filter(findings, lambda f: f["category"] != SAFE)
    return F.struct(F.array_distinct(F.transform(risky, lambda f: f["category"])).alias("categories"), F.array_max(F.transform(risky, lambda f: f["sev_rank"])).alias("sev_rank"))
