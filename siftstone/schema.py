"""Types and fixed domains shared by all modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in rising order, top-level categories in reporting order.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
CATEGORIES = ["credentials", "pii", "malicious", "financial", "confidential", "medical", "safe"]

FINDING = "category string, subcategory string, description string, evidence string, severity string, sev_rank int, source string, extracted_data map<string,string>"
FINDINGS = f"array<struct<{', '.join(':'.join(c.strip().split(' ', 1)) for c in FINDING.split(', '))}>>"


def severity_rank(severity: Column, unknown: int = 0) -> Column:
    """0 (info) to 4 (critical); `unknown` for null and other words. Case and outer blanks don't matter."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(F.trim(severity))).cast("int") - 1
    return F.coalesce(F.when(at >= 0, at), F.lit(unknown))


def severity_name(rank: Column) -> Column:
    return F.when(rank.isNotNull(), F.get(F.array(*map(F.lit, SEVERITIES)), rank.cast("int")))


def finding(category: Column, subcategory: Column, description: Column, severity: Column, source: Column, extracted: Column | None = None, evidence: Column | None = None) -> Column:
    """One finding struct; evidence defaults to the subcategory."""
    return F.struct(
        category.alias("category"),
        subcategory.alias("subcategory"),
        description.alias("description"),
        (subcategory if evidence is None else evidence).alias("evidence"),
        severity.alias("severity"),
        severity_rank(severity).alias("sev_rank"),
        source.alias("source"),
        (F.create_map().cast("map<string,string>") if extracted is None else extracted).alias("extracted_data"),
    )
