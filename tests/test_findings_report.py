import json

import pytest
from pyspark.sql import functions as F

from siftstone.operators import findings as M
from siftstone.operators import report as P
from siftstone.schema import FINDINGS, SEVERITIES


def finding(category, severity="high", sub=None, description="d", evidence="e", **extracted):
    return (category, sub or f"{category}.x", description, evidence, severity, SEVERITIES.index(severity), "model", extracted)


@pytest.fixture
def files(spark):
    rows = [
        ("a/one.txt", "text", 10, [finding("pii", "critical"), finding("safe", "info", description="fine")]),
        ("a/two.py", "text", 20, [finding("malicious", "high", key_one="v"), finding("pii", "medium")]),
        ("three.TXT", "text", 30, [finding("credentials", "high"), finding("pii", "info")]),
        ("four", "text", 0, []),
    ]
    return spark.createDataFrame(rows, f"path string, kind string, size long, findings {FINDINGS}")


def test_summary(files):
    r = P.summary(files).first()
    assert (r["files"], r["findings"], r["flagged"], r["clean"]) == (4, 5, 3, 1)
    assert [r[s] for s in SEVERITIES] == [2, 0, 1, 2, 1] and r["max_severity"] == "critical"
    assert P.summary(files, "risky").first()["info"] == 1
    empty = P.summary(files.where("false")).first()
    assert (empty["files"], empty["findings"], empty["flagged"], empty["max_severity"]) == (0, 0, 0, None)


def test_flagged(files):
    assert tuple(P.flagged_by_definition(files).first()) == (3, 3, 3, 3)


def test_breakdown_and_extensions(files):
    assert {r["path"]: r["breakdown"] for r in P.severity_breakdown(files).collect()} == {"a/one.txt": "1 critical", "a/two.py": "1 high, 1 medium", "three.TXT": "1 high, 1 info"}
    assert [tuple(r) for r in P.extension_counts(files).collect()] == [("txt", 2, 40), ("", 1, 0), ("py", 1, 20)]


def test_threshold(files):
    assert P.at_or_above(files, "critical").first()["exit_code"] == 1
    assert P.at_or_above(files.where("path = 'four'"), "info").first()["exit_code"] == 0


@pytest.mark.parametrize("kind", ["json", "markdown", "sarif", "html", "terminal", "other"])
def test_formats(files, kind):
    text = P.formatted(files, kind)
    assert "one.txt" in text or kind in ("terminal", "other")
    if kind == "json":
        rows = json.loads(text)
        assert len(rows) == 4 and "extracted_data" not in rows[0]["findings"][0] and rows[1]["findings"][0]["extracted_data"] == {"key_one": "v"}
    if kind == "sarif":
        run = json.loads(text)["runs"][0]
        assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["credentials", "malicious", "pii"] and len(run["results"]) == 5
    if kind == "markdown":
        assert "  - key one: v" in text


def test_html_is_escaped(spark):
    rows = spark.createDataFrame([("<x>.txt", "text", 1, [finding("safe", "info", description="<b>")])], f"path string, kind string, size long, findings {FINDINGS}")
    assert "<b>" not in P.html_page(rows) and "&lt;x&gt;.txt" in P.html_page(rows)


def test_filter_and_sort(files):
    rows = P.exploded(files)
    assert P.filter_findings(rows, category="pii").count() == 3 and P.filter_findings(rows, text="TWO").count() == 2
    assert P.sort_findings(rows.where("severity IS NOT NULL"), "severity", True).first()["severity"] == "critical"


def lists(spark, *findings):
    return spark.createDataFrame([(list(findings),)], f"f {FINDINGS}")


def test_merge(spark):
    merged = lambda *fs: [(f["subcategory"], f["severity"], f["description"]) for f in lists(spark, *fs).select(M.merge_nested(F.col("f")).alias("m")).first()["m"]]
    assert merged(finding("pii", "low", description="1"), finding("pii", "high", description="2"), finding("pii", "high", description="3")) == [("pii.x", "high", "2")]
    assert merged(finding("pii"), finding("pii", sub="pii.y"), finding("safe", "info")) == [("pii.x", "high", "d"), ("pii.y", "high", "d")]
    assert len(merged(finding("safe", "info"), finding("safe", "info"))) == 2 and merged() == []


def test_primary_and_default(spark):
    first = lambda *fs: lists(spark, *fs).select(M.primary(F.col("f")).alias("p")).first()["p"]
    assert first(finding("safe", "info"), finding("pii", "low"), finding("malicious", "high"), finding("pii", "high"))["category"] == "malicious"
    assert first() is None
    given = lambda text, *fs: lists(spark, *fs).select(M.with_default(F.col("f"), F.lit(text)).alias("d")).first()["d"]
    assert given(" ")[0]["subcategory"] == "safe.empty" and given("x")[0]["subcategory"] == "safe.documentation" and given("x", finding("pii"))[0]["category"] == "pii"


def test_enriched(spark):
    f = lists(spark, finding("pii", evidence=""), finding("safe", "info", evidence="")).select(M.enriched(F.col("f"), F.lit("p"), F.lit("content")).alias("e")).first()["e"]
    assert f[0]["evidence"] == "content" and f[1]["evidence"] == "" and f[0]["extracted_data"] == {"source_file": "p"}
