import pytest
from pyspark.sql import functions as F

from siftstone.functions import responses as J


def parsed(spark, answer, repair=False, **options):
    rows = spark.createDataFrame([(answer,)], "r string")
    if repair:
        rows, options = rows.withColumn("tail", J.repaired_tail(F.col("r"))), {"tail": F.col("tail")}
    rows = rows.select(J.parse_findings(F.col("r"), **options).alias("f"))
    return [(f["category"], f["subcategory"], f["severity"]) for f in rows.first()["f"]]


def item(sub, severity="high"):
    return f'{{"category": "{sub.split(".")[0]}", "subcategory": "{sub}", "severity": "{severity}"}}'


CLEAN = [("safe", "safe.documentation", "info")]


@pytest.mark.parametrize(
    "answer, want",
    [
        (f"[{item('pii.identity')}]", [("pii", "pii.identity", "high")]),
        (f"[{item('pii.identity')}, {item('pii.identity', 'low')}]", [("pii", "pii.identity", "high")]),
        (f"[{item('pii.identity')}] text [{item('malicious.shell', 'critical')}]", [("pii", "pii.identity", "high"), ("malicious", "malicious.shell", "critical")]),
        (f"[{item('safe.config', 'info')}, {item('pii.identity')}]", [("pii", "pii.identity", "high")]),
        (f"[{item('safe.config', 'info')}]", [("safe", "safe.config", "info")]),
        ('[{"category": "pii"}]', [("pii", "", "medium")]),
        (f"[{item('pii.identity', 'warning')}]", [("pii", "pii.identity", "medium")]),
        ("", CLEAN), (None, CLEAN), ("prose only", CLEAN), ("[1, 2]", CLEAN), ('[{"x": 1}]', CLEAN),
        (f"[{item('pii.identity')}, 3]", CLEAN),
        ('[{"category": "confidential", "subcategory": "medical.record"}]', [("medical", "medical.record", "medium")]),
        ('[{"category": "confidential", "subcategory": "other.record"}]', [("confidential", "other.record", "medium")]),
    ],
)
def test_parse(spark, answer, want):
    assert parsed(spark, answer) == want


def test_lenient_items_and_tidy_categories(spark):
    assert parsed(spark, '[{"category": " PII ", "subcategory": "pii.identity"}, {"x": 1}]', strict=False, tidy_category=True) == [("pii", "pii.identity", "medium")]


@pytest.mark.parametrize("tail, n", [("", 1), (', {"category": "malicious", "subc', 1), (', {"category": "malicious", "explanation": "brace } in text', 1)])
def test_repair(spark, tail, n):
    assert parsed(spark, f"[{item('pii.identity')}{tail}", repair=True) == [("pii", "pii.identity", "high")] * n
    assert parsed(spark, f"[{item('pii.identity')}{tail}") == CLEAN


def test_cut_off_array():
    assert J.cut_off_array('x [{"a": "}"}, {"b"') == '[{"a": "}"}]'
    assert J.cut_off_array('[{"a": {"b": 1}}, {"c": {"d": 2}}') == '[{"a": {"b": 1}}, {"c": {"d": 2}}]'
    assert J.cut_off_array('[{"a"') is None and J.cut_off_array("no") is None and J.cut_off_array(None) is None


def test_detailed(spark):
    answer = 'text [{"category": "pii", "description": "d", "severity": "odd", "extracted_data": {"a": "1", "b": " "}}] end'
    row = spark.createDataFrame([(answer,)], "r string").select(J.parse_detailed(F.col("r")).alias("f")).first()["f"]
    assert [(f["category"], f["severity"], f["extracted_data"]) for f in row] == [("pii", "info", {"a": "1"})]
    for bad in ("none", '[{"category": "pii"}]', "[broken", None):
        assert spark.createDataFrame([(bad,)], "r string").select(J.parse_detailed(F.col("r")).alias("f")).first()["f"] == []


def test_three_steps(spark):
    for answer, n in [('{"category": "a"}', 1), ('```json\n[{"category": "a"}]\n```', 1), ('see [{"category": "a"}, {"category": "b"}]', 2), ("none", 0)]:
        assert len(spark.createDataFrame([(answer,)], "r string").select(J.parse_lenient(F.col("r"))).first()[0]) == n
