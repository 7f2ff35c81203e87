"""Inputs that are cut off, badly encoded, of mixed formats or without what is usual."""

import datetime
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftstone.functions.responses import cut_off_array
from siftstone.operators import corpus as C
from siftstone.operators import findings as M
from siftstone.operators import ranking as K
from siftstone.operators import report as P
from siftstone.plans.scan import scan
from siftstone.schema import FINDINGS
from siftstone.sources import extract, files

FINDING_TABLE = "doc_id bigint, chunk_no int, pos int, category string, subcategory string, severity string, sev_rank int, extracted_data map<string,string>"


def test_bytes_that_are_no_utf8(spark):
    rows = spark.sql("SELECT X'41FF42' AS content UNION ALL SELECT X'C3A9' UNION ALL SELECT CAST(NULL AS BINARY)")
    assert {r[0] for r in rows.select(files.decoded(F.col("content"))).collect()} == {"A�B", "é", None}


def test_text_by_format(spark):
    mbox = b"From a@b Mon\nSubject: one\n\nfirst body\n\nFrom c@d Tue\nSubject: two\nContent-Type: text/plain; charset=no-such-set\n\nsecond \xff body\n"
    rows = spark.createDataFrame([("txt", b"plain \xfe"), ("xls", b"\xd0\xcf\x11\xe0cells\x00\x01here"), ("mbox", mbox), ("eml", b"Subject: s\n\nhello"), ("docx", b"no zip"), ("pdf", b"no pdf")], "ext string, content binary")
    got = {r["ext"]: r["t"] for r in rows.select("ext", extract.text_of(F.col("ext"), F.col("content")).alias("t")).collect()}
    assert got["txt"] == "plain �" and got["xls"] == "cells here" and got["eml"] == "Subject: s\n\nhello" and got["docx"] is None and got["pdf"] is None
    assert "first body" in got["mbox"] and "Subject: two" in got["mbox"] and "second" in got["mbox"]
    parts = extract.mail(rows.where("ext = 'mbox'").select(F.col("ext").alias("path"), "content")).collect()
    assert [(r["part_no"], r["name"]) for r in parts] == [(0, "one"), (1, "two")]


@pytest.mark.parametrize(
    "answer, want",
    [
        ('[{"category": "pii", "subcategory": "pii.identity"}, {"category": "cr', [{"category": "pii", "subcategory": "pii.identity"}]),
        ('[{"category": "pii", "subcategory": "pii.identity", "severity": "hi', [{"category": "pii", "subcategory": "pii.identity"}]),
        ('[{"category": "pii", "explanation": "again and again', [{"category": "pii", "explanation": "again and again..."}]),
        ('[{"category": "pii", "explanation": "' + "x" * 900, [{"category": "pii", "explanation": "x" * 300 + "..."}]),
        ('[{"cat', None),
        ("no array", None),
    ],
)
def test_answers_that_break_off(answer, want):
    got = cut_off_array(answer)
    assert (got and json.loads(got)) == want


def test_scan_reads_answers_that_break_off(spark):
    docs = spark.createDataFrame([(1, "some plain words"), (2, "other words")], "doc_id bigint, text string")
    answers = spark.createDataFrame([(1, 0, '[{"category": "medical", "subcategory": "medical.record", "severity": "high"}, {"cat'), (2, 0, '[{"category": "medical", "subcategory": ""}]')], "doc_id bigint, chunk_no int, response string")
    got = {r["doc_id"]: [(f["category"], f["severity"], f["description"]) for f in r["findings"]] for r in scan(docs, answers).collect()}
    assert got == {1: [("medical", "high", "Detected medical.record content")], 2: [("medical", "medium", "Detected medical content")]}


def test_rows_with_maps_are_merged(spark):
    rows = [(1, 0, 0, "pii", "pii.x", "low", 1, {"a": "1"}), (1, 1, 0, "pii", "pii.x", "high", 3, {"a": "2"}), (1, 2, 0, "pii", "pii.x", "high", 3, {"a": "3"}), (1, 0, 1, "safe", "safe.config", "info", 0, {}), (2, 0, 0, "safe", "safe.config", "info", 0, None)]
    got = M.merge_rows(spark.createDataFrame(rows, FINDING_TABLE)).collect()
    assert sorted((r["doc_id"], r["category"], r["sev_rank"], (r["extracted_data"] or {}).get("a")) for r in got) == [(1, "pii", 3, "2"), (2, "safe", 0, None)]


def test_reports_of_any_size(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"f{k:02}.txt", "text", k, []) for k in range(30)], f"path string, kind string, size long, findings {FINDINGS}")
    when = datetime.datetime(2024, 1, 2, 3, 4, 5)
    names = P.save(rows, "markdown", str(tmp_path), when)
    assert [Path(n).name for n in names] == ["scan_20240102_030405.md", "scan_20240102_030405.json"]
    assert [json.loads(r["value"])["path"] for r in spark.read.text(names[1]).collect()] == [f"f{k:02}.txt" for k in range(30)]
    assert P.html_page(rows).count("<tr><td>") == 30 and "<li>files: 30</li>" in P.html_page(rows)
    monkeypatch.setattr(P, "REPORT_ROWS", 20)
    with pytest.raises(ValueError, match="more than 20"):
        P.formatted(rows, "json")


def test_a_source_that_fails_when_it_is_read(spark):
    broken = lambda: spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("text"))
    rows, errors = C.run_sources({"good": lambda: spark.createDataFrame([("a",)], "text string"), "bad": broken})
    assert [r["text"] for r in rows.collect()] == ["a"] and list(errors) == ["bad"]


def test_fill_without_texts_that_start_alike(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 2], f"text {k // 2}") for k in range(20)], "doc_id bigint, g string, text string")
    got = K.balanced_fill(rows, "g", 10, "doc_id", text="text").collect()
    assert len(got) == 10 == len({r["text"] for r in got})


def test_columns_named_as_those_within(spark):
    rows = spark.createDataFrame([(k, k % 2, 1, 2, 3) for k in range(10)], "doc_id bigint, g int, __order int, __bucket int, __key int")
    assert K.cap_per_group(rows, "g", 3, "doc_id").count() == 6
    assert C.prefix_dedup(rows.withColumn("text", F.lit("x")), 5, "doc_id").count() == 1


def test_scan_root(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert {files.scan_root(p) for p in ("", ".", " ./ ", "/")} == {str(tmp_path)}
    assert files.scan_root("a/../b/") == str(tmp_path / "b") and files.scan_root("s3://x/y") == "s3://x/y"
