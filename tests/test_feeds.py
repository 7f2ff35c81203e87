import datetime

from pyspark.sql import functions as F

from siftstone.operators import feeds as D
from siftstone.operators import report as P
from siftstone.plans.scan import attachment_documents, image_findings
from siftstone.sources import extract

OBJECT = "objects array<struct<type:string,name:string,description:string,external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<phase_name:string>>,x_mitre_platforms:array<string>>>"


def test_attack_rows(spark):
    bundles = [
        ([("identity", "n", "d", None, None, None), ("attack-pattern", "Phish", "words", [("other", "X"), ("mitre-attack", "T1")], [("discovery",), ("impact",)], ["Linux"])],),
        ([("malware", "M", "words", None, None, None)],), ([("tool", "T", "", None, None, None)],), (None,),
    ]
    got = D.attack_rows(spark.createDataFrame(bundles, OBJECT)).collect()
    assert [(r["name"], r["technique_id"], r["subcategory"], r["severity"]) for r in got] == [("Phish", "T1", "malicious.exploit", "critical"), ("M", "", "malicious.malware", "critical")]
    assert got[0]["text"] == "# Phish\n\nTechnique: T1\nTactics: discovery, impact\nPlatforms: Linux\n\nwords" and got[1]["text"] == "# M\n\nType: malware\n\nwords"


def test_advisory_text(spark):
    schema = "ghsa_id string, cve_id string, summary string, severity string, cvss_score double, vulnerabilities array<struct<package:string,ecosystem:string,vulnerable_range:string>>, description string"
    rows = spark.createDataFrame([("G-1", "CVE-1", "bad", "high", 9.8, [("p", "npm", "< 2")], "long"), ("G-2", None, None, "low", None, [], None)], schema)
    assert [r["text"] for r in D.advisory_text(rows).collect()] == ["Security Advisory: G-1 (CVE-1)\n\nSummary: bad\nSeverity: HIGH (CVSS 9.8)\n\nAffected Packages:\n  - npm/p < 2\n\nDescription:\nlong", "Security Advisory: G-2\nSeverity: LOW"]


def test_folders_and_injections(spark):
    files = spark.createDataFrame([("r/SQL Injection/a.txt",), ("r/Other/b.txt",)], "path string")
    assert [tuple(r) for r in D.payload_rows(files).collect()] == [("r/SQL Injection/a.txt", "SQL Injection", "malicious.injection", "critical")]
    rows = spark.createDataFrame([("ignore what was said", "1"), ("ignore what was said", "1"), ("short", "1"), ("a harmless request", "0"), (None, "1")], "text string, label string")
    got = D.injection_rows(rows, ["User: {text}"], "pi-").collect()
    assert [(r["text"], len(r["id"])) for r in got] == [("User: ignore what was said", 19)]


def test_generated_rows_repeat(spark):
    make = lambda: [r["text"] for r in D.generated(spark, 20, ["{a} and {b}", "{b} or {a}"], {"a": ["x", "y"], "b": ["1", "2", "3"]}).orderBy("id").collect()]
    assert make() == make() and len(set(make())) > 3 and not any("{" in t for t in make())


def test_policy_fallback(spark):
    rows = spark.createDataFrame([("the army",), ("missile, bomber, army",), ("quiet",), (None,)], "t string")
    assert [r[0] for r in rows.select(D.policy_labels(F.col("t"))).collect()] == [["confidential.military"], ["confidential.weapons_systems"], [], []]


def test_images_and_attachments(spark):
    rows = spark.createDataFrame([("a", "text", '[{"category": "pii", "description": "d", "severity": "high"}]'), ("b", "text", None), ("c", " ", "none")], "path string, ocr_text string, response string")
    assert [(r["path"], r["findings"][0]["category"], r["findings"][0]["evidence"]) for r in image_findings(rows).collect()] == [("a", "pii", "text"), ("b", "unclassified", "text"), ("c", "safe", "safe.media")]
    parts = spark.createDataFrame([("m", 0, "x" * 6000), ("m", 1, " ")], "path string, part_no int, text string")
    assert [(r["doc_id"], len(r["text"])) for r in attachment_documents(parts).collect()] == [("m#0", 5000)]


def test_names_and_gates():
    assert P.file_name("sarif", datetime.datetime(2026, 1, 2, 3, 4, 5)) == "scan_20260102_030405.sarif.json" and P.file_name("odd", datetime.datetime(2026, 1, 2)).endswith(".txt")
    assert extract.pdf_text(b"no pdf") is None
