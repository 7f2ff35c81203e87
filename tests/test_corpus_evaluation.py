import pytest
from pyspark.sql import functions as F

from siftstone.operators import corpus as C
from siftstone.operators import evaluation as E
from siftstone.operators import labelling as L
from siftstone.operators import ranking as K


@pytest.fixture
def rows(spark):
    return spark.range(300).select("id", F.when(F.col("id") < 200, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("g"))


def test_ranks_match_a_plain_window(rows):
    ranked = K.rank_in_group(rows, [F.col("g")], K.seeded(F.col("id"), 1), F.col("id")).toPandas()
    import hashlib

    ranked["h"] = [hashlib.sha256(f"1|{i}".encode()).hexdigest() for i in ranked["id"]]
    want = ranked.sort_values(["g", "h"]).groupby("g").cumcount() + 1
    assert (want == ranked["rank"]).all()


def test_caps_and_quotas(rows):
    got = K.cap_per_group(rows, "g", 30, "id").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"big": 30, "s0": 25, "s1": 25, "s2": 25, "s3": 25}
    with pytest.raises(ValueError):
        K.stratified_quota(rows, "g", {"s0": 26}, "id")
    assert K.stratified_quota(rows, "g", {"s0": 20, "big": 2}, "id").count() == 22
    assert K.balanced_fill(rows, "g", 200, "id").groupBy("g").count().where("g = 'big'").first()["count"] == 100
    assert K.two_class_share(rows, F.col("g") == "big", 40, 0.85, "id").where("g = 'big'").count() == 34
    split = K.split_train_validation(rows, 0.05, "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"val": 15, "train": 285}
    assert K.numbered(rows, "x_", "id").agg(F.min("id"), F.max("id")).first()[:] == ("x_00000", "x_00299")


def test_prefix_dedup_and_holdout(spark):
    docs = spark.createDataFrame([(3, "same start A"), (1, "same start B"), (2, None), (4, None), (5, "")], "id int, text string")
    assert sorted(r["id"] for r in C.prefix_dedup(docs, 10, "id").collect()) == [1, 2, 5]
    assert sorted(r["id"] for r in C.hold_out(docs, docs.where("id = 1"), chars=10).collect()) == [2, 4, 5]


def test_sources_that_fail_do_not_stop_others(spark):
    good = lambda: spark.createDataFrame([("a",)], "text string")
    made, errors = C.run_sources({"good": good, "bad": lambda: 1 / 0})
    assert made.first()["source"] == "good" and "bad" in errors
    with pytest.raises(ValueError):
        C.run_sources({"bad": lambda: 1 / 0})


def test_pairs_need_findings(spark):
    rows = spark.createDataFrame([(1, "t", [("pii", "pii.x", "high", "d")]), (2, "t", [])], "id int, text string, findings array<struct<category:string,subcategory:string,severity:string,description:string>>")
    assert [r["id"] for r in C.alpaca(rows).collect()] == [1]
    assert C.chat(rows).first()["messages"][2]["content"] == '[{"category":"pii","subcategory":"pii.x","severity":"high","explanation":"d"}]'
    assert C.completion(rows).first()["prompt"].endswith("### Assistant:\n")


@pytest.mark.parametrize("text, want", [("h\n\nbody", []), ("h: x\n\nSSN 123-45-6789", ["pii.identity"]), ("a@b.com\n\n", ["pii.contact"]), ("x\n\nprivileged pwd=abc invoice $5", ["credentials.password", "confidential.internal", "financial.transaction"]), ("invoice $5\n\n", [])])
def test_mail(spark, text, want):
    assert [f["subcategory"] for f in spark.createDataFrame([(text,)], "t string").select(L.mail_findings(F.col("t")).alias("f")).first()["f"]] == want


def test_labels(spark):
    one = lambda text, c: spark.createDataFrame([(text,)], "t string").select(c.alias("x")).first()["x"]
    assert one("fouo and cui", L.standards_label(F.col("t")))["severity"] == "high"
    assert one("nothing", L.attack_label(F.col("t"))) is None
    assert one("xss, ssrf", L.attack_label(F.col("t")))["subcategory"] == "malicious.injection"
    assert one("failed password", L.log_label(F.array("t"), F.lit("Linux")))["subcategory"] == "pii.metadata"
    assert one("failed password", L.log_label(F.array("t"), F.lit("Other")))["subcategory"] == "safe.config"
    assert one("Suspended! http://x http://y", L.phishing_label(F.col("t"), F.lit(True)))[:] == ("malicious.phishing", "critical", "suspended", 2)


def test_filings_with_tax_terms(spark):
    long = "z" * 100
    filings = spark.createDataFrame([("a", "Income TAX and tax rate " + long, "tax law " + long, 1), ("b", "Omitted " + long, None, 2), ("c", "", "y" * 4000 + "irs, tax credit", 3), ("c", None, "y" * 99, 4)], "filename string, section_1A string, section_11 string, text int")
    got = sorted((r["filename"], r["section"], len(r["text"]), r["subcategory"], r["severity"], r["tax_terms"]) for r in L.filing_findings(filings).collect())
    assert got == [
        ("a", "section_11", 108, "financial.bank_statement", "medium", ["tax law"]),
        ("a", "section_1A", 124, "financial.tax", "high", ["income tax", "tax rate"]),
        ("c", "section_11", 4000, "financial.bank_statement", "medium", []),
    ]
    assert L.filing_findings(filings.limit(0)).count() == 0


def test_titles_and_least_lengths(spark):
    rows = spark.createDataFrame([(3, "The NAVY today"), (1, "Farm bill"), (2, None), (4, "NATO"), (0, "Drone rules"), (4, "NATO")], "n int, title string")
    assert sorted(r["n"] for r in L.titled(rows).collect()) == [0, 3, 4, 4]
    assert [r["n"] for r in L.titled(rows, first=["n"], most=2).collect()] == [0, 3]
    with pytest.raises(ValueError):
        L.titled(rows, most=2)
    texts = spark.createDataFrame([("x" * n,) for n in (9, 10, 29, 30, 200)] + [(None,)], "text string")
    assert [L.long_enough(texts, feed).count() for feed in ("injections", "phishing", "transcriptions")] == [4, 2, 1]


def test_feeds(spark):
    feed = spark.createDataFrame(
        [([(("CVE-1", [("fr", "non"), ("en", "text")], (None, [(("low", 1.0),)], [(("HIGH", 9.0),)]), [([("CWE-79",)],)]),)],)],
        "vulnerabilities array<struct<cve: struct<id:string,descriptions:array<struct<lang:string,value:string>>,metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseSeverity:string,baseScore:double>>>,cvssMetricV30:array<struct<cvssData:struct<baseSeverity:string,baseScore:double>>>,cvssMetricV2:array<struct<cvssData:struct<baseSeverity:string,baseScore:double>>>>,weaknesses:array<struct<description:array<struct<value:string>>>>>>>",
    )
    assert tuple(L.cve_rows(feed).first()) == ("CVE-1", "text", "medium", ["CWE-79"])
    spans = spark.createDataFrame([("x" * 60, None, [("NAME", "a"), ("SSN", "b"), ("ODD", "c")])], "source_text string, language string, privacy_mask array<struct<label:string,value:string>>")
    got = L.span_rows(spans, {"NAME": "pii.identity", "SSN": "pii.identity"}, ["SSN"]).first()
    assert (got["subcategory"], got["severity"], got["shown"]) == ("pii.identity", "critical", ["a", "b"])
    filing = spark.createDataFrame([("f", "y" * 200, "Not Applicable" + "z" * 100)], "filename string, s1 string, s2 string")
    assert [r["section"] for r in L.filing_sections(filing, {"s1": "financial.x", "s2": "financial.y"}).collect()] == ["s1"]
    lines = spark.createDataFrame([("# c",), ("' OR 1=1",), ("",)], "value string")
    assert [r["text"] for r in L.wrapped_payloads(lines, {"sql": ["q={payload}"]}, "sql").collect()] == ["q=' OR 1=1"]


@pytest.fixture
def scored(spark):
    truth = spark.createDataFrame([(1, "pii", None, "b"), (2, "safe", "pii", "b"), (3, "safe", None, "c"), (4, "malicious", None, "c")], "id int, category string, alt_category string, bucket string")
    said = spark.createDataFrame([(1, " PII", None), (2, "pii", None), (3, "pii", None), (4, "malicious", "timeout")], "id int, predicted string, error string")
    return E.scored(truth, said)


def test_scores(scored):
    got = {(r["dimension"], r["value"]): (r["n"], r["n_correct"]) for r in E.accuracy_by(scored, "bucket").collect()}
    assert got == {("overall", ""): (4, 2), ("bucket", "b"): (2, 2), ("bucket", "c"): (1, 0)}
    rates = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in E.per_label(scored).collect()}
    assert rates == {"pii": (1, 2, 0), "safe": (0, 0, 2), "malicious": (1, 0, 0)}
    assert E.macro(scored).first()["macro_recall"] == round(2 / 7, 6)
    assert E.false_positive_rate(scored).first()[:] == (2, 1.0)
    assert E.confusion(scored).where("expected = 'safe'").first()["pii"] == 1.0


def test_intervals_and_tests(spark, scored):
    w = spark.createDataFrame([(5, 10), (0, 0), (10, 10)], "k int, n int").select(E.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert [tuple(r["w"]) for r in w[:2]] == [(23.659, 76.341), (0.0, 0.0)] and w[2]["w"]["high"] == 100.0
    same = E.mcnemar(scored, scored).first()
    assert same["chi_square"] is None and E.mcnemar_p(same) == (None, "")
    flipped = scored.withColumn("correct", ~F.col("correct"))
    row = E.mcnemar(scored, flipped).first()
    assert (row["n10"], row["n01"], row["chi_square"]) == (2, 2, 0.25) and 0.6 < E.mcnemar_p(row)[0] < 0.63
    assert E.verdict(scored).first()["tier"] == "poor"


def test_multi_label(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "expected array<string>, predicted array<string>")
    assert E.multi_label_overall(rows).first()[:] == (1, 1, 1, 0.333333)


def test_subcategories(spark):
    row = spark.range(1).select(*[E.subcategory_matches(F.lit(a), F.lit(b)).alias(f"{a}{b}") for a, b in (("pii.x", "PII.x "), ("x", "pii.x"), ("pii.x", "med.x"), ("pii.x", "x"))]).first()
    assert tuple(row) == (True, True, False, False)


def test_numbers_of_more_digits_than_asked_for_stay_whole(spark):
    rows = spark.range(25).withColumnRenamed("id", "doc_id")
    assert sorted(r["id"] for r in K.numbered(rows, "d", "doc_id", digits=1).collect()) == sorted(f"d{k}" for k in range(25))
