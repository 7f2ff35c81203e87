from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftstone.functions import text as T
from siftstone.operators import labelling as L


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


def test_chunk_counts(spark):
    for n, want in [(0, 1), (13, 1), (5000, 1), (5001, 2), (9500, 2), (9501, 3), (12000, 3), (100000, 10)]:
        assert one(spark, "x" * n, F.size(T.chunks(F.col("t"))))[0] == want
    assert [len(c) for c in one(spark, "y" * 12000, T.chunks(F.col("t")))[0]] == [5000, 5000, 3000]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(max_size=60), st.integers(2, 9), st.integers(0, 8))
def test_chunks_cover_the_text(spark, text, size, overlap):
    text = text.replace("\0", "").encode("utf-16", "ignore").decode("utf-16", "ignore")
    got = one(spark, text, T.chunks(F.col("t"), size, overlap, 1000))[0]
    step = size - overlap if size > overlap else size
    assert got[0] + "".join(c[size - step :] for c in got[1:]) == text


def test_cut_at_word(spark):
    assert one(spark, "short", T.cut_at_word(F.col("t"), 10))[0] == "short"
    assert one(spark, "abcdefghi jkl", T.cut_at_word(F.col("t"), 11))[0] == "abcdefghi\n[...truncated...]"
    assert one(spark, "a bcdefghijklm", T.cut_at_word(F.col("t"), 11))[0] == "a bcdefghij\n[...truncated...]"


def test_markup(spark):
    assert one(spark, "<p>a</p>\n<b>c</b>", T.strip_tags(F.col("t"), True), T.strip_tags(F.col("t")))[:] == ("a c", " a \n c ")


def test_first_line_and_context(spark):
    assert one(spark, "\n# heading\n---\nshort\n  A meeting about x \n", T.first_line(F.col("t")), T.document_context(F.col("t")))[:] == ("A meeting about x", "meeting notes")
    assert one(spark, "# x", T.first_line(F.col("t")), T.document_context(F.col("t")))[:] == ("# x", "")


def test_redaction(spark):
    assert one(spark, "ssn 123-45-6789", T.redacted(F.col("t"), "ssn", r"\d{3}-\d{2}-\d{4}"))[0] == "123-XX-6789"
    assert one(spark, "key abcdefghijklmnop", T.redacted(F.col("t"), "api_key", "[a-z]{16}"))[0] == "abcdefghijkl..."
    assert one(spark, "4111111111111111", T.redacted(F.col("t"), "credit_card", r"\d{16}"), T.redacted(F.col("t"), "x", "zzz"))[:] == ("4111-XXXX-XXXX-1111", None)


def test_values(spark):
    sizes = [one(spark, "", T.human_size(F.lit(n)))[0] for n in (12, 1024, 1280, 5 << 20, 3 << 30)]
    assert sizes == ["12 B", "1.0 KB", "1.2 KB", "5.0 MB", "3.0 GB"]
    assert one(spark, "<a & \"b\">", T.escape_html(F.col("t")))[0] == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, "x/Y.TAR.Gz", T.extension(F.col("t")), T.basename(F.col("t")))[:] == ("gz", "Y.TAR.Gz")
    assert one(spark, "\u001b[31mred\u001b[0m", T.strip_ansi(F.col("t")))[0] == "red"
    assert one(spark, "From: a\nSubject: b\n\nSubject: c", T.header_value(F.col("t"), "Subject"), T.header_value(F.col("t"), "To"))[:] == ("b", None)
    assert one(spark, "", T.filled("do {x} now", x=F.lit("this")))[0] == "do this now"


def test_windows(spark):
    text = "\n".join(map(str, range(53)))
    got = one(spark, text, T.line_windows(F.col("t")))[0]
    assert [len(w) for w in got] == [25, 25] and got[1][0] == "25"


def test_context_looks_for_the_first_line_once(spark):
    docs = spark.createDataFrame([("# x\n" + "line\n" * 9 + "The meeting of today",), (" " * 100_000 + "x" + " " * 100_000 + "\ny",)], "t string")
    rows = docs.select(T.document_context(F.col("t")).alias("context"), T.first_line(F.col("t")).alias("line"))
    plan = docs.select(T.document_context(F.col("t")).alias("context"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 1 and plan.count("regexp_replace") == 1
    assert rows.collect()[0][:] == ("meeting notes", "The meeting of today") and rows.collect()[1]["line"].rstrip() == "x"


def test_words_are_looked_for_in_one_lower_case_text(spark):
    docs = spark.createDataFrame([(1, "Phishing, SSRF and Phishing by VISHING"), (2, None), (3, "none of them")], "doc_id int, t string")
    t = F.col("t")
    for made in (T.count_hits(t, ["phishing", "ssrf", "x"]), T.keyword_hits(t, ["phishing", "ssrf", "x"]), L.attack_label(t)):
        assert docs.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    got = docs.select(T.count_hits(t, ["phishing", "ssrf", "x"]), T.keyword_hits(t, ["phishing", "ssrf", "x"]), L.attack_label(t)).collect()
    assert [r[:2] for r in got] == [(2, ["phishing", "ssrf"]), (0, []), (0, [])]
    assert got[0][2][:] == (2, "malicious.phishing", "high") and got[1][2] is None and got[2][2] is None
