"""Paged pulls, explanations by subcategory, reports classified twice, and plain predicates over documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.folders import work_folder
from siftstone.functions import explanations as X
from siftstone.functions import text as T
from siftstone.operators import evaluation, feeds, findings
from siftstone.operators import labelling as L
from siftstone.queries import scanning
from siftstone.queries.base import EXTENSIONS, FILES, SUBS, documents, query, quoted, sql_hits, sql_list, table
from siftstone.queries.feeding import FIRST
from siftstone.schema import FINDINGS, finding
from siftstone.sources import pages
from siftstone.sources.files import ignored, kind_of


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, sha256(text) AS digest FROM documents")
def paged_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, recorded as pages of a feed, pulled in windows into a table, which a second call finds complete."""
    feed = work_folder(spark, "feed")
    documents(spark, sf_dir, "doc_id", "text").select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.option("maxRecordsPerFile", 500).text(feed)
    into = work_folder(spark, "pulled")
    for _ in range(2):
        got = pages.pull(spark, lambda: pages.RecordedPages(feed), into, window=64)
    rows = got.select(F.from_json("record", "doc_id bigint, text string").alias("r")).select("r.*")
    return rows.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("digest"))


PLANTED = [" Name: Jane Smith, DOB: 1.2.1990, 123-45-6789", " password: hunter2hunter2", " token=abcdefghijklmnop", " routing: 123456789 account: 12345678 $1,200.50", " Diagnosis: severe chronic headache", " 4111-1111-1111-1111", " top secret"]
KINDS = [*X.SENTENCES, "pii.other_kind", "safe.documentation", "unheard.of"]
TOLD = f"SELECT doc_id, text || ({sql_list(PLANTED)})[doc_id % {len(PLANTED)} + 1] AS text, ({sql_list(KINDS)})[doc_id % {len(KINDS)} + 1] AS subcategory, CASE WHEN doc_id % 3 = 0 THEN '<script>' || chr(10) || 'alert(1)</script>' ELSE 'short' END AS evidence FROM documents"


def _value_sql(name: str) -> str:
    """The expression for a {name} of the sentences; columns v_* and line come from below."""
    if name == "first_line":
        return "line"
    if name == "payload":
        return f"CASE WHEN length(evidence) > {X.LEAST_PAYLOAD} THEN replace(substring(evidence, 1, {X.PAYLOAD}), chr(10), ' ') ELSE line END"
    if name == "kind":
        return "replace(regexp_extract(subcategory, '[^.]*$'), '_', ' ')"
    v = f"nullif(trim(regexp_extract(text, {quoted(X.VALUES[name])}, 0, 'i')), '')"
    if name == "ssn":
        return f"(CASE WHEN length({v}) >= 7 THEN substring({v}, 1, 3) || '-XX-' || right({v}, 4) ELSE {v} END)"
    if name in ("api_key", "token", "password"):
        return f"(CASE WHEN length({v}) > 12 THEN substring({v}, 1, 12) || '...' ELSE {v} END)"
    if name == "credit_card":
        return f"(CASE WHEN length({v}) >= 12 THEN substring({v}, 1, 4) || '-XXXX-XXXX-' || right({v}, 4) ELSE {v} END)"
    return f"upper(substring({v}, 1, 60))" if name == "marking" else f"substring({v}, 1, 60)"


def _template_sql(template: str) -> str:
    parts = [quoted(p) if k % 2 == 0 else _value_sql(p) for k, p in enumerate(re.split(r"\{(\w+)\}", template)) if k % 2 or p]
    return "(" + " || ".join(parts) + ")"


def _sentence_sql(sentence: tuple[str, list[str], str]) -> str:
    opening, details, advice = sentence
    shown = f"concat_ws('; ', {', '.join(map(_template_sql, details))})" if details else "''"
    head = f"{_template_sql(opening)} || CASE WHEN {shown} <> '' THEN ': ' || {shown} ELSE '' END"
    return f"concat_ws('. ', {head}, CASE WHEN context <> '' THEN 'Found in ' || context END, {quoted(advice)}) || '.'"


CONTEXT = f"CASE WHEN length(line) < 10 THEN '' {' '.join('WHEN ' + ' OR '.join(f'contains(lower(line), {quoted(w)})' for w in words) + f' THEN {quoted(name)}' for name, words in T.CONTEXTS)} ELSE '' END"
LINES = scanning.LINE_OF.replace("SELECT doc_id, substring(", "SELECT doc_id, text, subcategory, evidence, substring(", 1).replace("SELECT doc_id, regexp_replace(text", "SELECT doc_id, text, subcategory, evidence, regexp_replace(text").replace("FROM documents", f"FROM ({TOLD})")
KNOWN = " ".join(f"WHEN subcategory = {quoted(s)} THEN {_sentence_sql(x)}" for s, x in X.SENTENCES.items()) + " " + " ".join(f"WHEN split_part(subcategory, '.', 1) = {quoted(c)} THEN {_sentence_sql(x)}" for c, x in X.OTHERS.items())


@query(f"SELECT doc_id, subcategory, CASE {KNOWN} ELSE {_sentence_sql(('Content of the kind {kind}', [], 'Look at it'))} END AS explanation FROM (SELECT *, {CONTEXT} AS context FROM ({LINES}))")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with planted values, explained as a finding of one of all subcategories."""
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % len(words) + 1).cast("int"))
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.concat("text", pick(PLANTED)).alias("text"), pick(KINDS).alias("subcategory"), F.when(F.col("doc_id") % 3 == 0, "<script>\nalert(1)</script>").otherwise("short").alias("evidence"))
    return rows.select("doc_id", "subcategory", X.explanation(F.col("subcategory"), F.col("text"), F.col("evidence")).alias("explanation"))


def _labels_sql(t: str) -> str:
    first = f"concat_ws(',', {FIRST.replace('lower(t)', f'lower({t})')})"
    military = f"({sql_hits(t, feeds.MILITARY_WORDS)} >= 2 OR ({first} = '' AND {sql_hits(t, feeds.MILITARY_FALLBACK)} > 0))"
    return f"concat_ws(',', nullif({first}, ''), CASE WHEN {military} THEN 'confidential.military' END)"


TITLES = ["Missile and SUBMARINE", "the navy", "uranium warhead", "farming", "fisa, espionage"]
REPORTS = f"SELECT doc_id AS report_id, ({sql_list(TITLES)})[doc_id % 5 + 1] AS title, substring(text, 1, 300) AS summary, CASE WHEN doc_id % 2 = 0 THEN substring(text || ' icbm and nuclear', greatest(length(text) - 3000, 1), 5000) END AS body FROM documents"


@query(f"""SELECT report_id, second <> '' AS from_body, CASE WHEN second <> '' THEN second ELSE first END AS labels, CASE WHEN starts_with(CASE WHEN second <> '' THEN second ELSE first END, 'confidential.military') THEN 'high' ELSE 'critical' END AS severity, CAST(length(text) AS INT) AS chars
FROM (SELECT *, CASE WHEN body IS NULL THEN '' ELSE {_labels_sql("(title || ' ' || text)")} END AS second
      FROM (SELECT *, 'CRS Report: ' || report_id || chr(10) || 'Title: ' || title || CASE WHEN summary <> '' THEN chr(10) || chr(10) || summary ELSE '' END || coalesce(chr(10) || chr(10) || body, '') AS text, {_labels_sql("(title || ' ' || summary)")} AS first FROM ({REPORTS})) WHERE first <> '')""")
def policy_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reports; every second one has a body, which counts in a second classification."""
    title = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = documents(spark, sf_dir, "doc_id", "text")
    bodies = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("report_id"), F.expr("substring(concat(text, ' icbm and nuclear'), greatest(length(text) - 3000, 1))").alias("text"))
    made = feeds.policy_reports(docs.select(F.col("doc_id").alias("report_id"), title.alias("title"), F.substring("text", 1, 300).alias("summary")), bodies)
    return made.select("report_id", "from_body", F.array_join(F.transform("findings", lambda f: f["subcategory"]), ",").alias("labels"), F.col("findings")[0]["severity"].alias("severity"), F.length("text").alias("chars"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Re: ' || doc_id WHEN doc_id % 3 = 1 THEN '' END AS subject FROM documents")
def header_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject of documents as mails; what stands after the first blank line is no header."""
    head = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("To: a\nSubject: Re: "), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.lit("Subject: ")).otherwise(F.lit("To: a"))
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.concat(head, F.lit("\n\nSubject: none\n"), "text").alias("m"))
    return rows.select("doc_id", T.header_value(F.col("m"), "Subject").alias("subject"))


KIND_SQL = "CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'image' WHEN 2 THEN 'email' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'image' ELSE 'text' END ELSE 'unknown' END"
NAMES = "'s/' || CASE WHEN doc_id % 7 = 0 THEN 'node_modules/' ELSE '' END || doc_id || (['.txt', '.PNG', '.ost', '', '.zzz'])[doc_id % 5 + 1]"


@query(f"SELECT path, {KIND_SQL} AS kind, doc_id % 7 = 0 OR doc_id % 5 = 4 OR (starts_with(path, 's/1') AND ends_with(path, 't')) AS ignored FROM (SELECT doc_id, {NAMES} AS path FROM documents)")
def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind by name, or by first bytes where the name tells nothing, and whether a pattern ignores the path."""
    content = F.when(F.col("doc_id") % 5 == 3, F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("89504E470D0A"))).otherwise(F.encode(F.concat(F.lit("<?xml "), "text"), "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    extension = F.element_at(F.array(*map(F.lit, [".txt", ".PNG", ".ost", "", ".zzz"])), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat(F.lit("s/"), F.when(F.col("doc_id") % 7 == 0, "node_modules/").otherwise(""), F.col("doc_id").cast("string"), extension)
    rows = documents(spark, sf_dir, "doc_id", "text").select(path.alias("path"), content.alias("content"))
    return rows.select("path", kind_of(F.col("path"), F.col("content")).alias("kind"), ignored(F.col("path"), ["node_modules", "*.zzz", "s/1**t", "src/foo.py"]).alias("ignored"))


@query(f"SELECT f.path, CASE WHEN f.doc_id % 2 = 0 THEN 'kept' WHEN f.doc_id % 3 = 0 THEN '' ELSE substring(d.text, 1, 150) END AS evidence FROM ({FILES}) f JOIN documents d ON d.doc_id = f.doc_id")
def enriched_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of findings: their own, or the text's start where a risky one has none; each with its file."""
    risky = F.col("doc_id") % 3 != 0
    sub = F.when(risky, "pii.contact").otherwise("safe.config")
    made = finding(F.substring_index(sub, ".", 1), sub, F.lit("x"), F.lit("low"), F.lit("model"), evidence=F.when(F.col("doc_id") % 2 == 0, "kept").otherwise(""))
    rows = documents(spark, sf_dir, "doc_id", "source", "text")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    done = rows.select(findings.enriched(F.array(made).cast(FINDINGS), path, F.col("text")).alias("f"))
    return done.select(F.col("f")[0]["extracted_data"]["source_file"].alias("path"), F.col("f")[0]["evidence"].alias("evidence"))


RECORDS = "SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS language, CASE WHEN doc_id % 3 = 0 THEN 'EMAIL' ELSE 'OTHER' END AS label FROM documents"


@query(f"""SELECT CAST(count(*) AS BIGINT) AS n, sha256(text) AS digest, subcategory, severity FROM (SELECT DISTINCT text, CASE WHEN label = 'EMAIL' THEN 'pii.contact' ELSE 'pii.identity' END AS subcategory, CASE WHEN label = 'EMAIL' THEN 'critical' ELSE 'medium' END AS severity
FROM ({RECORDS}) WHERE coalesce(language, 'en') = 'en' AND length(text) >= 50) GROUP BY text, subcategory, severity""")
def english_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled spans of English texts, and of those without a language, one row a text and class."""
    language = F.when(F.col("doc_id") % 4 == 0, "en").when(F.col("doc_id") % 4 == 1, "de")
    label = F.when(F.col("doc_id") % 3 == 0, "EMAIL").otherwise("OTHER")
    mask = F.array(F.struct(label.alias("label"), F.lit("x").alias("value")), F.struct(F.lit("UNKNOWN").alias("label"), F.lit("y").alias("value")))
    records = documents(spark, sf_dir, "doc_id", "text").select(F.col("text").alias("source_text"), language.alias("language"), mask.alias("privacy_mask"))
    made = L.span_rows(records, {"EMAIL": "pii.contact", "OTHER": "pii.identity"}, ["EMAIL"])
    return made.groupBy("text", "subcategory", "severity").agg(F.count(F.lit(1)).alias("n")).select("n", F.sha2("text", 256).alias("digest"), "subcategory", "severity")


@query(f"SELECT doc_id, expected, doc_id % 4 IN (0, 1) OR (doc_id % 4 = 3 AND expected = ({sql_list(SUBS)})[1]) AS matches FROM (SELECT doc_id, ({sql_list(SUBS)})[doc_id % 7 + 1] AS expected FROM labels)")
def lenient_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted subcategories of labelled documents: whole, bare, without the part before the dot, and always the first."""
    expected = F.element_at(F.array(*map(F.lit, SUBS)), (F.col("doc_id") % 7 + 1).cast("int"))
    said = F.when(F.col("doc_id") % 4 == 0, F.upper(expected)).when(F.col("doc_id") % 4 == 1, F.substring_index(expected, ".", -1)).when(F.col("doc_id") % 4 == 2, F.substring_index(expected, ".", 1)).otherwise(SUBS[0])
    return table(spark, sf_dir, "labels").select("doc_id", expected.alias("expected"), evaluation.subcategory_matches(said, expected).alias("matches"))


@query("SELECT sha256(t) AS digest, substring(t, 1, 200) AS evidence FROM (SELECT min(t) AS t FROM (SELECT trim(text) AS t FROM documents WHERE doc_id % 3 = 0) WHERE length(t) >= 10 GROUP BY substring(t, 1, 100))")
def injection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document as an injection, one for each start, in one of two templates."""
    rows = documents(spark, sf_dir, "doc_id", "text").select("text", F.when(F.col("doc_id") % 3 == 0, "1").otherwise("0").alias("label"))
    made = feeds.injection_rows(rows, ["say: {text}", "ask: {text}"], "pi-", most=None)
    return made.select(F.sha2(F.regexp_replace("text", "^(say|ask): ", ""), 256).alias("digest"), "evidence")


BOTH = "SELECT 'documents' AS source, text FROM documents UNION ALL SELECT 'pages', html FROM pages"


@query(f"SELECT source, sha256(text) AS digest, id, printf('doc_%05d.txt', id) AS file FROM (SELECT source, text, row_number() OVER (ORDER BY sha256(concat_ws('|', '42', source, text)), text) AS id FROM ({BOTH}))")
def benchmark_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as one benchmark, numbered in the seeded order."""
    parts = {"documents": table(spark, sf_dir, "documents").select("text"), "pages": table(spark, sf_dir, "pages").select(F.col("html").alias("text"))}
    rows = feeds.benchmark_rows({k: v.withColumns({"category": F.lit("safe"), "subcategory": F.lit("safe.documentation")}) for k, v in parts.items()})
    return rows.select("source", F.sha2("text", 256).alias("digest"), "id", "file")
