"""Rule net, chunks, text functions, labels of raw sources."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.functions import rules as R
from siftstone.functions import text as T
from siftstone.operators import labelling as L
from siftstone.plans.scan import chunked, scan
from siftstone.queries.base import documents, query, quoted, sql_hits, sql_list, table
from siftstone.sources.model import ask

RULE_ROWS = " UNION ALL ".join(f"SELECT {n} AS rule_no, {quoted(r.name)} AS rule, {quoted(r.subcategory)} AS subcategory, {quoted(r.severity)} AS severity, doc_id, text FROM documents WHERE regexp_matches(text, {quoted(r.pattern)})" for n, r in enumerate(R.RULES))
RULE_NAMES = ", ".join(f"({n}, {quoted(r.name)}, {quoted(r.subcategory)})" for n, r in enumerate(R.RULES))


@query(f"SELECT n.rule_no, n.rule, n.subcategory, count(h.doc_id) AS documents FROM (VALUES {RULE_NAMES}) n(rule_no, rule, subcategory) LEFT JOIN ({RULE_ROWS}) h ON h.rule_no = n.rule_no GROUP BY ALL")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "text")
    counts = docs.agg(*[F.count_if(R.matches(F.col("text"), r)).alias(f"c{n}") for n, r in enumerate(R.RULES)])
    rows = F.array(*[F.struct(F.lit(n).alias("rule_no"), F.lit(r.name).alias("rule"), F.lit(r.subcategory).alias("subcategory"), F.col(f"c{n}").alias("documents")) for n, r in enumerate(R.RULES)])
    return counts.select(F.inline(rows))


@query(f"SELECT doc_id, rule, subcategory, severity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, subcategory ORDER BY rule_no) AS k FROM ({RULE_ROWS})) WHERE k = 1")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, subs, severities = (F.array(*[F.lit(r[k]) for r in R.RULES]) for k in (0, 1, 2))
    hit = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode_outer(R.rule_numbers(F.col("text"))).alias("n")).where("n IS NOT NULL")
    return hit.select("doc_id", *[F.element_at(a, F.col("n") + 1).alias(name) for a, name in ((names, "rule"), (subs, "subcategory"), (severities, "severity"))])


def _visa(pattern: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(text, {quoted(pattern)}, 0)))"


@query(f"SELECT doc_id, 'visa_number' AS rule, array_to_string({_visa(R.RULES[33].pattern)}, ', ') AS matches FROM documents WHERE regexp_matches(text, {quoted(R.RULES[33].pattern)}) UNION ALL SELECT doc_id, 'secret_in_text', array_to_string({_visa(R.RULES[42].pattern)}, ', ') FROM documents WHERE regexp_matches(text, {quoted(R.RULES[42].pattern)})")
def rule_match_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    each = [F.struct(F.lit(r.name).alias("rule"), R.match_list(F.col("text"), r.pattern).alias("m")) for r in (R.RULES[33], R.RULES[42])]
    return docs.select("doc_id", F.explode(F.array(*each)).alias("r")).where(F.size("r.m") > 0).select("doc_id", "r.rule", F.array_join("r.m", ", ").alias("matches"))


YAML_TEXT = "text || CASE doc_id % 4 WHEN 0 THEN ' yaml.load(f) ' WHEN 1 THEN ' yaml.load(f, Loader=SafeLoader) ' WHEN 2 THEN ' yaml.load(f) then yaml.load(g, Loader = SafeLoader) ' ELSE '' END"
YAML_AT = "position('yaml.load(' IN t)"


@query(f"SELECT doc_id, {YAML_AT} > 0 AND NOT regexp_matches(substring(t, {YAML_AT}, length(regexp_extract(t, {quoted(R.YAML_LOAD)}, 0)) + 100), {quoted(R.YAML_SAFE)}) AS unsafe FROM (SELECT doc_id, {YAML_TEXT} AS t FROM documents)")
def yaml_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.expr(YAML_TEXT).alias("t")).select("doc_id", R.unsafe_yaml(F.col("t")).alias("unsafe"))


BASE_ORDER = [r for c in R.PRIORITY for r in R.RULES if r.subcategory.startswith(f"{c}.")]


@query("SELECT doc_id, split_part(sub, '.', 1) AS category, sub AS subcategory FROM (SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, {quoted(r.pattern)}) THEN {quoted(r.subcategory)}" for r in BASE_ORDER) + " ELSE 'safe.documentation' END AS sub FROM (SELECT doc_id, substring(text, 1, 6000) AS t FROM documents))")
def baseline_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", R.baseline_label(F.col("text")).alias("b")).select("doc_id", "b.*")


CHUNKS = "SELECT doc_id, CAST(i AS INT) AS chunk_no, substring(text, i * 4500 + 1, 5000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 5000 THEN 1 ELSE least(9, CAST(ceil((length(text) - 5000) / 4500.0) AS BIGINT)) + 1 END)) AS i FROM documents)"


@query(f"SELECT doc_id, chunk_no, length(chunk) AS chars, sha256(chunk) AS digest FROM ({CHUNKS})")
def chunk_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.select("doc_id", "chunk_no", F.length("chunk").alias("chars"), F.sha2("chunk", 256).alias("digest"))


@query(f"SELECT chunks, count(*) AS documents, CAST(sum(chars) AS BIGINT) AS chars FROM (SELECT doc_id, count(*) AS chunks, sum(length(chunk)) AS chars FROM ({CHUNKS}) GROUP BY doc_id) GROUP BY chunks")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = documents(spark, sf_dir, "text").select(T.chunks(F.col("text")).alias("c"))
    each = pieces.select(F.size("c").cast("bigint").alias("chunks"), F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("chars"))
    return each.groupBy("chunks").agg(F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("chars"))


class DigestClient:
    """A model that needs no network: its answer is the digest of what it is asked."""

    def chat(self, prompt: str) -> str:
        return hashlib.sha256(prompt.encode()).hexdigest()


@query(f"SELECT doc_id, chunk_no, sha256('Classify this text.' || chr(10) || chr(10) || chunk) AS response, CAST(NULL AS VARCHAR) AS error FROM ({CHUNKS})")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ask(chunked(documents(spark, sf_dir, "doc_id", "text")), DigestClient, "Classify this text.")


WINDOWS = "SELECT doc_id, source, CAST(i AS INT) AS window_no, lines[i * 25 + 1 : i * 25 + 25] AS lines FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines, unnest(range(0, (len(string_split(text, chr(10))) - 1) // 25 + 1)) AS i FROM documents)"


@query(f"SELECT doc_id, window_no, len(lines) AS lines, sha256(array_to_string(lines, chr(10))) AS digest FROM ({WINDOWS}) WHERE len(lines) >= 5")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.posexplode(T.line_windows(F.col("text"))).alias("window_no", "w"))
    return rows.select("doc_id", "window_no", F.size("w").cast("bigint").alias("lines"), F.sha2(F.array_join("w", "\n"), 256).alias("digest"))


@query("SELECT doc_id, CASE WHEN length(text) <= 400 THEN text WHEN position(' ' IN head) > 0 AND 400 - position(' ' IN reverse(head)) > 280 THEN substring(head, 1, 400 - position(' ' IN reverse(head))) || chr(10) || '[...truncated...]' ELSE head || chr(10) || '[...truncated...]' END AS cut FROM (SELECT doc_id, text, substring(text, 1, 400) AS head FROM documents)")
def truncate_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", T.cut_at_word(F.col("text"), 400).alias("cut"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS plain, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS collapsed FROM pages")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("plain"), T.strip_tags(F.col("html"), collapse=True).alias("collapsed"))


LINE_OF = "SELECT doc_id, substring(coalesce(list_filter(list_transform(string_split(b, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 5 AND substring(x, 1, 1) NOT IN ('=', '-', '#', '*', '/'))[1], b), 1, 120) AS line FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS b FROM documents)"


@query(LINE_OF)
def first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", T.first_line(F.col("text")).alias("line"))


@query(f"SELECT context, count(*) AS n FROM (SELECT CASE WHEN length(line) < 10 THEN '' {' '.join('WHEN ' + ' OR '.join(f'contains(lower(line), {quoted(w)})' for w in words) + f' THEN {quoted(name)}' for name, words in T.CONTEXTS)} ELSE '' END AS context FROM ({LINE_OF})) GROUP BY context")
def doc_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "text").groupBy(T.document_context(F.col("text")).alias("context")).agg(F.count(F.lit(1)).alias("n"))


CARD = r"\b\d{16}\b"


@query(f"SELECT doc_id, CASE WHEN length(v) >= 12 THEN substring(v, 1, 4) || '-XXXX-XXXX-' || right(v, 4) ELSE substring(v, 1, 60) END AS card FROM (SELECT doc_id, trim(regexp_extract(text, {quoted(CARD)}, 0)) AS v FROM documents) WHERE v <> ''")
def redact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", T.redacted(F.col("text"), "credit_card", CARD).alias("card")).where("card IS NOT NULL")


def _all(text: str, pattern: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all({text}, {quoted(pattern)}, 0)))"


ASCII_EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"


@query(f"SELECT doc_id, array_to_string(e, ', ') AS emails, len(e) AS n_emails, array_to_string(p[1:3], ', ') AS phones, array_to_string(i[1:5], ', ') AS addresses FROM (SELECT doc_id, {_all('text', ASCII_EMAIL)} AS e, {_all('text', L.PHONE)} AS p, {_all('text', L.IP)} AS i FROM documents) WHERE len(e) + len(p) + len(i) > 0")
def contact_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    # Texts are found by plain tests first; lists are only made of those, and not filtered on, as Spark would make them twice.
    some = documents(spark, sf_dir, "doc_id", "text").where((t.contains("@") & t.rlike(L.EMAIL)) | t.rlike(f"{L.PHONE}|{L.IP}"))
    rows = some.select("doc_id", L.every(t, L.EMAIL).alias("e"), L.every(t, L.PHONE).alias("p"), L.every(t, L.IP).alias("i"))
    return rows.select("doc_id", F.array_join("e", ", ").alias("emails"), F.size("e").cast("bigint").alias("n_emails"), L.joined(F.col("p"), 3).alias("phones"), L.joined(F.col("i"), 5).alias("addresses"))


BODY = "SELECT doc_id, text, CASE WHEN position(chr(10) || chr(10) IN text) > 0 THEN substring(text, position(chr(10) || chr(10) IN text) + 2) ELSE '' END AS body FROM (SELECT doc_id, 'Subject: x' || chr(10) || chr(10) || text || CASE doc_id % 5 WHEN 0 THEN ' confidential' WHEN 1 THEN ' invoice $1,200.50' WHEN 2 THEN ' password: hunter2x' WHEN 3 THEN ' SSN 123-45-6789' ELSE '' END AS text FROM documents)"


@query(
    "SELECT doc_id, concat_ws(',', "
    + f"CASE WHEN regexp_matches(text, {quoted(L.SSN)}) THEN 'pii.identity' END, "
    + f"CASE WHEN regexp_matches(text, {quoted(ASCII_EMAIL)}) OR regexp_matches(body, {quoted(L.PHONE)}) THEN 'pii.contact' END, "
    + f"CASE WHEN regexp_matches(text, {quoted(L.PASSWORD)}) THEN 'credentials.password' END, "
    + f"CASE WHEN {sql_hits('body', L.INTERNAL_WORDS)} > 0 THEN 'confidential.internal' END, "
    + f"CASE WHEN {sql_hits('body', L.MONEY_WORDS)} > 0 AND regexp_matches(text, {quoted(L.AMOUNT)}) THEN 'financial.transaction' END) AS labels FROM ({BODY})"
)
def mail_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.expr("concat('Subject: x\n\n', text, CASE doc_id % 5 WHEN 0 THEN ' confidential' WHEN 1 THEN ' invoice $1,200.50' WHEN 2 THEN ' password: hunter2x' WHEN 3 THEN ' SSN 123-45-6789' ELSE '' END)")
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", message.alias("m"))
    return rows.select("doc_id", F.array_join(F.transform(L.mail_findings(F.col("m")), lambda f: f["subcategory"]), ",").alias("labels"))


WORDY = "text || CASE doc_id % 6 WHEN 0 THEN ' top secret' WHEN 1 THEN ' malware and ransomware' WHEN 2 THEN ' mfa, pki' WHEN 3 THEN ' prompt injection jailbreak phishing' WHEN 4 THEN ' Urgent: verify your account http://a.b/c' ELSE ' xss ssrf' END"


@query(f"SELECT doc_id, CASE WHEN {sql_hits('t', L.CLASSIFIED_WORDS)} >= 2 OR {sql_hits('t', L.WEAKNESS_WORDS)} >= 2 OR {sql_hits('t', L.ACCESS_WORDS)} >= 2 THEN 'confidential.classified' ELSE 'safe.documentation' END AS subcategory, CASE WHEN {sql_hits('t', L.CLASSIFIED_WORDS)} >= 2 THEN 'high' WHEN {sql_hits('t', L.WEAKNESS_WORDS)} >= 2 OR {sql_hits('t', L.ACCESS_WORDS)} >= 2 THEN 'medium' ELSE 'info' END AS severity FROM (SELECT doc_id, {WORDY} AS t FROM documents)")
def keyword_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", L.standards_label(F.expr(WORDY)).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, n, subcategory, severity FROM (SELECT doc_id, unnest([" + ", ".join(f"{{'n': {sql_hits('t', words)}, 'k': {k}, 'subcategory': {quoted(sub)}, 'severity': {quoted(sev)}}}" for k, (sub, sev, words) in enumerate(L.ATTACK_RULES)) + f"], recursive := true) FROM (SELECT doc_id, {WORDY} AS t FROM documents)) WHERE n > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, k) = 1")
def argmax_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Through an outer generator, as Spark would work out a column that is filtered on twice.
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.inline_outer(F.array(L.attack_label(F.expr(WORDY))))).where("n IS NOT NULL")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'malicious.phishing' ELSE 'safe.documentation' END AS subcategory, CASE WHEN doc_id % 2 = 1 THEN 'info' WHEN {sql_hits('t', L.PHISHING_CRITICAL)} > 0 THEN 'critical' ELSE 'high' END AS severity, CASE WHEN doc_id % 2 = 1 THEN 0 ELSE len(regexp_extract_all(t, {quoted(L.URL)}, 0)) END AS urls, CASE WHEN doc_id % 2 = 1 THEN '' ELSE array_to_string((CASE WHEN {sql_hits('t', L.PHISHING_CRITICAL)} > 0 THEN list_filter({sql_list(L.PHISHING_CRITICAL)}, lambda w: contains(lower(t), w)) ELSE list_filter({sql_list(L.PHISHING_HIGH)}, lambda w: contains(lower(t), w)) END)[1:3], ', ') END AS indicators FROM (SELECT doc_id, {WORDY} AS t FROM documents)")
def phishing_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", L.phishing_label(F.expr(WORDY), F.col("doc_id") % 2 == 0).alias("x"))
    return rows.select("doc_id", "x.subcategory", "x.severity", F.col("x.urls").cast("bigint").alias("urls"), "x.indicators")


@query(f"SELECT doc_id, window_no, n AS failures, len({_all('t', L.IP)}) AS addresses, CASE WHEN n >= 2 THEN 'pii.metadata' ELSE 'safe.config' END AS subcategory FROM (SELECT doc_id, window_no, t, {sql_hits('t', L.LOGIN_FAILURES)} AS n FROM (SELECT doc_id, window_no, array_to_string(lines, chr(10)) || CASE WHEN doc_id % 3 = 0 THEN ' Invalid user, access denied' ELSE '' END AS t, len(lines) AS m FROM ({WINDOWS})) WHERE m >= 5)")
def log_window_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "doc_id", "source", "text").select("doc_id", "source", F.posexplode(T.line_windows(F.col("text"))).alias("window_no", "w"))
    extra = F.when(F.col("doc_id") % 3 == 0, " Invalid user, access denied").otherwise("")
    lines = F.transform("w", lambda x, i: F.when(i == F.size("w") - 1, F.concat(x, extra)).otherwise(x))
    return rows.select("doc_id", "window_no", L.log_label(lines, F.col("source")).alias("x")).select("doc_id", "window_no", "x.failures", F.col("x.addresses").cast("bigint").alias("addresses"), "x.subcategory")


@query(f"SELECT category, severity, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, split_part(subcategory, '.', 1) AS category, severity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, subcategory ORDER BY rule_no) AS k FROM ({RULE_ROWS})) WHERE k = 1 UNION ALL SELECT doc_id, 'safe', 'info' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({RULE_ROWS}))) GROUP BY category, severity")
def scan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A plain explode makes Spark filter on the list's size first, and so make the list twice.
    found = scan(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", F.explode_outer("findings").alias("f"))
    return found.groupBy("f.category", "f.severity").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("documents"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || ' KB' ELSE printf('%.1f', n / 1048576.0) || ' MB' END AS size, replace(replace(replace(replace(substring(text, 1, 80) || '<&\">', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS escaped FROM (SELECT doc_id, text, strlen(text) AS n FROM documents)")
def display_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "doc_id", "text")
    return rows.select("doc_id", T.human_size(F.octet_length("text")).alias("size"), T.escape_html(F.concat(F.substring("text", 1, 80), F.lit('<&">'))).alias("escaped"))
