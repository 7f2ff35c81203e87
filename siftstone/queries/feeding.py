"""Feeds, queues, comparisons and generated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import feeds as D
from siftstone.operators import labelling as L
from siftstone.queries.base import documents, query, quoted, sql_hits, sql_list, table

REPORT = "text || CASE doc_id % 6 WHEN 0 THEN ' Missile and SUBMARINE' WHEN 1 THEN ' uranium warhead' WHEN 2 THEN ' the navy' WHEN 3 THEN ' fisa, espionage; icbm and nuclear' WHEN 4 THEN ' ndaa, brac' ELSE '' END"
FIRST = ", ".join(f"CASE WHEN {sql_hits('t', words)} >= 2 THEN {quoted(sub)} END" for words, sub in ((D.WEAPON_WORDS, "confidential.weapons_systems"), (D.NUCLEAR_WORDS, "confidential.nuclear"), (D.INTELLIGENCE_WORDS, "confidential.intelligence")))


TAXED = "CASE doc_id % 4 WHEN 0 THEN 'Income Tax and the IRS: ' WHEN 1 THEN 'deferred tax ' WHEN 2 THEN 'Not applicable. ' ELSE '' END || text"
FILINGS = f"SELECT doc_id AS filename, text AS section_7A, {TAXED} AS section_8 FROM documents"
TAX_TERMS = "list_filter(" + sql_list(L.TAX_WORDS) + ", lambda w: contains(lower(t), w))"


@query(
    f"SELECT filename, section, length(t) AS chars, CASE WHEN len(x) >= 2 THEN 'financial.tax' WHEN section = 'section_8' THEN 'financial.bank_statement' ELSE 'financial.investment' END AS subcategory, CASE WHEN len(x) >= 2 OR section = 'section_8' THEN 'high' ELSE 'medium' END AS severity, array_to_string(x, ',') AS terms "
    f"FROM (SELECT filename, section, t, {TAX_TERMS} AS x FROM (SELECT filename, section, substring(text, 1, 4000) AS t FROM (SELECT filename, 'section_7A' AS section, section_7A AS text FROM ({FILINGS}) UNION ALL SELECT filename, 'section_8', section_8 FROM ({FILINGS})) WHERE length(text) >= 100 AND NOT contains(lower(substring(text, 1, 100)), 'not applicable') AND NOT contains(lower(substring(text, 1, 100)), 'omitted')))"
)
def filing_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    filings = documents(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("filename"), F.col("text").alias("section_7A"), F.expr(TAXED).alias("section_8"))
    return L.filing_findings(filings).select("filename", "section", F.length("text").alias("chars"), "subcategory", "severity", F.array_join("tax_terms", ",").alias("terms"))


@query(f"SELECT doc_id FROM documents WHERE {sql_hits('text', L.DEFENCE_TITLES)} > 0 AND length(text) >= 200")
def titled_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.long_enough(L.titled(documents(spark, sf_dir, "doc_id", "text"), title="text"), "transcriptions").select("doc_id")


@query(f"SELECT doc_id, concat_ws(',', CASE WHEN f <> '' THEN f END, CASE WHEN m >= 2 OR (f = '' AND p > 0) THEN 'confidential.military' END) AS labels FROM (SELECT doc_id, concat_ws(',', {FIRST}) AS f, {sql_hits('t', D.MILITARY_WORDS)} AS m, {sql_hits('t', D.MILITARY_FALLBACK)} AS p FROM (SELECT doc_id, {REPORT} AS t FROM documents))")
def policy_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.array_join(D.policy_labels(F.expr(REPORT)), ",").alias("labels"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'malicious.injection' WHEN 1 THEN 'malicious.supply_chain,malicious.ssrf' WHEN 2 THEN 'malicious.supply_chain' WHEN 3 THEN 'malicious.exploit' ELSE 'malicious.shell,credentials.password' END AS labels, CASE doc_id % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS severity FROM documents")
def advisory_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda *values: F.element_at(F.array(*values), (F.col("doc_id") % len(values) + 1).cast("int"))
    codes = kind(F.array(F.lit("CWE-79"), F.lit("CWE-89")), F.array(F.lit("CWE-918")), F.array().cast("array<string>"), F.array(F.lit("CWE-1")), F.array(F.lit("CWE-78"), F.lit("CWE-798")))
    description = kind(F.lit("x"), F.lit("a Typosquat"), F.lit("it may exfiltrate"), F.lit("x"), F.lit("x"))
    made = D.advisory_findings(F.lit("s"), description, kind(F.lit("high"), F.lit("odd"), F.lit(None).cast("string")), codes, F.array(F.lit("npm")))
    rows = table(spark, sf_dir, "documents").select("doc_id", made.alias("f"))
    return rows.select("doc_id", F.array_join(F.transform("f", lambda f: f["subcategory"]), ",").alias("labels"), F.col("f")[0]["severity"].alias("severity"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'malicious.supply_chain:high' WHEN 1 THEN 'malicious.supply_chain:critical,malicious.shell:critical' WHEN 2 THEN 'malicious.supply_chain:high,credentials.token:critical' ELSE 'malicious.supply_chain:critical' END AS labels FROM documents")
def package_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    details = F.element_at(F.array(*map(F.lit, ["plain", "a Reverse Shell", "reads .env", "a backdoor"])), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", D.package_findings(F.lit("s"), details).alias("f"))
    return rows.select("doc_id", F.array_join(F.transform("f", lambda f: F.concat(f["subcategory"], F.lit(":"), f["severity"])), ",").alias("labels"))


@query("SELECT name FROM (SELECT DISTINCT source AS name FROM documents) ORDER BY NOT (contains(name, '7') OR contains(name, '9')), name LIMIT 12")
def priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.priority_fill(table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct(), "name", ["7", "9"], 12)


@query("SELECT lang AS key, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS a, round(avg(CASE WHEN doc_id % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS b FROM documents GROUP BY lang")
def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id")
    part = lambda name, step: rows.groupBy(F.col("lang").alias("key")).agg(F.round(F.avg((F.col("doc_id") % step == 0).cast("double")), 6).alias("accuracy")).withColumn("model", F.lit(name))
    return D.model_table(part("a", 3).unionByName(part("b", 5)), ["a", "b"])
