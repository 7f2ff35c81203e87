"""Merging, roll-ups and exports of findings; parsing of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.folders import work_folder
from siftstone.functions.responses import parse_detailed, parse_findings, parse_lenient, repaired_labels, resolved_category
from siftstone.operators import findings as M
from siftstone.operators import report as P
from siftstone.queries.base import ANSWERS, EXTENSIONS, FILE_FINDINGS, FILES, FINDING_ROWS, answers, files, finding_rows, query, quoted, sql_list, table
from siftstone.schema import CATEGORIES, SEVERITIES

MERGED = f"""SELECT doc_id, category, subcategory, severity, chunk_no, pos FROM ({FINDING_ROWS}) WHERE category <> 'safe' QUALIFY row_number() OVER (PARTITION BY doc_id, category, subcategory ORDER BY sev_rank DESC, chunk_no, pos) = 1
UNION ALL SELECT doc_id, category, subcategory, severity, chunk_no, pos FROM ({FINDING_ROWS}) f WHERE category = 'safe' AND NOT EXISTS (SELECT 1 FROM ({FINDING_ROWS}) r WHERE r.doc_id = f.doc_id AND r.category <> 'safe')"""


@query(MERGED)
def merge_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_rows(finding_rows(spark, sf_dir)).select("doc_id", "category", "subcategory", "severity", "chunk_no", "pos")


@query(f"SELECT path, subcategory, severity FROM ({FILE_FINDINGS}) WHERE category <> 'safe' QUALIFY row_number() OVER (PARTITION BY path, category, subcategory ORDER BY sev_rank DESC, pos) = 1")
def merge_nested_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("path", F.explode(M.merge_nested(F.col("findings"))).alias("f"))
    return rows.where("f.category <> 'safe'").select("path", "f.subcategory", "f.severity")


@query(f"SELECT path, subcategory, severity FROM ({FILE_FINDINGS}) WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY category = 'safe', CASE WHEN category = 'safe' THEN 0 ELSE -sev_rank END, pos) = 1")
def primary_finding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("path", M.primary(F.col("findings")).alias("f")).where("f IS NOT NULL").select("path", "f.subcategory", "f.severity")


@query(f"SELECT path, string_agg(category, ',' ORDER BY p) AS categories, max(r) AS sev_rank FROM (SELECT path, category, min(pos) AS p, max(sev_rank) AS r FROM ({FILE_FINDINGS}) WHERE category <> 'safe' GROUP BY path, category) GROUP BY path")
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("path", M.labels(F.col("findings")).alias("l"))
    return rows.where(F.size("l.categories") > 0).select("path", F.array_join("l.categories", ",").alias("categories"), "l.sev_rank")


@query(f"SELECT count(DISTINCT path) AS files, count(*) FILTER (category <> 'safe') AS findings, count(DISTINCT path) FILTER (category <> 'safe') AS flagged, count(DISTINCT path) - count(DISTINCT path) FILTER (category <> 'safe') AS clean, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'low') AS low, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'critical') AS critical, (['info', 'low', 'medium', 'high', 'critical'])[max(sev_rank) FILTER (category <> 'safe') + 1] AS max_severity FROM ({FILE_FINDINGS})")
def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.summary(files(spark, sf_dir))


@query(f"SELECT count(DISTINCT path) FILTER (category <> 'safe') AS risky, count(DISTINCT path) FILTER (category IS NOT NULL) AS any_finding, count(DISTINCT path) FILTER (category <> 'safe' AND sev_rank > 0) AS risky_above_info, count(DISTINCT path) FILTER (category <> 'safe') AS pdf FROM ({FILE_FINDINGS})")
def flagged_four_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.flagged_by_definition(files(spark, sf_dir))


@query(f"SELECT category, count(*) AS n FROM ({FINDING_ROWS}) WHERE category <> 'safe' GROUP BY category")
def category_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.category_counts(files(spark, sf_dir))


@query(f"SELECT path, string_agg(CAST(n AS VARCHAR) || ' ' || severity, ', ' ORDER BY sev_rank DESC) AS breakdown FROM (SELECT path, severity, sev_rank, count(*) AS n FROM ({FILE_FINDINGS}) WHERE category <> 'safe' GROUP BY ALL) GROUP BY path")
def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.severity_breakdown(files(spark, sf_dir))


@query(f"SELECT ({sql_list(EXTENSIONS)})[doc_id % 5 + 1] AS ext, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM ({FILES}) GROUP BY 1 ORDER BY files DESC, ext LIMIT 50")
def extension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.extension_counts(files(spark, sf_dir))


@query(f"SELECT coalesce(max(category <> 'safe' AND sev_rank >= 4), false) AS exceeded, CAST(coalesce(max(category <> 'safe' AND sev_rank >= 4), false) AS INT) AS exit_code FROM ({FINDING_ROWS})")
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.at_or_above(files(spark, sf_dir), "critical")


@query(f"SELECT path, pos, category AS rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, description AS message, 1 AS start_line FROM ({FILE_FINDINGS}) WHERE category <> 'safe'")
def report_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sarif_results(files(spark, sf_dir))


@query(f"SELECT path, '## ' || path || chr(10) || coalesce(string_agg('- **' || upper(severity) || '** ' || category || ': ' || description, chr(10) ORDER BY pos), '') AS section FROM ({FILE_FINDINGS}) GROUP BY path")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.markdown_sections(files(spark, sf_dir))


@query(f"SELECT path, pos, '[' || severity || '] ' || category || ': ' || description AS line FROM ({FILE_FINDINGS}) WHERE category IS NOT NULL")
def report_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.terminal_lines(files(spark, sf_dir))


@query(f"SELECT path, '{{\"path\":\"' || path || '\",\"kind\":\"text\",\"size\":' || CAST(any_value(size) AS VARCHAR) || ',\"findings\":[' || coalesce(string_agg('{{\"category\":\"' || category || '\",\"description\":\"' || description || '\",\"evidence\":\"' || subcategory || '\",\"severity\":\"' || severity || '\",\"source\":\"model\"}}', ',' ORDER BY pos), '') || ']}}' AS json FROM ({FILE_FINDINGS}) GROUP BY path")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.json_lines(files(spark, sf_dir))


@query(f"SELECT name, string_agg(category, ', ' ORDER BY p) AS categories, (['info', 'low', 'medium', 'high', 'critical'])[max(r) + 1] AS severity, coalesce(max(explanation), 'No description.') AS explanation FROM (SELECT string_split(path, '/')[-1] AS name, CASE WHEN category <> 'safe' THEN category END AS category, min(pos) AS p, max(CASE WHEN category <> 'safe' THEN sev_rank END) AS r, arg_min(CASE WHEN category = 'safe' THEN description END, pos) FILTER (category = 'safe') AS explanation FROM ({FILE_FINDINGS}) GROUP BY ALL) GROUP BY name")
def report_html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.html_rows(files(spark, sf_dir))
    return rows.withColumn("categories", F.when(F.col("categories") != "", F.col("categories")))


@query(f"SELECT path, pos, category, severity, description FROM ({FILE_FINDINGS}) WHERE severity = 'high' AND category = 'pii' AND contains(lower(path), 'src1')")
def filter_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.filter_findings(P.exploded(files(spark, sf_dir)), "high", "pii", "SRC1").select("path", "pos", "category", "severity", "description")


@query(f"SELECT path, pos, severity FROM ({FILE_FINDINGS}) WHERE severity IS NOT NULL ORDER BY sev_rank DESC, path, pos")
def sort_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sort_findings(P.exploded(files(spark, sf_dir)).where("severity IS NOT NULL"), "severity", descending=True).select("path", "pos", "severity")


PARSED = [("pii", "pii.identity", "high", "seen"), ("credentials", "credentials.token", "critical", "seen"), ("pii", "pii.identity", "low", "seen"), ("safe", "safe.documentation", "info", "seen"), ("safe", "safe.documentation", "info", "Nothing of concern found."), ("medical", "medical.record", "medium", "Detected medical.record content")]


@query("SELECT doc_id, " + ", ".join(f"CASE doc_id % 6 {' '.join(f'WHEN {k} THEN {quoted(p[i])}' for k, p in enumerate(PARSED))} END AS {name}" for i, name in enumerate(("category", "subcategory", "severity", "description"))) + " FROM documents")
def parse_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("doc_id", F.explode(parse_findings(F.col("response"))).alias("f")).select("doc_id", "f.category", "f.subcategory", "f.severity", "f.description")


@query("SELECT doc_id, 'pii' AS category, 'high' AS severity, 'a' AS extracted FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'x', 'info', '' FROM documents WHERE doc_id % 3 = 1")
def parse_greedy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = ['so [{"category": "pii", "description": "d", "severity": "high", "extracted_data": {"k": "a", "blank": " "}}] it is', '[{"category": "x", "description": "d", "severity": "odd"}]', '[{"category": "pii"}] and [broken']
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, said)), (F.col("doc_id") % 3 + 1).cast("int")).alias("r"))
    return rows.select("doc_id", F.explode(parse_detailed(F.col("r"))).alias("f")).select("doc_id", "f.category", "f.severity", F.array_join(F.map_values("f.extracted_data"), ",").alias("extracted"))


LENIENT = [("pii", "low"), None, [("a", "low"), ("c", "low")], ("pii", "low"), None, ("confidential", "warning")]
LENIENT_SQL = " ".join(f"WHEN {k} THEN {quoted(' '.join(f'{c}/{s}' for c, s in ([x] if isinstance(x, tuple) else x or [])))}" for k, x in enumerate(LENIENT))


@query(f"SELECT doc_id, CASE doc_id % 6 {LENIENT_SQL} END AS items FROM documents")
def parse_lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = lambda sub, severity: f'{{"category": "{sub.split(".")[0]}", "severity": "{severity}"}}'
    said = [item("pii.x", "low"), "none", f"```json\n[{item('a.b', 'low')}, {item('c.d', 'low')}]\n```", f"see [{item('pii.x', 'low')}] there", "[1", ANSWERS(item)[5]]
    rows = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, said)), (F.col("doc_id") % 6 + 1).cast("int")).alias("r"))
    return rows.select("doc_id", F.array_join(F.transform(parse_lenient(F.col("r")), lambda x: F.concat(x["category"], F.lit("/"), x["severity"])), " ").alias("items"))


PAIRS = f"SELECT doc_id, ({sql_list(['confidential', 'pii', 'safe'])})[doc_id % 3 + 1] AS category, ({sql_list(['medical.record', 'other.thing', 'pii.identity', 'plain'])})[doc_id % 4 + 1] AS subcategory FROM documents"
KNOWN = f"contains(subcategory, '.') AND split_part(subcategory, '.', 1) IN ({', '.join(map(quoted, CATEGORIES))})"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.col("doc_id") % len(words) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", pick(["confidential", "pii", "safe"]).alias("category"), pick(["medical.record", "other.thing", "pii.identity", "plain"]).alias("subcategory"))


@query(f"SELECT doc_id, subcategory, CASE WHEN category = 'confidential' AND {KNOWN} THEN split_part(subcategory, '.', 1) ELSE category END AS resolved FROM ({PAIRS})")
def resolve_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("doc_id", "subcategory", resolved_category(F.col("category"), F.col("subcategory")).alias("resolved"))


@query(f"SELECT doc_id, subcategory, CASE WHEN {KNOWN} THEN split_part(subcategory, '.', 1) ELSE category END AS category, CASE WHEN {KNOWN} THEN CAST(split_part(subcategory, '.', 1) <> category AS BIGINT) ELSE 0 END AS fixed FROM ({PAIRS})")
def repair_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pairs(spark, sf_dir).withColumn("findings", F.array(F.struct("category", "subcategory"))).withColumn("after", repaired_labels(F.col("findings")))
    return rows.select("doc_id", "subcategory", F.col("after")[0]["category"].alias("category"), (F.col("after")[0]["category"] != F.col("category")).cast("bigint").alias("fixed"))


@query(f"SELECT path, category AS rule_id, severity, description AS message FROM ({FILE_FINDINGS}) WHERE category <> 'safe'")
def sarif_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of a SARIF document, written as one file and read again."""
    at = P.write_document(spark, P.sarif_pieces(files(spark, sf_dir)), f"{work_folder(spark, 'sarif')}/report.sarif.json")
    place = "locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>>>>"
    rows = spark.read.text(at).select(F.from_json(F.regexp_replace("value", "^,", ""), f"ruleId string, message struct<text:string>, properties struct<severity:string>, {place}").alias("r")).where("r.ruleId IS NOT NULL")
    return rows.select(F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("path"), F.col("r.ruleId").alias("rule_id"), "r.properties.severity", F.col("r.message.text").alias("message"))


FIRST_SEEN = f"SELECT path, string_agg(category, ', ' ORDER BY seen) AS label FROM (SELECT path, category, min(pos) AS seen FROM ({FILE_FINDINGS}) WHERE category <> 'safe' GROUP BY path, category) GROUP BY path"
CALM = f"SELECT path, arg_min(description, pos) AS said FROM ({FILE_FINDINGS}) WHERE category = 'safe' GROUP BY path"
WORST = f"SELECT path, max(sev_rank) AS worst FROM ({FILE_FINDINGS}) WHERE category <> 'safe' GROUP BY path"


@query(f"SELECT f.path, coalesce(({sql_list(SEVERITIES)})[w.worst + 1], 'clean') AS status, coalesce(l.label, c.said, 'No findings') AS label FROM ({FILES}) f LEFT JOIN ({FIRST_SEEN}) l ON l.path = f.path LEFT JOIN ({CALM}) c ON c.path = f.path LEFT JOIN ({WORST}) w ON w.path = f.path")
def html_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of all files of an HTML report, written as one file and read again."""
    at = P.write_document(spark, P.html_pieces(files(spark, sf_dir)), f"{work_folder(spark, 'html')}/report.html", "")
    cells = F.regexp_extract_all("value", F.lit("<td>(.*?)</td>"), F.lit(1))
    return spark.read.text(at).where(F.col("value").startswith("<tr><td>")).select(cells.alias("c")).where(F.size("c") == 4).select(F.col("c")[0].alias("path"), F.col("c")[2].alias("status"), F.col("c")[3].alias("label"))
