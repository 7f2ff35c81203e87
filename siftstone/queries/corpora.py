"""Corpus building and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import corpus as C
from siftstone.operators import ranking as K
from siftstone.queries.base import FILE_FINDINGS, FINDING_ROWS, documents, files, query, quoted, sql_list, table

SEEDED = "sha256('42|' || CAST(doc_id AS VARCHAR))"


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY substring(text, 1, 200) ORDER BY doc_id) = 1")
def prefix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.prefix_dedup(documents(spark, sf_dir, "doc_id", "source", "text"), 200, "doc_id").select("doc_id", "source")


@query("SELECT doc_id, left(sha256(substring(text, 1, 500)), 16) AS fp, left(sha256(text), 16) AS whole FROM documents")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "doc_id", "text").select("doc_id", C.fingerprint(F.col("text")).alias("fp"), C.fingerprint(F.col("text"), None).alias("whole"))


@query("SELECT doc_id FROM documents d WHERE doc_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM documents t WHERE t.doc_id % 4 <> 0 AND sha256(substring(t.text, 1, 500)) = sha256(substring(d.text, 1, 500)))")
def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return C.hold_out(docs.where("doc_id % 4 = 0"), docs.where("doc_id % 4 <> 0")).select("doc_id")


@query("SELECT origin, sha256(text) AS digest, lang FROM (SELECT 'documents' AS origin, text, lang FROM documents UNION ALL SELECT 'pages', html, NULL FROM pages UNION ALL SELECT 'conversations', text, NULL FROM conversations)")
def combine_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), "text", "lang"), table(spark, sf_dir, "pages").select(F.lit("pages").alias("origin"), F.col("html").alias("text")), table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), "text")]
    return C.combine(parts).select("origin", F.sha2("text", 256).alias("digest"), "lang")


@query(f"SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {SEEDED}, doc_id) <= 20")
def cap_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.cap_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 20, "doc_id")


@query(f"SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'de') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {SEEDED}, doc_id) <= CASE lang WHEN 'en' THEN 30 WHEN 'fr' THEN 20 ELSE 10 END")
def stratified_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.stratified_quota(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": 30, "fr": 20, "de": 10}, "doc_id", strict=False)


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {SEEDED}, doc_id) AS k, {SEEDED} AS s, (SELECT count(DISTINCT lang) FROM documents) AS g FROM documents) ORDER BY k > 200 // g, s, doc_id LIMIT 200")
def balanced_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.balanced_fill(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 200, "doc_id")


@query(f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang = 'en' ORDER BY {SEEDED}, doc_id) <= CASE WHEN lang = 'en' THEN 85 ELSE 15 END")
def two_class_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.two_class_share(table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("lang") == "en", 100, 0.85, "doc_id")


@query("SELECT doc_id, chars FROM (SELECT doc_id, length(text) AS chars FROM documents) ORDER BY chars DESC, doc_id LIMIT 50")
def longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir, "doc_id", "text").select("doc_id", F.length("text").alias("chars"))
    return K.best_first(rows, F.col("chars"), 50, "doc_id")


RICH = "CASE subcategory WHEN 'pii.identity' THEN 10 WHEN 'credentials.password' THEN 50 WHEN 'confidential.internal' THEN 20 ELSE 0 END"


@query(f"SELECT path, CAST(sum({RICH}) AS INT) AS points FROM ({FILE_FINDINGS}) GROUP BY path ORDER BY points DESC, path LIMIT 40")
def richness_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir).select("path", C.richness(F.col("findings")).alias("points"))
    return K.best_first(rows, F.col("points"), 40, "path")


@query(f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {SEEDED}, doc_id) <= floor((SELECT count(*) FROM documents) * 0.05) THEN 'val' ELSE 'train' END AS split FROM documents")
def split_train_val(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.split_train_validation(table(spark, sf_dir, "documents").select("doc_id"), 0.05, "doc_id")


@query("SELECT doc_id, printf('doc_%05d', row_number() OVER (ORDER BY sha256('0|' || CAST(doc_id AS VARCHAR)), doc_id) - 1) AS id FROM documents")
def numbered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.numbered(table(spark, sf_dir, "documents").select("doc_id"), "doc_", "doc_id")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = files(spark, sf_dir).select(F.regexp_extract("path", "/(\\d+)\\.", 1).cast("bigint").alias("id"), "findings")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.join(made, F.col("doc_id") == F.col("id")).select("id", "text", "findings")


# The operators' own limit of input characters.
HEAD = "substring(text, 1, 4000)"
CUT = f"CASE WHEN length(text) <= 4000 THEN text WHEN position(' ' IN {HEAD}) > 0 AND 4000 - position(' ' IN reverse({HEAD})) > 2800 THEN substring(text, 1, 4000 - position(' ' IN reverse({HEAD}))) || chr(10) || '[...truncated...]' ELSE {HEAD} || chr(10) || '[...truncated...]' END"
ANSWER = f"SELECT doc_id, '[' || string_agg('{{\"category\":\"' || category || '\",\"subcategory\":\"' || subcategory || '\",\"severity\":\"' || severity || '\",\"explanation\":\"' || description || '\"}}', ',' ORDER BY pos) || ']' AS output FROM ({FINDING_ROWS}) GROUP BY doc_id"


ALPACA = f"SELECT d.doc_id AS id, ({sql_list(C.INSTRUCTIONS)})[CAST(CAST('0x' || substring(sha256('42|' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) % {len(C.INSTRUCTIONS)} AS INT) + 1] AS instruction, {CUT} AS input, output FROM documents d JOIN ({ANSWER}) a ON a.doc_id = d.doc_id"


@query(ALPACA)
def sft_alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.alpaca(_pairs(spark, sf_dir))


@query(f"SELECT id, 3 AS messages, 'system,user,assistant' AS roles, {quoted(C.SYSTEM)} AS system, instruction || chr(10) || chr(10) || input AS user, output AS assistant FROM ({ALPACA})")
def sft_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.chat(_pairs(spark, sf_dir))
    content = [F.get("messages", F.lit(k))["content"].alias(name) for k, name in enumerate(("system", "user", "assistant"))]
    return rows.select("id", F.size("messages").alias("messages"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), *content)


@query(f"SELECT id, replace({quoted('### System:|' + C.SYSTEM + '||### User:|')}, '|', chr(10)) || instruction || chr(10) || chr(10) || input || replace('||### Assistant:|', '|', chr(10)) AS prompt, output AS completion FROM ({ALPACA})")
def sft_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.completion(_pairs(spark, sf_dir))


@query(f"SELECT subcategory, count(*) AS n, CAST(avg(CAST(several AS INT)) AS DOUBLE) AS several, count(*) > 5000 AS over_cap FROM (SELECT path, coalesce(arg_min(subcategory, pos), 'unknown') AS subcategory, count(pos) > 1 AS several FROM ({FILE_FINDINGS}) GROUP BY path) GROUP BY subcategory ORDER BY n DESC, subcategory LIMIT 30")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.corpus_stats(files(spark, sf_dir))


@query(f"SELECT split_part(path, '/', 1) AS source, subcategory, count(*) AS n FROM ({FILE_FINDINGS}) WHERE subcategory IS NOT NULL GROUP BY ALL")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.source_counts(files(spark, sf_dir).withColumn("source", F.substring_index("path", "/", 1)))


CODES = {"CWE-79": "malicious.injection", "CWE-918": "malicious.ssrf"}


@query(f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'malicious.injection' WHEN 1 THEN 'malicious.ssrf' ELSE 'malicious.exploit' END AS label FROM documents")
def code_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("CWE-1"), F.lit("CWE-79"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("CWE-918"), F.lit("CWE-79"))).otherwise(F.array(F.lit("CWE-2")))
    return C.code_labels(table(spark, sf_dir, "documents").select("doc_id", code.alias("codes")), "codes", CODES, "malicious.exploit").select("doc_id", "label")


@query("SELECT doc_id FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 9 <> 0)")
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return C.not_done(docs, docs.where("doc_id % 3 = 0"), "doc_id", F.col("doc_id") % 9 == 0)


@query(f"SELECT printf('R%03d', row_number() OVER (ORDER BY {SEEDED}, doc_id)) AS review_id, doc_id AS key, substring(replace(text, chr(10), ' \\n '), 1, 1500) AS preview FROM documents")
def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.review_sheet(documents(spark, sf_dir, "doc_id", "text"), "doc_id")
