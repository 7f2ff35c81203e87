"""Registry and derived inputs. Derived tables (findings, answers, predictions) come from ids by rule, so SQL can make them too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.plans.scan import spread
from siftstone.schema import FINDINGS, finding, severity_name

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select(*columns) if columns else docs)


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def sql_hits(text: str, words: list[str]) -> str:
    """How many of the words the lower-case text holds."""
    return "(" + " + ".join(f"CAST(contains(lower({text}), {quoted(w)}) AS INT)" for w in words) + ")"


# Subcategories of the derived findings, in the order in which ids choose them.
SUBS = ["pii.identity", "credentials.password", "safe.documentation", "malicious.shell", "financial.credit_card", "confidential.internal", "safe.config"]


def finding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chunk_no, pos, category, subcategory, severity, sev_rank, description: none to five a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    rows = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).where(F.col("k") < F.col("doc_id") % 6)
    sub = F.element_at(F.array(*map(F.lit, SUBS)), ((F.col("doc_id") * 7 + F.col("k") * 3) % 7 + 1).cast("int"))
    rank = ((F.col("doc_id") + F.col("k") * 2) % 5).cast("int")
    return rows.select("doc_id", (F.col("k") % 3).alias("chunk_no"), F.col("k").alias("pos"), F.split(sub, "\\.")[0].alias("category"), sub.alias("subcategory"), severity_name(rank).alias("severity"), rank.alias("sev_rank"), F.concat(F.lit("finding "), F.col("k").cast("string")).alias("description"))


FINDING_ROWS = f"""SELECT doc_id, k % 3 AS chunk_no, k AS pos, split_part(sub, '.', 1) AS category, sub AS subcategory,
  (['info', 'low', 'medium', 'high', 'critical'])[r + 1] AS severity, r AS sev_rank, 'finding ' || CAST(k AS VARCHAR) AS description
FROM (SELECT doc_id, CAST(k AS INT) AS k, ({sql_list(SUBS)})[(doc_id * 7 + k * 3) % 7 + 1] AS sub, CAST((doc_id + k * 2) % 5 AS INT) AS r
      FROM (SELECT doc_id, unnest(range(0, 5)) AS k FROM documents) WHERE k < doc_id % 6)"""

EXTENSIONS = ["txt", "csv", "log", "md", "eml"]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, kind, size, findings of each document; without findings where none are derived."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("bigint").alias("size"))
    made = finding(F.col("category"), F.col("subcategory"), F.col("description"), F.col("severity"), F.lit("model"))
    lists = finding_rows(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", made.alias("f"))), lambda a, b: a["pos"] - b["pos"]), lambda x: x["f"]).alias("findings"))
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return docs.join(lists, "doc_id", "left").select(path.alias("path"), F.lit("text").alias("kind"), "size", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


FILES = f"SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) || '.' || ({sql_list(EXTENSIONS)})[doc_id % 5 + 1] AS path, CAST(strlen(text) AS BIGINT) AS size FROM documents"
FILE_FINDINGS = f"SELECT f.path, f.size, r.* FROM ({FILES}) f LEFT JOIN ({FINDING_ROWS}) r ON r.doc_id = f.doc_id"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, response): model answers of six kinds by id."""
    item = lambda sub, severity: f'{{"category": "{sub.split(".")[0]}", "subcategory": "{sub}", "severity": "{severity}", "explanation": "seen"}}'
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, ANSWERS(item))), (F.col("doc_id") % 6 + 1).cast("int")).alias("response"))


def ANSWERS(item) -> list[str]:  # noqa: N802
    return [
        f"[{item('pii.identity', 'high')}]",
        f"Two: [{item('credentials.token', 'critical')}, {item('safe.config', 'info')}] and more",
        f"[{item('pii.identity', 'low')}] again [{item('pii.identity', 'critical')}]",
        f"[{item('safe.documentation', 'info')}]",
        "No findings.",
        '[{"category": "confidential", "subcategory": "medical.record", "severity": "warning"}]',
    ]


#: Truth and two sets of predictions over the labelled documents.
LABEL_CATEGORIES = ["safe", "malicious", "confidential", "pii"]


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category, alt_category, bucket."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang")
    category = F.when(F.col("toxic") == 1, "malicious").when(F.col("quality") == 0, "confidential").otherwise("safe")
    alternative = F.when(F.col("doc_id") % 11 == 0, "pii")
    return labels.join(docs, "doc_id").select(F.col("doc_id").alias("id"), category.alias("category"), alternative.alias("alt_category"), F.col("lang").alias("bucket"))


def predictions(spark: SparkSession, sf_dir: str, step: int = 7) -> DataFrame:
    """id, predicted, error: right but for every `step`-th id, which has a category by rule; every 50th failed."""
    rows = truth(spark, sf_dir)
    other = F.element_at(F.array(*map(F.lit, LABEL_CATEGORIES)), (F.col("id") % 4 + 1).cast("int"))
    said = F.when(F.col("id") % step == 0, other).otherwise(F.upper("category"))
    return rows.select("id", said.alias("predicted"), F.when(F.col("id") % 50 == 0, "timeout").alias("error"))


def scored_sql(step: int = 7) -> str:
    return f"""SELECT id, category, bucket, predicted, failed, NOT failed AND (lower(predicted) = category OR (alt_category IS NOT NULL AND lower(predicted) = alt_category)) AS correct
FROM (SELECT id, category, alt_category, bucket, CASE WHEN id % {step} = 0 THEN ({sql_list(LABEL_CATEGORIES)})[id % 4 + 1] ELSE upper(category) END AS predicted, id % 50 = 0 AS failed
      FROM (SELECT l.doc_id AS id, CASE WHEN toxic = 1 THEN 'malicious' WHEN quality = 0 THEN 'confidential' ELSE 'safe' END AS category, CASE WHEN l.doc_id % 11 = 0 THEN 'pii' END AS alt_category, d.lang AS bucket
            FROM labels l JOIN documents d ON d.doc_id = l.doc_id))"""
