"""Evaluation, and two plain queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.folders import work_folder
from siftstone.operators import evaluation as E
from siftstone.operators import resumable
from siftstone.queries.base import predictions, query, quoted, scored_sql, table, truth
from siftstone.schema import CATEGORIES


def rows(spark: SparkSession, sf_dir: str, step: int = 7) -> DataFrame:
    return E.scored(truth(spark, sf_dir), predictions(spark, sf_dir, step))


SCORED = scored_sql()


@query(f"SELECT dimension, value, count(*) AS n, count(*) FILTER (correct) AS n_correct, round(count(*) FILTER (correct) / count(*), 6) AS accuracy FROM (SELECT 'overall' AS dimension, '' AS value, correct FROM ({SCORED}) UNION ALL SELECT 'bucket', bucket, correct FROM ({SCORED}) WHERE NOT failed UNION ALL SELECT 'category', category, correct FROM ({SCORED}) WHERE NOT failed) GROUP BY dimension, value")
def accuracy_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accuracy_by(rows(spark, sf_dir), "bucket", "category")


LABELS = f"SELECT label, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM (SELECT label, count(*) FILTER (role = 'tp') AS tp, count(*) FILTER (role = 'fp') AS fp, count(*) FILTER (role = 'fn') AS fn FROM (SELECT category AS label, CASE WHEN lower(predicted) = category THEN 'tp' ELSE 'fn' END AS role FROM ({SCORED}) UNION ALL SELECT lower(predicted), 'fp' FROM ({SCORED}) WHERE lower(predicted) <> category) GROUP BY label)"
RATES = f"SELECT label, tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM ({LABELS})"


@query(RATES)
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.per_label(rows(spark, sf_dir))


@query(f"SELECT round(avg(coalesce(precision, 0)), 6) AS macro_precision, round(avg(coalesce(recall, 0)), 6) AS macro_recall, round(avg(coalesce(f1, 0)), 6) AS macro_f1 FROM (VALUES {', '.join(f'({quoted(c)})' for c in CATEGORIES)}) c(label) LEFT JOIN ({RATES}) r ON r.label = c.label")
def macro_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.macro(rows(spark, sf_dir))


@query(f"SELECT label, tp, fp, fn, precision, recall, f1, tp + fn AS support FROM ({RATES}) WHERE tp + fn >= 5 ORDER BY f1, label LIMIT 10")
def weakest_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.weakest(E.per_label(rows(spark, sf_dir)))


@query(f"SELECT category AS expected, {', '.join(f'round(count(*) FILTER (lower(predicted) = {quoted(c)}) / count(*), 6) AS {c}' for c in CATEGORIES)} FROM ({SCORED}) GROUP BY category")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confusion(rows(spark, sf_dir))


@query(f"SELECT count(*) AS n, round(avg(CAST(lower(predicted) <> 'safe' AS INT)), 6) AS rate FROM ({SCORED}) WHERE category = 'safe'")
def fp_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.false_positive_rate(rows(spark, sf_dir))


SETS = f"SELECT id, list_distinct([category, bucket]) AS e, list_distinct([lower(predicted), bucket]) AS p FROM ({SCORED})"
MULTI = f"SELECT label, count(*) FILTER (list_contains(e, label) AND list_contains(p, label)) AS tp, count(*) FILTER (NOT list_contains(e, label)) AS fp, count(*) FILTER (NOT list_contains(p, label)) AS fn FROM (SELECT e, p, unnest(list_distinct(list_concat(e, p))) AS label FROM ({SETS})) GROUP BY label"


@query(f"SELECT label, tp, fp, fn FROM ({MULTI})")
def multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.multi_label(_sets(spark, sf_dir)).select("label", "tp", "fp", "fn")


@query(f"SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(sum(tp) / (sum(tp) + sum(fp) + sum(fn)), 6) AS jaccard FROM ({MULTI})")
def jaccard_multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.multi_label_overall(_sets(spark, sf_dir))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select(F.array_distinct(F.array("category", "bucket")).alias("expected"), F.array_distinct(F.array(F.lower("predicted"), F.col("bucket"))).alias("predicted"))


WILSON = "SELECT bucket, n, k, round(100.0 * k / n, 4) AS percent, round(100 * greatest(c - s, 0.0), 4) AS low, round(100 * least(c + s, 1.0), 4) AS high FROM (SELECT bucket, n, k, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS c, 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n)) / (1 + 3.8416 / n) AS s FROM (SELECT bucket, n, k, CAST(k AS DOUBLE) / n AS p FROM (SELECT bucket, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (correct) AS k FROM ({}) GROUP BY bucket)))"


@query(f"SELECT bucket, CAST(n AS BIGINT) AS n, k, percent, low, high FROM ({WILSON.format(SCORED)})")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.accuracy_interval(rows(spark, sf_dir), "bucket")


@query(f"SELECT common, n10, n01, CASE WHEN n10 + n01 > 0 THEN round(power(abs(n10 - n01) - 1, 2) / (n10 + n01), 6) END AS chi_square FROM (SELECT count(*) AS common, count(*) FILTER (a.correct AND NOT b.correct) AS n10, count(*) FILTER (NOT a.correct AND b.correct) AS n01 FROM ({SCORED}) a JOIN ({scored_sql(13)}) b ON a.id = b.id)")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mcnemar(rows(spark, sf_dir), rows(spark, sf_dir, 13))


def _accuracy(sql: str) -> str:
    return f"SELECT bucket, round(count(*) FILTER (correct) / count(*), 6) AS accuracy FROM ({sql}) WHERE NOT failed GROUP BY bucket"


@query(f"SELECT a.bucket AS value, a.accuracy AS a, b.accuracy AS b, round(100 * (b.accuracy - a.accuracy), 4) AS points FROM ({_accuracy(SCORED)}) a JOIN ({_accuracy(scored_sql(13))}) b ON a.bucket = b.bucket")
def accuracy_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda step: E.accuracy_by(rows(spark, sf_dir, step), "bucket").where("dimension = 'bucket'").select("value", "accuracy")
    return E.delta(of(7), of(13), "value", "accuracy")


@query(f"SELECT accuracy, NULL::DOUBLE AS mean_seconds, CASE WHEN accuracy >= 0.9 THEN 'good' WHEN accuracy >= 0.8 THEN 'fair' ELSE 'poor' END AS tier FROM (SELECT round(avg(CAST(correct AS INT)), 6) AS accuracy FROM ({SCORED}))")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.verdict(rows(spark, sf_dir))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS quantity, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL")
def smoke_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine smoke test, no operator of the scanner."""
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= DATE '1998-09-02'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("double").alias("quantity"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, c_nationkey, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL ORDER BY orders DESC, o_custkey LIMIT 25")
def smoke_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine smoke test, no operator of the scanner."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return joined.groupBy("o_custkey", "c_nationkey").agg(F.count(F.lit(1)).alias("orders")).orderBy(F.desc("orders"), "o_custkey").limit(25)


@query(f"SELECT id, lower(predicted) AS predicted, failed AS again FROM ({SCORED})")
def resumed_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of two calls on one folder: those that failed in the first are done again by the second, the others aren't."""
    todo = predictions(spark, sf_dir).select("id", F.col("predicted").alias("said"), "error")
    answer = lambda failed, call: lambda rows: rows.select("id", F.when(~failed, F.lower("said")).alias("predicted"), F.when(failed, F.lit("timeout")).alias("error"), F.lit(call).alias("call"))
    folder = work_folder(spark, "evaluation")
    resumable.evaluate(todo, answer(F.col("error").isNotNull(), 1), folder, "id", batch_rows=20_000_000)
    rows = resumable.evaluate(todo, answer(F.lit(False), 2), folder, "id", batch_rows=20_000_000)
    return rows.select("id", "predicted", (F.col("call") == 2).alias("again"))


MODELS = {"a": 7, "b": 5, "c": 3}
LONG = " UNION ALL ".join(f"SELECT '{m}' AS model, id, correct FROM ({scored_sql(step)})" for m, step in MODELS.items())


@query(f"""SELECT a, b, common, n10, n01, round(CASE WHEN n10 + n01 > 0 THEN pow(abs(n10 - n01) - 1, 2) / (n10 + n01) END, 6) AS chi_square
FROM (SELECT x.model AS a, y.model AS b, count(*) AS common, count(*) FILTER (x.correct AND NOT y.correct) AS n10, count(*) FILTER (y.correct AND NOT x.correct) AS n01
      FROM ({LONG}) x JOIN ({LONG}) y ON x.id = y.id AND x.model < y.model GROUP BY 1, 2)""")
def mcnemar_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of three sets of predictions."""
    parts = [rows(spark, sf_dir, step).select("id", "correct", F.lit(m).alias("model")) for m, step in MODELS.items()]
    pairs = E.all_pairs(parts[0].unionByName(parts[1]).unionByName(parts[2]), list(MODELS))
    return pairs.select("a", "b", "common", "n10", "n01", F.round("chi_square", 6).alias("chi_square"))
