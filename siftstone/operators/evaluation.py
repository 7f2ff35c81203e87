"""Scoring predictions against truth: accuracy, precision and recall, confusion, intervals, paired tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftstone.schema import CATEGORIES


def clean(label: Column) -> Column:
    return F.lower(F.trim(F.coalesce(label, F.lit(""))))


def label_matches(predicted: Column, expected: Column, alternative: Column | None = None) -> Column:
    """Equal, or equal to an alternative label if there is one; case and outer blanks don't matter."""
    same = clean(predicted) == clean(expected)
    return same if alternative is None else same | ((clean(alternative) != "") & (clean(predicted) == clean(alternative)))


def subcategory_matches(predicted: Column, expected: Column) -> Column:
    """Equal, or predicted as the bare last part of a dotted label; not the other way round."""
    p, e = clean(predicted), clean(expected)
    return (p == e) | (e.contains(".") & (p == F.substring_index(e, ".", -1)))


def scored(truth: DataFrame, predictions: DataFrame, key: str = "id") -> DataFrame:
    """truth (key, category, [alt_category], ...) with predicted, correct and failed. predictions: key, predicted, [error].

    Of several predictions for a key one counts: one that didn't fail before one that did, then the greatest label.
    """
    error = F.col("error").isNotNull() if "error" in predictions.columns else F.lit(False)
    one = predictions.groupBy(F.col(key).alias("__key")).agg(F.max(F.struct((~error).alias("ok"), F.col("predicted").alias("predicted"))).alias("one"))
    said = one.select("__key", F.col("one.predicted").alias("predicted"), (~F.col("one.ok")).alias("failed"))
    alternative = F.col("alt_category") if "alt_category" in truth.columns else None
    return truth.join(said, F.col(key) == F.col("__key")).drop("__key").withColumn("correct", ~F.col("failed") & label_matches(F.col("predicted"), F.col("category"), alternative))


def accuracy_by(rows: DataFrame, *dims: str) -> DataFrame:
    """(dimension, value, n, n_correct, accuracy) overall and by each of `dims`. Failed rows count overall and nowhere else."""
    aggregate = lambda t: t.agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct"))
    sides = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims])
    places = F.concat(F.array(F.struct(F.lit("overall").alias("dimension"), F.lit("").alias("value"))), F.when(~F.col("failed"), sides).otherwise(F.slice(sides, 1, 0)))
    return aggregate(rows.select("correct", F.explode(places).alias("p")).groupBy("p.dimension", "p.value")).withColumn("accuracy", F.round(F.col("n_correct") / F.col("n"), 6))


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _rates(counts: DataFrame) -> DataFrame:
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rated = counts.withColumns({"precision": F.round(precision, 6), "recall": F.round(recall, 6)})
    return rated.withColumn("f1", F.round(ratio(2 * precision * recall, precision + recall), 6))


def per_label(rows: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall, f1) of rows with category and predicted, one label each."""
    e, p = clean(F.col("category")), clean(F.col("predicted"))
    role = lambda label, name: F.struct(label.alias("label"), F.lit(name).alias("role"))
    roles = rows.select(F.explode(F.when(e == p, F.array(role(e, "tp"))).otherwise(F.array(role(p, "fp"), role(e, "fn")))).alias("r"))
    return _rates(roles.groupBy("r.label").agg(*[F.count_if(F.col("r.role") == x).alias(x) for x in ("tp", "fp", "fn")]))


def macro(rows: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """One row: means of precision, recall and F1 over the fixed categories; one without rows counts as 0."""
    spark = rows.sparkSession
    dims = spark.createDataFrame([(c,) for c in categories], "label string")
    joined = F.broadcast(dims).join(per_label(rows), "label", "left")
    return joined.agg(*[F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])


def multi_label(rows: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, ...) of rows with arrays expected and predicted."""
    each = rows.select("expected", "predicted", F.explode(F.array_union("expected", "predicted")).alias("label"))
    e, p = F.array_contains("expected", F.col("label")), F.array_contains("predicted", F.col("label"))
    return _rates(each.groupBy("label").agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn")))


def multi_label_overall(rows: DataFrame) -> DataFrame:
    """One row: tp, fp, fn over all labels and tp / (tp + fp + fn)."""
    return multi_label(rows).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).withColumn("jaccard", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")), 6))


def weakest(labels: DataFrame, support: int = 5, most: int = 10) -> DataFrame:
    """Labels of least F1 among those with enough support (tp + fn)."""
    return labels.withColumn("support", F.col("tp") + F.col("fn")).where(F.col("support") >= support).orderBy("f1", "label").limit(most)


def confusion(rows: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """A row an expected category that occurs: its share of each predicted one (columns by name)."""
    counts = rows.select(clean(F.col("category")).alias("expected"), clean(F.col("predicted")).alias("p")).groupBy("expected").pivot("p", categories).count()
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in categories), F.lit(0))
    return counts.where(F.col("expected").isin(categories)).select("expected", *[F.round(F.coalesce(F.col(c), F.lit(0)) / F.greatest(total, F.lit(1)), 6).alias(c) for c in categories])


def false_positive_rate(rows: DataFrame) -> DataFrame:
    """One row: how many rows are safe, and the share of these with another prediction."""
    safe = rows.where(clean(F.col("category")) == "safe")
    return safe.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((clean(F.col("predicted")) != "safe").cast("int")), 6).alias("rate"))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct<low, high> in percent; (0, 0) for n = 0."""
    p = ratio(k, n)
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    end = lambda x: F.round(100 * F.when(n > 0, x).otherwise(0.0), 4)
    return F.struct(end(F.greatest(centre - spread, F.lit(0.0))).alias("low"), end(F.least(centre + spread, F.lit(1.0))).alias("high"))


def accuracy_interval(rows: DataFrame, *by: str) -> DataFrame:
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("k"))
    return counts.withColumn("w", F.when(F.col("n") > 0, wilson(F.col("k"), F.col("n")))).select(*by, "n", "k", F.round(100 * ratio(F.col("k"), F.col("n")), 4).alias("percent"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))


def mcnemar(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """One row: common ids, those only a or only b has right, chi_square with continuity correction (null if there are none)."""
    both = a.select(key, F.col("correct").alias("a")).join(b.select(key, F.col("correct").alias("b")), key)
    n = both.agg(F.count(F.lit(1)).alias("common"), F.count_if(F.col("a") & ~F.col("b")).alias("n10"), F.count_if(~F.col("a") & F.col("b")).alias("n01"))
    discordant = F.col("n10") + F.col("n01")
    return n.withColumn("chi_square", F.when(discordant > 0, F.round(F.pow(F.abs(F.col("n10") - F.col("n01")) - 1, F.lit(2)) / discordant, 6)))


# Coefficients of W. J. Cody's rational approximations of erfc (1969): for |x| up to 0.46875, up to 4, and above.
ERF_SMALL = ([3.16112374387056560e00, 1.13864154151050156e02, 3.77485237685302021e02, 3.20937758913846947e03, 1.85777706184603153e-1], [2.36012909523441209e01, 2.44024637934444173e02, 1.28261652607737228e03, 2.84423683343917062e03])
ERFC_MIDDLE = (
    [5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e01, 2.98635138197400131e02, 8.81952221241769090e02, 1.71204761263407058e03, 2.05107837782607147e03, 1.23033935479799725e03, 2.15311535474403846e-8],
    [1.57449261107098347e01, 1.17693950891312499e02, 5.37181101862009858e02, 1.62138957456669019e03, 3.29079923573345963e03, 4.36261909014324716e03, 3.43936767414372164e03, 1.23033935480374942e03],
)
ERFC_LARGE = ([3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4, 1.63153871373020978e-2], [2.56852019228982242e00, 1.87295284992346725e00, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3])


def _quotient(y: Column, top: list[float], bottom: list[float]) -> Column:
    """The polynomials' quotient: the last of `top` leads, the others follow; `bottom` leads with 1."""
    upper, lower = F.lit(top[-1]) * y, y
    for a, b in zip(top[:-2], bottom[:-1]):
        upper, lower = (upper + a) * y, (lower + b) * y
    return (upper + top[-2]) / (lower + bottom[-1])


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0, as a column: Spark has none."""
    small = 1 - x * _quotient(x * x, *ERF_SMALL)
    middle = F.exp(-x * x) * _quotient(x, *ERFC_MIDDLE)
    inverse = 1 / (x * x)
    large = F.exp(-x * x) / x * (1 / math.sqrt(math.pi) - inverse * _quotient(inverse, *ERFC_LARGE))
    return F.when(x <= 0.46875, small).when(x <= 4, middle).otherwise(large)


def p_value(chi_square: Column) -> Column:
    """Of a chi-square with one degree of freedom."""
    return erfc(F.sqrt(chi_square / 2))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def mcnemar_p(row) -> tuple[float | None, str]:
    """p-value and stars of a row of `mcnemar`."""
    if row["chi_square"] is None:
        return None, ""
    p = math.erfc(math.sqrt(row["chi_square"] / 2))
    return p, "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def all_pairs(scores: DataFrame, models: list[str], key: str = "id") -> DataFrame:
    """McNemar's test of every pair of models, in one pass: a, b, common, n10 (only a is right), n01, chi_square, p, stars.

    scores: key, model, correct. A key's answers become one row of two bit sets, of the models that answered and of those
    that were right, and a pair's counts are sums over these rows; nothing is joined with itself. Repeated answers of a model
    to a key: right if the greatest is. Null keys and models not named are left out. Pairs are in the order of `models` (62 at
    most); chi_square has the continuity correction, and is null without a discordant key, as p then is.
    """
    assert len(models) <= 62
    number = F.array_position(F.array(*map(F.lit, models)), F.col("model")).cast("int") - 1
    rows = scores.where(F.col(key).isNotNull() & F.col("model").isin(models)).groupBy(F.col(key).alias("k"), number.alias("m")).agg(F.max(F.coalesce("correct", F.lit(False))).alias("right"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("m"))
    sets = rows.groupBy("k").agg(F.sum(bit).alias("there"), F.coalesce(F.sum(F.when(F.col("right"), bit)), F.lit(0).cast("bigint")).alias("right"))
    # Keys with the same sets count together: their number no longer matters to the pairs.
    sets = sets.groupBy("there", "right").agg(F.count(F.lit(1)).alias("n"))
    pairs = [(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]
    struct = F.array(*[F.struct(F.lit(1 << i).cast("bigint").alias("x"), F.lit(1 << j).cast("bigint").alias("y"), F.lit(models[i]).alias("a"), F.lit(models[j]).alias("b"), F.lit(k).alias("k")) for k, (i, j) in enumerate(pairs)]) if pairs else F.array().cast("array<struct<x:bigint,y:bigint,a:string,b:string,k:int>>")
    each = sets.select("there", "right", "n", F.explode(struct).alias("p")).select("there", "right", "n", "p.*")
    both = (F.col("there").bitwiseAND(F.col("x")) != 0) & (F.col("there").bitwiseAND(F.col("y")) != 0)
    a, b = F.col("right").bitwiseAND(F.col("x")) != 0, F.col("right").bitwiseAND(F.col("y")) != 0
    n = each.where(both).groupBy("k", "a", "b").agg(F.sum("n").alias("common"), F.coalesce(F.sum(F.when(a & ~b, F.col("n"))), F.lit(0)).alias("n10"), F.coalesce(F.sum(F.when(~a & b, F.col("n"))), F.lit(0)).alias("n01"))
    discordant = F.col("n10") + F.col("n01")
    n = n.withColumn("chi_square", F.when(discordant > 0, F.pow((F.abs(F.col("n10") - F.col("n01")) - 1).cast("double"), F.lit(2.0)) / discordant))
    return n.withColumn("p", p_value(F.col("chi_square"))).withColumn("stars", F.when(F.col("p").isNotNull(), stars(F.col("p"))).otherwise("")).select("a", "b", "common", "n10", "n01", "chi_square", "p", "stars")


def delta(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b, points): the difference of two tables' values in percentage points."""
    return a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key).withColumn("points", F.round(100 * (F.col("b") - F.col("a")), 4))


def verdict(rows: DataFrame) -> DataFrame:
    """One row: accuracy, mean seconds (if `elapsed` is there) and a tier: good from 0.9, fair from 0.8, else poor."""
    seconds = F.round(F.avg("elapsed"), 6) if "elapsed" in rows.columns else F.lit(None).cast("double")
    one = rows.agg(F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), seconds.alias("mean_seconds"))
    return one.withColumn("tier", F.when(F.col("accuracy") >= 0.9, "good").when(F.col("accuracy") >= 0.8, "fair").otherwise("poor"))
