"""Ranks and quotas in a seeded order, without bringing a group together.

The order of a row is the SHA-256 of the seed and its id, so any SQL engine can reproduce it. A row's rank is its rank
within a small bucket of that order plus the counts of earlier buckets: a group that holds a third of all rows is
spread over thousands of buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a bucket's number: 16^3 buckets a group.
DIGITS = 3


def seeded(id_column: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), id_column.cast("string")), 256)


def rank_in_group(rows: DataFrame, groups: list[Column], order: Column, tie: Column, name: str = "rank") -> DataFrame:
    """`rows` with the rank (from 1) of each within its group by (order, tie); order is a string of hex digits."""
    p = "__"
    while any(c.startswith(p) for c in rows.columns):
        p += "_"
    keyed = rows.withColumns({f"{p}g{k}": g for k, g in enumerate(groups)} | {f"{p}order": order, f"{p}tie": tie})
    keyed = keyed.withColumn(f"{p}bucket", F.substring(f"{p}order", 1, DIGITS))
    keys = [f"{p}g{k}" for k in range(len(groups))]
    counts = keyed.groupBy(*keys, f"{p}bucket").agg(F.count(F.lit(1)).alias(f"{p}n"))
    before = counts.select(*[F.col(k).alias(f"{k}b") for k in keys], F.col(f"{p}bucket").alias(f"{p}bucketb"), (F.sum(f"{p}n").over(Window.partitionBy(*keys).orderBy(f"{p}bucket")) - F.col(f"{p}n")).alias(f"{p}before"))
    near = F.row_number().over(Window.partitionBy(*keys, f"{p}bucket").orderBy(f"{p}order", f"{p}tie"))
    on = keyed[f"{p}bucket"] == before[f"{p}bucketb"]
    for k in keys:
        on = on & keyed[k].eqNullSafe(before[f"{k}b"])
    out = keyed.withColumn(f"{p}near", near).join(before, on)
    return out.withColumn(name, F.col(f"{p}before") + F.col(f"{p}near")).select(*rows.columns, name)


def cap_per_group(rows: DataFrame, group: str, most: int, id_column: str, seed: int = 42) -> DataFrame:
    """At most `most` rows of each group, by the seeded order; all columns."""
    return rank_in_group(rows, [F.col(group)], seeded(F.col(id_column), seed), F.col(id_column), "__rank").where(F.col("__rank") <= most).drop("__rank")


def stratified_quota(rows: DataFrame, group: str, quotas: dict[str, int], id_column: str, seed: int = 42, strict: bool | str = True) -> DataFrame:
    """Exactly quotas[g] rows of each named group by the seeded order, the rest of the groups left out.

    strict: a group that is short is an error, at once; "in plan": when rows are made, as part of the plan, so that nothing
    runs before; false: what there is.
    """
    quota = F.try_element_at(F.create_map(*[x for g, n in quotas.items() for x in (F.lit(g), F.lit(n))]), F.col(group))
    named = rows.where(F.col(group).isin(list(quotas)))
    out = rank_in_group(named, [F.col(group)], seeded(F.col(id_column), seed), F.col(id_column), "__rank").where(F.col("__rank") <= quota).drop("__rank")
    if strict == "in plan":
        return out.unionByName(_none_if_enough(named, group, quotas))
    if strict:
        have = {r[group]: r["n"] for r in out.groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
        if short := {g: have.get(g, 0) for g, n in quotas.items() if have.get(g, 0) < n}:
            raise ValueError(f"too few rows for the quota: {short}")
    return out


def _none_if_enough(rows: DataFrame, group: str, quotas: dict[str, int]) -> DataFrame:
    """No row, with the columns of `rows`; an error when that is found out, if a group has too few."""
    counts = rows.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.map_from_entries(F.collect_list(F.struct("g", "n"))).alias("have"))  # a row; groups are those of the quota
    count = lambda w: F.coalesce(F.try_element_at("have", w["g"]), F.lit(0))
    short = F.filter(F.array(*[F.struct(F.lit(g).alias("g"), F.lit(n).alias("n")) for g, n in quotas.items()]), lambda w: count(w) < w["n"])
    told = F.array_join(F.transform(short, lambda w: F.concat(w["g"], F.lit(": "), count(w).cast("string"), F.lit(" of "), w["n"].cast("string"))), ", ")
    # In a condition, which isn't pruned as a column may be.
    failed = F.when(F.size(short) > 0, F.raise_error(F.concat(F.lit("too few rows for the quota: "), told)).cast("boolean")).otherwise(F.lit(False))
    return one.where(failed).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])


def balanced_fill(rows: DataFrame, group: str, most: int, id_column: str, seed: int = 42, text: str | None = None, chars: int = 200) -> DataFrame:
    """`most` rows spread over the groups: an equal share of each by the seeded order, then the best of the rest, whichever group.

    text: of rows whose texts start with the same characters, in whichever groups, only the first by group and id counts.
    """
    if text is not None:
        from siftstone.operators.corpus import prefix_dedup

        rows = prefix_dedup(rows, chars, id_column, text, F.col(group))
    n = rows.agg(F.count_distinct(group)).first()[0]
    share = most // max(n, 1)
    ranked = rank_in_group(rows, [F.col(group)], seeded(F.col(id_column), seed), F.col(id_column), "__rank")
    first = F.col("__rank") <= share
    return ranked.withColumn("__late", (~first).cast("int")).orderBy("__late", seeded(F.col(id_column), seed), id_column).limit(most).drop("__rank", "__late")


def two_class_share(rows: DataFrame, is_first: Column, most: int, share: float, id_column: str, seed: int = 42) -> DataFrame:
    """floor(most * share) rows of the first class and the rest of `most` of the other, as far as there are, by the seeded order."""
    first = int(most * share)
    ranked = rank_in_group(rows, [F.coalesce(is_first, F.lit(False))], seeded(F.col(id_column), seed), F.col(id_column), "__rank")
    return ranked.where(F.col("__rank") <= F.when(F.coalesce(is_first, F.lit(False)), first).otherwise(most - first)).drop("__rank")


def split_train_validation(rows: DataFrame, share: float, id_column: str, seed: int = 42) -> DataFrame:
    """`rows` with a column split: the first floor(n * share) of the seeded order are "val", the others "train"."""
    ranked = rank_in_group(rows, [F.lit(0)], seeded(F.col(id_column), seed), F.col(id_column), "__rank")
    total = rows.agg(F.count(F.lit(1)).alias("__total"))
    return ranked.join(F.broadcast(total)).withColumn("split", F.when(F.col("__rank") <= F.floor(F.col("__total") * share), F.lit("val")).otherwise("train")).drop("__rank", "__total")


def numbered(rows: DataFrame, prefix: str, id_column: str, digits: int = 5) -> DataFrame:
    """`rows` with a column id, prefix and a number (from 0, of `digits` places or as many as it needs) by the seeded order."""
    ranked = rank_in_group(rows, [F.lit(0)], seeded(F.col(id_column), 0), F.col(id_column), "__rank")
    return ranked.withColumn("id", F.concat(F.lit(prefix), F.format_string(f"%0{digits}d", F.col("__rank") - 1))).drop("__rank")


def best_first(rows: DataFrame, score: Column, most: int, id_column: str) -> DataFrame:
    """The `most` rows of greatest score, the smaller id first among equals."""
    return rows.withColumn("__score", score).orderBy(F.desc("__score"), id_column).limit(most).drop("__score")
