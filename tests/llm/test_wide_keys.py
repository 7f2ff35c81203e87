"""Much repeated ids, null ids, many sources and many languages."""

import hashlib

from pyspark.sql import functions as F

from siftstone.llm import language, mixing, suffix

PASSAGE = "A passage that an earlier document holds, of more than fifty bytes for sure. "


def test_one_id_with_more_texts_than_any_fixed_field(spark):
    n = 70_000
    text = F.concat(F.lit("text number "), F.col("id").cast("string"), F.when(F.col("id") % 100 == 0, F.lit(" " + PASSAGE)).otherwise(""))
    rows = spark.range(n).select(F.lit(7).cast("bigint").alias("doc_id"), text.alias("text")).unionByName(spark.createDataFrame([(1, PASSAGE), (9, "x" + PASSAGE)], "doc_id bigint, text string"))
    got = suffix.remove_repeats(rows).groupBy("doc_id", (F.col("n_bytes") > 60).alias("holds")).agg(F.count(F.lit(1)).alias("n"), F.min("n_removed").alias("least"), F.max("n_removed").alias("most")).collect()
    size = len(PASSAGE)
    assert {(r["doc_id"], r["holds"]): (r["n"], r["least"], r["most"]) for r in got} == {(1, True): (1, 0, 0), (9, True): (1, size, size), (7, True): (700, size, size), (7, False): (n - 700, 0, 0)}


def test_places_of_repeated_ids(spark):
    rows = [(i, f"text {k}") for i in (-5, 0, 3, 8) for k in range(3 * (i + 6) % 11 + 1)] + [(8, None), (8, None), (None, "a"), (None, None)]
    numbered, shift, _ = suffix.with_rows(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))
    got = {(r["doc_id"], r["text"]): r["row"] for r in numbered.collect()}
    assert shift == 16 and got[(None, "a")] is None and got[(None, None)] is None
    known = {k: v for k, v in got.items() if k[0] is not None}
    assert len(set(known.values())) == len(known)
    order = sorted({k[0] for k in known})
    assert all(v >> shift == order.index(i) for (i, _), v in known.items())


def test_null_ids_are_dealt(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"), F.concat(F.lit("words "), F.col("id").cast("string")).alias("text")).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffix.remove_repeats(rows).withColumn("part", F.spark_partition_id()).where("doc_id IS NULL").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 2000 and all(r["n_removed"] == 0 for r in got)
    sizes = {p: sum(r["part"] == p for r in got) for p in {r["part"] for r in got}}
    assert max(sizes.values()) < 1200  # a cluster of one group would have all of them
    assert {r["kept_sha256"] for r in got} == {hashlib.sha256(f"words {k}".encode()).hexdigest() for k in range(1, 4000, 2)}


def test_sources_are_joined_by_hash(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 400).cast("string")).alias("source"), F.lit("t").alias("text"))
    weights = {f"s{k}": 1.0 + (k == 3) * 500 for k in range(390)}
    made = mixing.mix_sources(rows, weights)
    plan = made._jdf.queryExecution().executedPlan().toString()
    big = [line for line in plan.splitlines() if "NestedLoop" in line and "LeftOuter" in line]
    assert not big
    got = made.collect()
    assert len({r["mix_order"] for r in got}) == 3000 and sorted(r["doc_id"] for r in got) == list(range(3000))
    late = [r["mix_order"] for r in got if int(r["source"][1:]) >= 390]
    assert min(late) > max(r["mix_order"] for r in got if int(r["source"][1:]) < 390)


def test_very_many_languages(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"), F.concat_ws(" ", *[F.concat(F.lit("wort"), F.col("id").cast("string"))] * 3).alias("text")).select(F.col("id").alias("doc_id"), "text", "lang")
    names, models, limits = language.train(rows, F.lit(True), 1500, 0.001)
    assert len(names) == len(models) == len(limits) == 3000
