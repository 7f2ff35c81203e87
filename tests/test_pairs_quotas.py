"""All pairs of models, quotas within the plan, repeated ids."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siftstone.operators import corpus as C
from siftstone.operators import evaluation as E
from siftstone.operators import ranking as K


def test_erfc(spark):
    xs = [k / 200 for k in range(0, 1400)] + [0.46875, 0.4687500001, 4.0, 4.0000001, 10.0, 26.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", E.erfc(F.col("x")).alias("y")).collect()
    assert all(math.isclose(r["y"], math.erfc(r["x"]), rel_tol=1e-9, abs_tol=1e-300) for r in got)


def test_all_pairs_by_force(spark):
    r, models = random.Random(3), ["a", "b", "c", "d"]
    rows = [(i, m, r.random() < p) for i in range(300) for m, p in zip(models, (0.9, 0.7, 0.9, 0.5)) if r.random() < 0.9] + [(None, "a", True), (1, "other", True), (400, "a", None), (400, "b", True)]
    got = {(x["a"], x["b"]): x for x in E.all_pairs(spark.createDataFrame(rows, "id long, model string, correct boolean"), models).collect()}
    right = {}
    for i, m, ok in rows:
        if i is not None:
            right[i, m] = bool(ok)
    assert len(got) == 6
    for (a, b), x in got.items():
        both = [i for i in {i for i, _ in right} if (i, a) in right and (i, b) in right]
        n10, n01 = sum(right[i, a] and not right[i, b] for i in both), sum(right[i, b] and not right[i, a] for i in both)
        chi = (abs(n10 - n01) - 1) ** 2 / (n10 + n01)
        p = math.erfc(math.sqrt(chi / 2))
        assert (x["common"], x["n10"], x["n01"]) == (len(both), n10, n01) and math.isclose(x["chi_square"], chi) and math.isclose(x["p"], p, rel_tol=1e-9)
        assert x["stars"] == ("***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else "")


def test_pairs_without_a_difference(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "a", False)], "id long, model string, correct boolean")
    assert [tuple(r) for r in E.all_pairs(rows, ["a", "b", "c"]).collect()] == [("a", "b", 1, 0, 0, None, None, "")]
    assert E.all_pairs(rows, ["a"]).collect() == []


def test_a_quota_fails_when_rows_are_made(spark):
    rows = spark.range(100).select("id", F.concat(F.lit("g"), (F.col("id") % 4).cast("string")).alias("g"))
    assert K.stratified_quota(rows, "g", {"g0": 20, "g3": 0}, "id", strict="in plan").count() == 20
    for quotas in ({"g0": 20, "g1": 26}, {"none": 1}):
        lazy = K.stratified_quota(rows, "g", quotas, "id", strict="in plan")  # nothing runs yet
        with pytest.raises(Exception, match="too few rows for the quota: (g1: 25 of 26|none: 0 of 1)"):
            lazy.count()
        assert K.stratified_quota(rows, "g", quotas, "id", strict=False).count() == {"g0": 45}.get(next(iter(quotas)), 0)


def test_repeated_ids(spark):
    rows = spark.createDataFrame([(1, "same b"), (1, "same a"), (2, "same c"), (None, "same d"), (3, None), (3, None)], "id long, text string")
    got = sorted(((r["id"], r["text"]) for r in C.prefix_dedup(rows, 4, "id").collect()), key=str)
    assert len(got) == 2 and (3, None) in got and got != [(1, "same b"), (1, "same a")]
    truth = spark.createDataFrame([(1, "pii"), (2, "safe")], "id long, category string")
    said = spark.createDataFrame([(1, "pii", "timeout"), (1, "safe", None), (1, "pii", None), (2, "pii", "timeout")], "id long, predicted string, error string")
    scored = {r["id"]: (r["predicted"], r["correct"], r["failed"]) for r in E.scored(truth, said).collect()}
    assert scored[2] == ("pii", False, True) and scored[1][2] is False and len(scored) == 2 and E.scored(truth, said).count() == 2
