import math
import random

import pytest
from pyspark.sql import functions as F

from slipscope.operators import composite as c
from slipscope.operators import ranks, reports, stats

ISD = "task_id string, domain string, is_correct boolean, isd_score double"
LCS = "task_id string, lcs_score double"


def tables(spark, rows):
    return spark.createDataFrame([(i, d, ok, x) for i, d, ok, x, _ in rows], ISD), spark.createDataFrame([(r[0], r[4]) for r in rows], LCS)


def test_normalisation(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (3.0,)], "x double")
    assert [r.x for r in c.normalised(df, ["x"]).collect()] == [0.5] * 3
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "x double")
    assert sorted(r.x for r in c.normalised(df, ["x"], "percentile").collect()) == [0.25, 0.25, 1.0]
    assert math.isnan(c.normalised(df.limit(1), ["x"], "percentile").first().x)
    with pytest.raises(ValueError):
        c.normalised(df, ["x"], "other")


def test_index_ties_order_and_invariance(spark):
    r = random.Random(2)
    rows = [("t%03d" % i, r.choice("ab"), r.random() < 0.3, r.choice([0.1, 0.2, 0.9]), r.choice([0.5, 0.7])) for i in range(200)]
    isd, lcs = tables(spark, rows)
    out = c.index(isd, lcs).orderBy("pei_rank").collect()
    errors = [x for x in rows if not x[2]]
    lo, hi, lo2, hi2 = (f(x[k] for x in errors) for k in (3, 4) for f in (min, max))
    want = sorted((-(0.5 * (x[3] - lo) / (hi - lo) + 0.5 * (x[4] - lo2) / (hi2 - lo2)), x[0]) for x in errors)
    assert [x.task_id for x in out] == [w[1] for w in want]
    assert [x.pei_rank for x in out] == list(range(1, len(errors) + 1))
    again = c.index(isd.withColumn("isd_score", F.col("isd_score") * 3 + 1).repartition(5), lcs).orderBy("pei_rank").collect()
    assert [x.task_id for x in again] == [x.task_id for x in out]


def test_empty_index_and_summary(spark):
    isd, lcs = tables(spark, [("a", "d", True, 0.5, 0.5), ("b", "d", False, 0.5, 0.5)])
    assert c.index(isd.where("is_correct"), lcs).count() == 0
    one = c.index(isd, lcs)
    assert [(x.pei_score, x.pei_rank) for x in one.collect()] == [(0.5, 1)]
    overall, by_domain = reports.summary(one)
    assert overall.first().kruskal_h is None and by_domain.first().n == 1
    assert stats.overall_summary(one.limit(0)).first().n == 0


def test_length_filter(spark):
    isd, _ = tables(spark, [("a", "d", False, 0.5, 0.5), ("b", "d", False, 0.5, 0.5), ("c", "e", False, 0.5, 0.5)])
    said = spark.createDataFrame([("a", "w " * 20), ("b", "w " * 19)], "task_id string, response string")
    kept = c.long_enough(isd, said)
    assert [x.task_id for x in kept.collect()] == ["a"]
    assert {x.domain: x.n_excluded for x in c.excluded_by_domain(isd, kept).collect()} == {"d": 1, "e": 1}


def test_last_of_each_and_running_total(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z")], "k string, o int, v string")
    assert {r.k: r.v for r in ranks.last_of_each(df, "k", "o").collect()} == {"a": "y", "b": "z"}
    n = ranks.numbered(spark.range(1000).repartition(6), [F.col("id").desc()], "n").collect()
    assert all(r.n == 1000 - r.id for r in n)


def test_statistics(spark):
    assert stats.chi2_tail(48.67328171114818, 1) == pytest.approx(3.0235759e-12, rel=1e-6)
    assert stats.chi2_tail(3.0, 4) == pytest.approx(math.exp(-1.5) * 2.5)
    assert stats.chi2_tail(7.8147, 3) == pytest.approx(0.05, rel=1e-3)
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5)], "y int, s double")
    assert stats.auc(df, "y", "s").first().auc == pytest.approx(0.875)
    assert stats.auc(df.where("y = 1"), "y", "s").first().auc == 0.5
    one = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, v double")
    assert stats.kruskal(one, "g", "v").first().h is None
    bins = {r.bin: r.n for r in stats.histogram(spark.range(101).select(F.col("id").cast("double").alias("v")), "v", 10).collect()}
    assert bins == {**{i: 10 for i in range(9)}, 9: 11}


def test_showcase(spark):
    isd, lcs = tables(spark, [("t%d" % i, "d", False, i / 10, i / 10) for i in range(7)])
    judged = spark.createDataFrame([("t6", "p" * 201, "r" * 301, "g", "e")], "task_id string, prompt string, response string, ground_truth string, extracted_answer string")
    rows = {(r.bucket, r.pos): r for r in reports.showcase(c.index(isd, lcs), judged).collect()}
    assert rows["high", 1].task_id == "t6" and rows["high", 1].prompt == "p" * 200 + "..." and len(rows["high", 1].response) == 303
    assert [rows["low", k].task_id for k in range(1, 6)] == ["t4", "t3", "t2", "t1", "t0"] and rows["low", 1].prompt == ""
