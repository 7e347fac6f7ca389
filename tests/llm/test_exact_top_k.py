import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipscope.llm import exact_top_k as e


def brute(rows, every, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good) if a != b and len(v) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_equal_to_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(e, "BLOCK", 64)
    r = random.Random(5)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = []
    for i in range(300):
        length = r.choice([0.1, 1.0, 1.0, 5.0]) * scale
        rows.append((i, [float(np.float32(length * (x + r.gauss(0, 0.1)))) for x in r.choice(base)]))
    rows += [(300, None), (301, []), (302, [1.0, None] * 4), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, rows[0][1]), (305, [0.0] * 8), (310, [1.0, 2.0]), (320, [2.0, 1.0]), rows[10], rows[10], (20, rows[20][1])]
    df = spark.createDataFrame([(*x, "s") for x in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in e.top_k(df, F.col("vec_id") % 10 == 0).collect())
    assert got == brute(rows, 10, 5)


def test_pruning_saves_products():
    r = np.random.default_rng(1)
    vectors = np.floor(256 * r.normal(size=(4096, 8)) * r.choice([0.1, 1, 4], size=(4096, 1)))
    vectors = vectors[np.argsort(-(vectors**2).sum(1), kind="stable")]
    q = e.Queries(vectors[:4], np.arange(4), np.full(4, 7), np.arange(4))
    counts = {}
    e.search_block(q, [e.Best(5) for _ in range(4)], 7, np.arange(4096), vectors, counts=counts)
    assert counts["verified"] < 4 * 4096 / 3


def test_empty_table_and_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert e.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    assert e.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_products_beyond_doubles_and_64_bits(spark):
    # Scores of 2**53 + 3 twice, and one of 2**53 + 2 that a double can't tell from them.
    rows = [(50, [1.0, 1.0]), (5, [2.0**45, 3 / 256]), (3, [2.0**45, 3 / 256]), (4, [2.0**45, 2 / 256]), (7, [-(2.0**45), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (1, 2, 4):
        got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in e.top_k(df, F.col("vec_id") == 50, k).collect())
        want = [(i, r, j, s) for i, r, j, s in brute([(i, v) for i, v in rows], 50, k)]
        assert got == want
    huge = [(50, [1e20, 2.0]), (1, [1e20, 1.0]), (2, [1e200, 1.0]), (3, [-1e300, 5.0]), (6, [1e20, 1.0]), (100, [1e308, 1e308]), (9, [1.0, 1.0])]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in e.top_k(df, F.col("vec_id") % 50 == 0, 6).collect())
    exact = lambda v: [int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in v]
    want = []
    for i, q in huge:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(exact(q), exact(v))), j) for j, v in huge if j != i)
            want += [(i, n + 1, j, max(-(2**63), min(2**63 - 1, -s))) for n, (s, j) in enumerate(scores)]
    assert got == sorted(want)


def test_groups_and_spans_of_any_size_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 16)
    r = random.Random(8)
    rows = [(i, [float(np.float32(r.gauss(0, 1) * r.choice([0.2, 1, 3]))) for _ in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in e.search(e.pack(df, query=F.col("vec_id") % 5 == 0), 3, group=7).collect())
    assert got == brute(rows, 5, 3)


def test_strength_keeps_the_order():
    numbers = sorted([0, 1, -1, 255, 256, -255, -256, 2**63, -(2**63), 10**400, -(10**400), 3, -3])
    assert sorted(numbers, key=e.strength) == numbers


def test_groups_are_sent_only_where_vectors_are_long_enough(spark, monkeypatch):
    monkeypatch.setattr(e, "BLOCK", 16)
    r = random.Random(9)
    rows = [(i, [float(np.float32(r.gauss(0, 1) * r.paretovariate(0.8))) for _ in range(6)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    made = []
    sent = e.sent
    monkeypatch.setattr(e, "sent", lambda groups, bounds, ends: made.append((groups.count(), len(ends), ends[-1], sent(groups, bounds, ends).count())) or sent(groups, bounds, ends))
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in e.search(e.pack(df, query=F.col("vec_id") % 5 == 0), 3, group=7).collect())
    assert got == brute(rows, 5, 3)
    ((groups, tiers, spans, copies),) = made
    assert groups >= 18 and tiers > 5 and spans > 5
    # With lengths as uneven as these, few groups need to look beyond the longest vectors.
    assert copies < 0.4 * groups * spans


def test_blocks_of_one_length_fill_as_many_spans(spark):
    blocks = spark.range(1000).select(F.lit(3).alias("dim"), F.col("id").alias("block"), F.when(F.col("id") < 50, F.lit(9.0) + F.col("id")).when(F.col("id") < 900, 7.0).otherwise(F.col("id") / 1000).alias("top"))
    bounds, ends = e.tiers(blocks, 4)
    assert 240 <= ends[-1] <= 600 and bounds == sorted(bounds, reverse=True)
    sizes = [r["count"] for r in e.dealt(blocks, bounds, ends).groupBy("span").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 16 and len(sizes) > 150
    # Whatever a group needs, it meets every block that is long enough.
    needs = [float("-inf"), -1.0, 0.0, 0.95, 6.9, 7.0, 7.1, 20.0, 1e9]
    groups = spark.createDataFrame([(i, x) for i, x in enumerate(needs)], "number int, need double")
    met = e.sent(groups, bounds, ends).join(e.dealt(blocks, bounds, ends), "span").where("top >= need").groupBy("number").count()
    tops = [r.top for r in blocks.collect()]
    assert {r.number: r["count"] for r in met.collect()} == {i: n for i, n in enumerate(sum(t >= x for t in tops) for x in needs) if n}
