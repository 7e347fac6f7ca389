import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipscope.operators import probes, solvers, stats


def activations(spark, layers, n=80, d=4, seed=1):
    r = random.Random(seed)
    labels = [(f"t{i}", float(i % 3 == 0)) for i in range(n)]
    rows = [(t, k, [float(np.float32(r.gauss(y * (k + 1) / 2, 1 + j))) for j in range(d)] + [3.0]) for t, y in labels for k in layers]
    return spark.createDataFrame(rows, "task_id string, layer_idx int, act array<float>").repartition(3), spark.createDataFrame(labels, "task_id string, label double")


def newton(x, y):
    """Reference fit: Newton's method on half the squared norm of the weights plus the losses."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    return w


def test_each_layer_has_the_weights_of_a_fit_of_its_own(spark):
    acts, labels = activations(spark, (0, 2, 5))
    rows = acts.join(labels, "task_id").withColumn("act", F.col("act").cast("array<double>"))
    fits = probes.fitted(rows, probes.scales(rows))
    assert set(fits) == {0, 2, 5}
    for layer, w in fits.items():
        mine = rows.where(F.col("layer_idx") == layer).collect()
        x, y = np.array([r.act for r in mine]), np.array([r.label for r in mine])
        sd = np.where(x.std(0) > 0, x.std(0), 1.0)
        assert w == pytest.approx(newton((x - x.mean(0)) / sd, y), abs=1e-9)


def jobs(spark, run):
    """Spark jobs that run() starts."""
    tracker, name = spark.sparkContext.statusTracker(), f"count-{random.random()}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
        return len(tracker.getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_passes_do_not_grow_with_the_layers(spark, monkeypatch):
    counts = {}
    for layers in ((0,), (0, 1, 2, 3, 4, 5)):
        steps = []
        together = solvers.together
        monkeypatch.setattr(probes, "together", lambda s, answer: together(s, lambda points: steps.append(len(points)) or answer(points)))
        acts, labels = activations(spark, layers)
        counts[len(layers)] = (jobs(spark, lambda: probes.train(acts, labels, calibrated=True)), len(steps))
        monkeypatch.undo()
    (one, steps_of_one), (six, steps_of_six) = counts[1], counts[6]
    # A layer may need some more steps than another; six of them need nothing like six times as many.
    assert steps_of_six < 2 * steps_of_one and six < 2 * one


def test_saved_probes_score_alike(spark, tmp_path):
    acts, labels = activations(spark, (0, 3))
    for calibrated in (False, True):
        fits = probes.train(acts, labels, calibrated=calibrated)
        probes.save(fits, str(tmp_path / "p"))
        back = probes.load(spark, str(tmp_path / "p"))
        assert back == fits and all((p.slope is None) != calibrated for p in back)
        told = {(r.task_id, r.layer_idx): r.p for r in probes.probabilities(acts, probes.table(spark, back)).collect()}
        assert len(told) == 160
        for r in acts.collect():
            p = next(p for p in fits if p.layer == r.layer_idx)
            m = sum((x - a) / s * w for x, a, s, w in zip(r.act, p.mean, p.scale, p.weights)) + p.intercept
            m = m if p.slope is None else p.slope * m + p.shift
            assert told[r.task_id, r.layer_idx] == pytest.approx(1 / (1 + math.exp(-m)), rel=1e-9)
    scores = probes.internal_scores(acts, labels.select("task_id", F.lit("d").alias("domain"), (F.col("label") == 1).alias("is_correct")), fits)
    assert all(r.isd_score == pytest.approx(sum(r.layer_scores.values()) / 2) and set(r.layer_scores) == {0, 3} for r in scores.collect())
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "EvalPython" not in plan and "InArrow" not in plan


def test_sigmoid_equals_newton_on_doubles(spark):
    r = random.Random(2)
    rows = [(g, r.gauss(0, 3), float(r.random() < 0.3 + 0.1 * g)) for g in range(4) for _ in range(100)]
    rows += [(7, 1.5, 1.0), (7, 1.5, 0.0), (7, 1.5, 0.0), (8, 800.0, 1.0), (8, -900.0, 0.0), (9, 2.0, 1.0)]
    got = probes.sigmoids(spark.createDataFrame(rows, "layer_idx int, margin double, label double"), "layer_idx")
    for g in range(4):
        m, y = np.array([x[1] for x in rows if x[0] == g]), np.array([x[2] for x in rows if x[0] == g])
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        z, w = np.stack([m, np.ones(len(m))], 1), np.zeros(2)
        for _ in range(60):
            p = 1 / (1 + np.exp(-z @ w))
            w = w - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]), z.T @ (p - t))
        assert got[g] == pytest.approx(tuple(w), rel=1e-9, abs=1e-9)
    # One margin: the mean of the targets; two far ones: both targets are met.
    p7 = 1 / (1 + math.exp(-(got[7][0] * 1.5 + got[7][1])))
    assert p7 == pytest.approx((2 / 3 + 2 * 1 / 4) / 3)
    assert 1 / (1 + math.exp(-(got[8][0] * 800 + got[8][1]))) == pytest.approx(2 / 3, abs=1e-6)
    assert all(map(math.isfinite, got[9]))


def test_areas_by_group_equal_pairs(spark):
    r = random.Random(3)
    rows = [(g, float(r.random() < 0.4), r.choice([r.random(), 0.5, 0.25])) for g in "abc" for _ in range(60)]
    rows += [("one class", 1.0, 0.3), ("one class", 1.0, 0.7), ("a", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, y double, s double").repartition(4)
    got = {x.g: x.auc for x in stats.auc(df, "y", "s", "g").collect()}

    def pairs(some):
        ones, others = [s for y, s in some if y == 1], [s for y, s in some if y != 1]
        met = sum((a > b) + (a == b) / 2 for a in ones for b in others)
        return met / (len(ones) * len(others)) if ones and others else 0.5

    for g in got:
        assert got[g] == pytest.approx(pairs([(y, s) for h, y, s in rows if h == g and s is not None]))
    assert stats.auc(df, "y", "s").first().auc == pytest.approx(pairs([(y, s) for _, y, s in rows if s is not None]))
    assert stats.auc(df.limit(0), "y", "s").first().auc == 0.5


def test_solvers_meet_known_points():
    def rosenbrock(x):
        return (1 - x[0]) ** 2 + 5 * (x[1] - x[0] ** 2) ** 2, np.array([-2 * (1 - x[0]) - 20 * x[0] * (x[1] - x[0] ** 2), 10 * (x[1] - x[0] ** 2)])

    def bowl(x):
        return float(((x - 3) ** 2).sum()), 2 * (x - 3)

    rounds = []
    out = solvers.together({"a": solvers.lbfgs(np.array([-1.0, 1.0])), "b": solvers.lbfgs(np.zeros(3))}, lambda p: rounds.append(set(p)) or {k: (rosenbrock if k == "a" else bowl)(x) for k, x in p.items()})
    assert out["a"] == pytest.approx([1, 1], abs=1e-6) and out["b"] == pytest.approx([3, 3, 3])
    assert rounds[0] == {"a", "b"} and rounds[-1] == {"a"}


def test_one_class_needs_no_search(spark, monkeypatch):
    acts, labels = activations(spark, (0, 1), n=30)
    monkeypatch.setattr(probes, "together", lambda solvers, answer: {} if not solvers else pytest.fail("searched"))
    for y, sign in ((0.0, -1), (1.0, 1)):
        fits = probes.train(acts, labels.withColumn("label", F.lit(y)))
        assert len(fits) == 2 and all(set(p.weights) == {0.0} and p.intercept == pytest.approx(sign * math.log(24.5 / 0.5)) and (p.accuracy, p.auc) == (1.0, 0.5) for p in fits)


def test_searches_end_where_nothing_can_be_told_apart():
    r = np.random.default_rng(1)
    for n, d, scale in ((40, 3, 1.0), (300, 80, 1e-3), (50, 200, 1.0)):
        x = r.normal(size=(n, d)) * scale
        y, asked = (x[:, 0] > 0).astype(float), []

        def loss(w):
            m = x @ w + r.normal() * 1e-15
            off = 1 / (1 + np.exp(-m)) - y
            return float(np.logaddexp(0, np.where(y == 1, -m, m)).mean() + w @ w / 2 / n), off @ x / n + w / n

        w = solvers.together({0: solvers.lbfgs(np.zeros(d))}, lambda q: asked.append(1) or {0: loss(q[0])})[0]
        assert np.abs(loss(w)[1]).max() < 1e-8 and len(asked) < 150
