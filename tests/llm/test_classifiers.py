import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slipscope.llm import fitting, quality, toxicity

DOCS, LABELS = "doc_id long, text string, label string", "doc_id long, quality int, toxic int"


def corpus(n=400):
    r = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(["the", "and", "hedan", "torin", "esha", "ingo"]) + r.choice("abcdef") for _ in range(r.randrange(20, 80))]
        bad, tox = r.random() < 0.3, r.random() < 0.3
        if tox:
            for _ in range(r.randrange(1, 5)):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scumly", "scumer"]))
        kind = i % 3
        if bad:
            w = [x.upper() + "!!" for x in w] if kind == 0 else [x + "###" for x in w] if kind == 1 else [w[0]] * len(w)
        docs.append((i, " ".join(w), "clash"))
        if i % 2:
            labels.append((i, 0 if bad else 1, int(tox and not (bad and kind == 2))))
    return docs, labels


def test_quality_on_texts_not_seen(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs + [(None, None, None), (7, "", None), (8, "x" * 50_000, None)], DOCS)
    out = quality.graded(df, spark.createDataFrame(labels + [labels[0], (None, 1, 1), (3, None, None)], LABELS)).collect()
    assert len(out) == 403
    junk = {i for i, t, _ in docs if "!!" in t or "###" in t or len(set(t.split())) == 1}
    wrong = [r.doc_id for r in out if r.doc_id is not None and r.doc_id not in (7, 8) and r.selected != (r.doc_id not in junk)]
    assert len(wrong) <= 4
    assert all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 1 for r in out)


def test_three_grades_have_ordered_thresholds():
    r = random.Random(1)
    grades = [i % 3 for i in range(300)]
    texts = [" ".join(["good" if r.random() < g / 2 * 0.8 + 0.1 else "poor" for _ in range(40)]).encode() for g in grades]
    model = quality.fit(texts, np.array(grades, float), np.ones(300))
    assert list(model.thresholds) == sorted(model.thresholds) and model.grades == [0, 1, 2]
    expected, tail = model.scores(texts, 1.0)
    means = [np.mean([e for e, g in zip(expected, grades) if g == k]) for k in range(3)]
    assert means[0] + 0.5 < means[1] < means[2] - 0.5
    below = model.upto(texts)
    assert np.allclose(tail, 1 - below[:, 0]) and (below[:, 0] <= below[:, 1]).all()
    assert np.allclose(expected, (below[:, 1] - below[:, 0]) + 2 * (1 - below[:, 1]))


def test_one_grade_and_no_labels(spark):
    df = spark.createDataFrame([(1, "a b", None)], DOCS)
    one = quality.graded(df, spark.createDataFrame([(1, 1, 0)], LABELS)).first()
    none = quality.graded(df, spark.createDataFrame([], LABELS)).first()
    assert (one.expected_grade, one.selected) == (1.0, True) and (none.expected_grade, none.selected) == (0.0, True)
    assert quality.graded(df.limit(0), spark.createDataFrame([(1, 1, 0)], LABELS)).count() == 0


def test_toxicity_on_texts_not_seen(spark):
    docs, labels = corpus(800)
    df = spark.createDataFrame(docs + [(None, None, None), (801, "", None), (802, "scumish idiots " + "the " * 9_000, None)], DOCS)
    out = toxicity.judged(df, spark.createDataFrame(labels, LABELS)).collect()
    assert len(out) == 803
    truth = {i for i, t, _ in docs if "idiot" in t.lower() or "scum" in t.lower()}
    flagged = {r.doc_id for r in out if r.toxic}
    assert len((flagged ^ truth) - {802}) <= 8 and 802 in flagged and None not in flagged
    assert all(0 <= p <= 1 for r in out for p in (r.p_toxic, r.p_toxic_low_grade))


def test_chain_feeds_earlier_categories_forward():
    r = random.Random(2)
    first = [r.random() < 0.5 for _ in range(400)]
    texts = [f"{'alpha' if f else 'omega'} {i}".encode() for i, f in enumerate(first)]
    y = np.array([[f, f if r.random() < 0.9 else not f] for f in first], int)
    chain = toxicity.fit(texts, np.arange(400), y, np.ones(400), ["one", "two"])
    assert chain.links[1].earlier.shape == (1,) and chain.links[1].earlier[0] > 0
    p = chain.probabilities([b"alpha", b"omega", b""])
    assert p[0, 0] > 0.9 > 0.1 > p[1, 0] and p[0, 1] > 0.7 > 0.3 > p[1, 1]
    constant = toxicity.fit(texts, np.arange(400), np.zeros((400, 1), int), np.ones(400), ["none"])
    assert constant.probabilities([b"alpha"])[0, 0] < 0.01


def test_gradients_lead_to_the_minimum():
    got = fitting.minimised(lambda x: (float(((x - 3) ** 2).sum()), 2 * (x - 3)), np.zeros(5))
    assert got == pytest.approx(np.full(5, 3.0), abs=1e-4)


def test_samples_are_bounded_and_weighted(spark):
    labels = spark.range(5000).select("id", F.when(F.col("id") % 10 == 0, 0).otherwise(1).alias("g"))
    rows = fitting.sampled(labels, "id", "g", 100).collect()
    assert len(rows) <= 400
    assert 3000 < sum(r.weight for r in rows) < 7000


def test_no_stratum_is_cut_and_many_are_bounded(spark):
    labels = spark.range(9000).select("id", (F.col("id") % 150).alias("g"), (F.col("id") / 7).alias("rating"))
    rows = fitting.sampled(labels, "id", "g", 20).collect()
    assert len({r.g for r in rows}) == 150 and len(rows) <= 2 * 20 * 64
    assert 7000 < sum(r.weight for r in rows) < 11_000
    fine = fitting.sampled(labels, "id", "rating", 20).collect()
    assert 1000 < len(fine) < 1600 and 7500 < sum(r.weight for r in fine) < 10_500


def test_a_grade_of_long_texts_only_is_learned_and_grades_that_are_no_numbers_are_not(spark):
    r = random.Random(4)
    word = {0.0: "poor", 1.0: "fair", 2.0: "fine"}
    docs, labels = [], []
    for i in range(150):
        g = float(i % 3)
        n = 4_000 if g == 2 else 40
        docs.append((i, " ".join(word[g] if r.random() < 0.7 else r.choice(list(word.values())) for _ in range(n)) + " é" * 9, None))
        labels.append((i, g))
    labels += [(0, float("nan")), (1, float("inf")), (5, None), (None, 1.0)]
    df = spark.createDataFrame(docs, DOCS)
    model = quality.learn(df, spark.createDataFrame([x for x in labels if x[0] != 0 or x[1] != x[1]], "doc_id long, quality double"))
    assert model.grades == [0.0, 1.0, 2.0]
    out = {x.doc_id: x.expected_grade for x in quality.score(df, model, from_grade=2.0).collect()}
    assert all(x == x for x in out.values())
    assert sum(abs(out[i] - i % 3) < 0.8 for i in range(150)) > 140


def test_a_category_of_long_texts_only_is_learned(spark):
    r = random.Random(5)
    docs = [(i, " ".join(["idiot" if i % 2 and r.random() < 0.1 else r.choice(["the", "and", "esha", "torin"]) + str(r.randrange(50)) for _ in range(3_500 if i % 2 else 60)]), None) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100)], LABELS)
    out = {x.doc_id: x.p_toxic for x in toxicity.judged(spark.createDataFrame(docs, DOCS), labels).collect()}
    assert all((out[i] >= 0.5) == bool(i % 2) for i in range(100, 120))


def test_rows_that_stay_stand_for_those_that_do_not():
    import pandas as pd

    frame = pd.DataFrame({"g": [0] * 200 + [1] * 10, "long": [False] * 150 + [True] * 50 + [False] * 3 + [True] * 7, "weight": [2.0] * 210})
    out = fitting.settled(frame, "g")
    assert len(out) == 160 and not out[out.g == 0].long.any()
    assert out.groupby("g").weight.sum().to_dict() == {0: 400.0, 1: 20.0}
    assert fitting.uncut("aé".encode()[:2]) == b"a" and fitting.uncut(b"") == b""
