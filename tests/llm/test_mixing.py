import hashlib
import math
import random
import re

import pytest

from slipscope.llm import mixing as m

DOCS = "doc_id long, text string, source string, size int, target string"
RAMPS = [(4.5, 1.5), (1.0, 1.0), (1.0, 3.0)]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shared(sizes, weights, budget):
    """Targets by sharing the excess again and again until none is above twice its size."""
    target, full, left = {}, set(), budget
    while True:
        rest = {s: weights[s] for s in sizes if s not in full}
        given = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = [s for s in rest if given[s] >= 2 * sizes[s]]
        if not over:
            return target | given
        for s in over:
            target[s] = 2.0 * sizes[s]
            full.add(s)
            left -= target[s]
        if len(full) == len(sizes):
            return target


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS).repartition(5)


def corpus(seed=4):
    r = random.Random(seed)
    rows = []
    for s, n in (("hot", 120), ("b", 3), ("a", 40), ("c", 60), ("", 9), (None, 30), ("é", 2), ("Z", 0)):
        rows += [(s, " ".join(["w"] * r.choice([0, 1, 3, 50, 400]))) for _ in range(n)]
    rows += [("only empty", ""), ("only empty", None), ("a", " \t "), ("a", "x y" * 3000), ("b", "word " * 20_000)]
    r.shuffle(rows)
    return [(i, t, s) for i, (s, t) in enumerate(rows)]


def test_targets_and_words_equal_brute_force(spark):
    rows = corpus()
    out = {x.doc_id: x for x in m.mix(frame(spark, rows)).collect()}
    sizes = {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = shared(sizes, weights, 1.5 * sum(sizes.values()))
    assert len(out) == len(rows)
    line = dict.fromkeys(sizes, 0)
    for i, t, s in sorted(rows, key=lambda x: hashlib.md5(str(x[0]).encode()).digest()):
        x, n, stop = out[i], size(t), math.floor(want[s] + 0.5)
        assert (x.source, x.size, x.source_size) == (s, n, sizes[s])
        assert x.target == pytest.approx(want[s], rel=1e-12)
        copies = [(line[s] + k * sizes[s], max(0, min(n, stop - line[s] - k * sizes[s]))) for k in (0, 1)]
        assert x.taken == sum(w for _, w in copies) <= 2 * n
        w0, w1 = RAMPS[order.index(s) % 3]
        got = [(c.position, c.words) for c in x.copies]
        assert [w for _, w in got] == [w for _, w in copies if w]
        for (position, _), (at, _) in zip(got, [c for c in copies if c[1]]):
            # The share of the schedule's integral up to the position is the share of the target taken before.
            assert (w0 * position + (w1 - w0) * position**2 / 2) / ((w0 + w1) / 2) == pytest.approx(at / want[s], abs=1e-9)
        line[s] += n
    for s in sizes:
        assert sum(x.taken for x in out.values() if x.source == s) == math.floor(want[s] + 0.5)


def test_reruns_agree_and_rows_are_sorted(spark):
    rows = corpus(5)
    one = [tuple(x) for x in m.digests(m.mix(frame(spark, rows))).collect()]
    two = [tuple(x) for x in m.digests(m.mix(frame(spark, rows[::-1]).repartition(2))).collect()]
    assert one == two
    at = [x[5] for x in one if x[5] is not None]
    assert at == sorted(at) and all(x[5] is None for x in one[len(at) :])
    steps = m.curriculum(m.mix(frame(spark, rows))).collect()
    assert [s.position for s in steps] == sorted(s.position for s in steps)
    assert sum(s.words for s in steps) == sum(x[4] for x in one)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(None, "a b", "s"), (None, "a b", "s"), (None, "c", None), (1, "d e f", "s"), (1, "d e f", "s"), (1, "g", "t"), (2, None, None), (3, "", "t")]
    out = m.mix(frame(spark, rows)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.size, x.source or "") for x in out) == sorted((i is None, i or 0, size(t), s or "") for i, t, s in rows)
    # Sizes 10, 1 and 1 in the order s, t, null with weights 3, 1 and 2: the last two fill up at 2 words each.
    assert {x.source: (x.source_size, x.target) for x in out} == {"s": (10, 14.0), "t": (1, 2.0), None: (1, 2.0)}
    assert sum(x.taken for x in out) == 18
    assert m.digests(m.mix(frame(spark, []))).count() == 0
    blank = m.mix(frame(spark, [(1, None, "s"), (2, " ", "t")])).collect()
    assert [(x.taken, x.target, x.copies) for x in blank] == [(0, 0.0, [])] * 2


def test_schedules_with_more_knots_and_none(spark):
    rows = [(i, " ".join(["w"] * 10), s) for s, ids in (("a", range(0, 100)), ("b", range(100, 200)), ("c", range(200, 210))) for i in ids]
    knots = {"a": [(0.0, 0.0), (0.5, 2.0), (0.5, 0.0), (1.0, 0.0)], "b": [(0.0, 0.0), (0.4, 0.0), (0.4, 1.0), (1.0, 1.0)], "c": [(0.0, 0.0), (1.0, 0.0)]}

    def schedule(sources):
        table = [(s, [{"at": t, "weight": w} for t, w in k]) for s, k in knots.items()]
        return sources.join(spark.createDataFrame(table, "source string, knots array<struct<at:double,weight:double>>"), "source")

    out = m.mix(frame(spark, rows), schedule, budget=0.5, most=1).collect()
    target = {x.source: (x.weight, x.target) for x in out}
    assert target["a"] == pytest.approx((0.5, 0.5 * 2100 * 0.5 / 1.1)) and target["b"] == pytest.approx((0.6, 0.5 * 2100 * 0.6 / 1.1)) and target["c"] == (0.0, 0.0)
    at = {s: sorted(c.position for x in out if x.source == s for c in x.copies) for s in knots}
    assert at["c"] == [] and at["a"][0] == 0 and at["a"][-1] < 0.5 and 0.4 == at["b"][0] and at["b"][-1] < 1
    # Half of a's words are due when its integral 2 t^2 reaches a quarter.
    assert sum(p < math.sqrt(0.125) for p in at["a"]) == pytest.approx(len(at["a"]) / 2, abs=1)


def test_no_python_and_no_lone_task(spark):
    plan = m.digests(m.mix(frame(spark, corpus())))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("SinglePartition") <= 1
