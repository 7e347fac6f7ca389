import itertools
import random
import re

from pyspark.sql import functions as F

from slipscope.llm import filter_audit as f

DOCS = "doc_id long, text string, source string, part string, mask int"
LABELS = "doc_id long, quality int, toxic int, good int"


def failing(rows):
    """The letters of the filters that each row fails."""
    out = []
    for i, text, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, *_ in rows),
        }
        out.append({k for k, v in bad.items() if v})
    return out


def brute(rows, labels):
    fails, out, shapley = failing(rows), {}, {}
    marked = lambda i, k: i is not None and any(x[0] == i and x[k] == 1 for x in labels)
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], bad) for r, bad in zip(rows, fails) if (r[2] or "") == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                all_failing = [x for x in mine if letter in x[1]]
                out[part, order, step] = (len(left), len(gone), len(all_failing) - len(gone), sum(x[1] == {letter} for x in mine), sum(marked(x[0], 1) for x in gone), sum(marked(x[0], 2) for x in gone))
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def got(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "other", 3) for r in rows], DOCS).repartition(3)
    out = f.audited(spark, docs, spark.createDataFrame([(*x, 0) for x in labels], LABELS)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in out}, len(out)


def corpus():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    make = lambda n, many: " ".join(r.choice(words[:many]) for _ in range(n))
    texts = [make(r.choice([5, 199, 200, 250]), r.choice([20, 90, 400])) + r.choice(["", "", " #", " ABCDEF", "\x0b\tÉÀ "]) for _ in range(60)]
    texts += ["", None, " \t\n", "x" * 100_000 + " A", texts[0], texts[0], texts[3], None, ""]
    rows = [(i, t, r.choice(["a", "b", "", None])) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (2, texts[0], "a"), (None, texts[0], "b"), (None, None, None), (-4, texts[3], "c")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 60, 2)] + [(2, 0, 1), (2, 1, 0), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def test_every_order_equals_brute_force(spark):
    rows, labels = corpus()
    table, n = got(spark, rows, labels)
    want = brute(rows, labels)
    assert n == len(want) == 4 * 600
    assert table == want


def test_plain_changes_visit_every_order_once():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for i in f.plain_changes(n):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n)))) == 1 + sum(1 for _ in f.plain_changes(n))


def test_a_swap_counts_two_steps_only(monkeypatch):
    import numpy as np

    calls = []
    step = f.Walk.step
    monkeypatch.setattr(f.Walk, "step", lambda self, i: calls.append(i) or step(self, i))
    counts = np.random.default_rng(1).integers(0, 9, (2, 3, 16))
    walk = f.Walk(counts, 4)
    sums = np.zeros((4, 3), int)
    for order, removed in walk.orders():
        assert all((removed[i] == step(walk, i)).all() for i in range(4))
        for i, x in enumerate(order):
            sums[x] += removed[i, 0]
    assert len(calls) == 4 + 2 * 23
    assert (walk.shapley == sums).all()


def test_empty_tables_and_other_filters(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], LABELS)
    assert f.audited(spark, none, labels).count() == 0
    table, n = got(spark, [(1, "one", "s")], [])
    assert n == 600 and table["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
    cells = spark.createDataFrame([("p", 1, 5), ("p", 3, 2), ("p", 0, 4)], "part string, mask int, docs long")
    out = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in f.audit(cells, "XY").collect()}
    assert out == {("XY", 1): (4, 7, 0, 12), ("XY", 2): (4, 0, 2, 2), ("YX", 1): (9, 2, 0, 2), ("YX", 2): (4, 5, 2, 12)}
    assert f.audit(cells.where(F.lit(False)), "XY").count() == 0
