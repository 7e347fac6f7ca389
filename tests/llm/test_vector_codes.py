import hashlib
import math
import random

import numpy as np
import pytest

from slipscope.llm import vector_codes as v

ROWS = "vec_id long, embedding array<double>, label int, code string, v int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Codes by plain loops over whole numbers of Python."""
    kept = [(i, [math.floor(1024 * x) for x in e], lab) for i, e, lab in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    m = len(kept[0][1]) // parts
    cut = [[tuple(e[p * m : (p + 1) * m]) for p in range(parts)] for _, e, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = {}
            for c in cut:
                mine.setdefault(nearest(book, c[p])[1], []).append(c[p])
            books[p] = [tuple(sum(col) // len(col) for col in zip(*mine[i])) if i in mine else e for i, e in enumerate(book)]
    found = [[nearest(books[p], c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] = by_label.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted((str(i), "".join(f"{k:02x}" for _, k in f), e, by_label[lab], sha) for (i, _, lab), f, e in zip(kept, found, errors))


def got(spark, rows):
    out = v.compressed(spark.createDataFrame([(*r, "x", 7) for r in rows], ROWS).repartition(3)).collect()
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in out)


def vectors(n, d, seed, grid=None):
    r = random.Random(seed)
    one = lambda: r.choice(grid) if grid else r.gauss(0, 0.3)
    return [(i, [one() for _ in range(d)], r.choice([0, 0, 0, 1, None])) for i in range(n)]


def test_codes_equal_brute_force(spark):
    rows = vectors(400, 8, 1)
    rows += [(1000, None, 1), (1001, [1.0, None] * 4, 1), (1002, [float("nan")] * 8, 0), (1003, [float("-inf")] + [0.0] * 7, 0), (1004, [], 0), rows[3], rows[3], (None, rows[5][1], 1)]
    assert got(spark, rows) == brute(rows)


def test_ties_and_few_rows(spark):
    # On a small grid of repeated vectors most distances tie and most entries are alike.
    rows = vectors(300, 8, 2, grid=[0.0, 0.001, -0.001, 0.002])
    assert got(spark, rows) == brute(rows)
    few = vectors(5, 4, 3)
    assert got(spark, few) == brute(few)


def test_walks_equal_all_distances():
    r = np.random.default_rng(4)
    for spread, d in ((50, 3), (3, 4), (2**26, 5), (1, 2), (10, 0)):
        entries = r.integers(-spread, spread + 1, (256, d))
        parts = r.integers(-spread, spread + 1, (3000, d))
        tree = v.Balls(entries)
        index, best = tree.nearest(parts)
        all_ = ((parts[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(-1) if d else np.zeros((3000, 256), object)
        assert (best == all_.min(1)).all() and (index == all_.argmin(1)).all()
    # Entries in groups far apart: most balls are passed by.
    centres = r.integers(-(10**6), 10**6, (16, 8))
    entries = np.repeat(centres, 16, 0) + r.integers(-50, 50, (256, 8))
    tree = v.Balls(entries)
    tree.nearest(np.repeat(centres, 100, 0))
    assert tree.seen < 0.2 * 1600 * 256


def test_radii_hold_their_entries():
    entries = np.random.default_rng(5).integers(-1000, 1000, (256, 16))
    todo = [v.Balls(entries).root]
    while todo:
        ball = todo.pop()
        assert (((entries[ball.members] - ball.centre) ** 2).sum(1) <= ball.radius**2).all()
        todo += ball.halves


def test_other_dimensions_large_components_and_empty_tables(spark):
    rows = vectors(20, 8, 6)
    assert got(spark, [*rows, (-5, [1.0] * 4, 0), (-6, [0.5] * 12, None)]) == brute(rows)
    huge = [(0, [1e300, -1e300, 0.0, 1.0], 0), (1, [-1e300, 1e300, 1.0, 0.0], 0), (2, [1.0, 1.0, 1.0, 1.0], None)]
    assert [r[2] for r in got(spark, huge)] == [0, 0, 0]
    far = [(i, [float(x)] * 4, 0) for i, x in enumerate([100_000, -100_000, 99_999, 0] * 80)]
    assert got(spark, far) == brute(far)
    assert got(spark, []) == [] and got(spark, [(1, None, 0)]) == []
    odd = [(i, [0.1 * i, 0.2, 0.3 * i, 0.4, 0.5], 0) for i in range(9)]
    assert len(got(spark, odd)) == 9 and all(len(r[1]) == 8 for r in got(spark, odd))


def test_restored_vectors_have_the_error_told(spark):
    rows = vectors(300, 8, 7)
    ready = v.prepared(spark.createDataFrame([(*r, "x", 7) for r in rows], ROWS))
    books = v.learned(ready, entries=16)
    out = v.restored(v.coded(ready, books), books).collect()
    whole = {i: [math.floor(1024 * x) for x in e] for i, e, _ in rows}
    assert len(out) == 300
    for r in out:
        assert sum((a - b) ** 2 for a, b in zip(r.restored, whole[r.vec_id])) == r.error
    assert sum(r.error for r in out) == pytest.approx(sum(r.error for r in v.coded(ready, books).collect()))
