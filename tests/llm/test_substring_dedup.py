import hashlib
import random

import pytest

from slipscope.llm import substring_dedup as s


def brute(rows):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    key = lambda i, k: (i is None, i or 0, k)
    first = {}
    for i, w in words:
        for k in range(len(w) - 19):
            win = tuple(w[k : k + 20])
            first[win] = min(first.get(win, key(i, k)), key(i, k))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if first[tuple(w[k : k + 20])] < key(i, k):
                gone[k : k + 20] = [True] * 20
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_digests_equal_brute_force_over_many_runs(spark, monkeypatch):
    r = random.Random(7)
    word = lambda: r.choice(["a", "b", "cé", "日本", "d" * 30, "%d" % r.randrange(50)])
    passages = [[word() for _ in range(n)] for n in (19, 20, 21, 50, 200)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(r.randrange(0, 6)):
            w += r.choice(passages)[r.randrange(0, 5) :] if r.random() < 0.5 else [word() for _ in range(r.randrange(0, 40))]
        rows.append((r.randrange(1000), r.choice([" ", "  ", "\n", "\t"]).join(w)))
    rows += [(None, " ".join(passages[4])), (None, " ".join(passages[4])), (5, None), (6, ""), (7, "x " * 90), (8, "y " * 25), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(s, "RUN_BYTES", 2_000)
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in s.digests(df).collect()), key=str)
    assert got == brute(rows)


def test_empty_table(spark):
    assert s.digests(spark.createDataFrame([], "doc_id long, text string, run int")).count() == 0


def sequence(batches):
    """Brute force in which all of a batch is earlier than the next one."""
    first, out = {}, []
    for number, rows in enumerate(batches):
        words = [(i, (t or "").encode().split()) for i, t in rows]
        key = lambda i, k: (number, i is None, i or 0, k)  # noqa: E731, B023
        for i, w in words:
            for k in range(len(w) - 19):
                win = tuple(w[k : k + 20])
                first[win] = min(first.get(win, key(i, k)), key(i, k))
        for i, w in words:
            gone = [False] * len(w)
            for k in range(len(w) - 19):
                if first[tuple(w[k : k + 20])] < key(i, k):
                    gone[k : k + 20] = [True] * 20
            out.append((i, len(w), sum(gone), " ".join(x.decode() for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("n, seed", [(2, 1), (4, 2)])
def test_batches_in_any_order_meet_what_came_before(spark, monkeypatch, tmp_path, n, seed):
    monkeypatch.setattr(s, "RUN_BYTES", 2_000)
    monkeypatch.setattr(s, "BUCKET_BYTES", 4_000)
    r = random.Random(seed)
    word = lambda: "%d" % r.randrange(60)
    passages = [[word() for _ in range(k)] for k in (20, 21, 50, 120)]
    rows = [(r.randrange(-500, 500), " ".join(w for _ in range(r.randrange(4)) for w in (r.choice(passages)[r.randrange(5) :] if r.random() < 0.5 else [word() for _ in range(r.randrange(50))]))) for _ in range(120)]
    rows += [(2**63 - 1, " ".join(passages[3])), (-(2**63), " ".join(passages[2])), (None, " ".join(passages[3])), (None, None), (3, "")]
    batches = [[x for x in rows if r.random() < 1 / n or x[0] == 3] if i + 1 < n else rows[: 60] for i in range(n)]
    index, got = s.Index.create(spark, f"file://{tmp_path}/index"), []
    for i, batch in enumerate(batches):
        if i == 2:
            index = index.compact()
        kept, _ = s.Index.open(spark, index.path).merge(spark.createDataFrame(batch, "doc_id long, text string").repartition(2))
        index = s.Index.open(spark, index.path)
        got += [(x.doc_id, x.n_words, x.n_removed, x.kept) for x in kept.collect()]
    assert index.meta["batches"] == n
    assert sorted(got, key=str) == sequence(batches)


def test_an_empty_batch_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    kept, index = s.Index.create(spark, f"file://{tmp_path}/index").merge(df.limit(0))
    assert kept.count() == 0
    assert [r.n_removed for r in index.merge(df)[0].collect()] == [38]


def test_the_query_compacts_its_index(spark, monkeypatch):
    calls = []
    compact = s.Index.compact
    monkeypatch.setattr(s.Index, "compact", lambda self: calls.append(len(self.meta["anchors"])) or compact(self))
    rows = [(i, f"{'again ' * (i % 7)}" + " ".join(f"w{(i * 13 + k) % 90}" for k in range(60))) for i in range(80)]
    got = sorted(((x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in s.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows) and calls == [2]
