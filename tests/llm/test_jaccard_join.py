import random

import pytest

from slipscope.llm import jaccard_join as j


def brute(rows):
    sets = []
    for i, t in rows:
        w = bytes((t or "").encode()).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    part = list(range(len(sets)))

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                part[root(a)] = root(b)
    out = []
    for a, (i, s) in enumerate(sets):
        ids = [sets[b][0] for b in range(len(sets)) if root(b) == root(a) and sets[b][0] is not None]
        out.append((i, len(s), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "w%d" % r.randrange(60)
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(r.choice([1, 3, 4, 5, 6, 8, 9, 10, 12, 13, 16, 20, 60, 120]))] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(r.randrange(1, 14)):
            w = list(b)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                at = r.randrange(len(w) + 1)
                w[at : at + 1] = r.choice([[], [word()], [word(), word()]])
            texts.append(" ".join(w).title() if r.random() < 0.1 else "  ".join(w))
        texts.append(" ".join(b[:20] + passage))
    texts += ["", None, " \n\t ", "one", "one", "ONE", "é É"]
    r.shuffle(texts)
    rows = [(k, t) for k, t in enumerate(texts)]
    return rows + [(None, rows[0][1]), (None, "alone and without an id at all"), rows[3], rows[3]]


@pytest.mark.parametrize("seed, small, short, heavy", [(1, None, 8, 16), (2, 14, 8, 3), (3, 9, 2, 2), (4, 0, 2, 4)])
def test_components_equal_brute_force(spark, monkeypatch, seed, small, short, heavy):
    monkeypatch.setattr(j, "SHORT", short)
    monkeypatch.setattr(j, "HEAVY", heavy)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.grouped(df, small=small).collect()), key=str)
    assert got == brute(rows)


def test_empty_table_and_boundary(spark):
    assert j.grouped(spark.createDataFrame([], "doc_id long, text string, k1 string")).count() == 0
    assert j.boundary({5: 10, 6: 10}, 1000.0) == 14
    assert j.boundary({9: 10}, 1.0) < 9
    assert [j.need(5), j.prefix(5), j.subset_sizes(5), j.subset_count(9)] == [4, 2, [4, 5], 9 + 1]


def test_every_link_between_different_sets(spark, monkeypatch):
    monkeypatch.setattr(j, "CELL", 4)
    rows = [r for r in corpus(5) if r[0] is not None]
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        sets[s] = min(i, sets.get(s, i))
    names = sorted((i, s) for s, i in sets.items() if s)
    want = sorted((a, b) for a, x in names for b, y in names if a < b and 100 * len(x & y) >= 80 * len(x | y))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.a, r.b) for r in j.linked(df).collect()) == want and len(want) > 20


def test_a_shared_passage_alone_makes_no_pairs(spark, monkeypatch):
    r = random.Random(4)
    words = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    common, others = words(40), [words(30) for _ in range(12)]
    made = []
    monkeypatch.setattr(j, "verified", lambda pairs, whole, real=j.verified: made.append(pairs.count()) or real(pairs, whole))
    rows = [(i, " ".join(common + others[i % 12] + words(2))) for i in range(240)]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in j.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)
    assert sum(made) <= 4 * len(rows)


def test_clashing_numbers_of_sets_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(j, "_clashes", lambda nodes, real=j._clashes: {(r.k1, r.k2): -1 - i for i, r in enumerate(nodes.orderBy("k1").limit(5).collect())} | real(nodes))
    rows = corpus(6)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows)


def test_copies_and_empty_texts_are_spread_over_buckets(spark, monkeypatch):
    tables = {}
    written = j.written
    monkeypatch.setattr(j, "written", lambda df, name="stage", **o: tables.setdefault(name, written(df, name, **o)))
    copy = "one text that comes again and again in this table of documents"
    rows = [(i if i % 2 else None, copy if i % 3 == 0 else "" if i % 3 == 1 else f"{i} some other words of a text number {i}") for i in range(4000)]
    classes, mean, sets = j.counted(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 32)
    sizes = {r.bucket: r["count"] for r in tables["counted"].where("kind = 1").groupBy("bucket").count().collect()}
    assert sum(sizes.values()) == 4000 == sets.count() and len(sizes) == 32
    assert max(sizes.values()) < 2 * 4000 / 32
