import random
import re

from slipscope.llm import decontaminate as d

ITEM = "A train leaves the station at 40 km per hour and passes Alice after 3 hours while Bob walks 40 km to the next town. How far apart are they then?"


def found(spark, docs, items=((1, ITEM),)):
    out = d.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(list(items), "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.changed for r in out.collect()}


def test_copies_and_new_parameters_are_caught_and_others_are_not(spark):
    r = random.Random(3)
    prose = " ".join(r.choice(["alda", "bero", "cuno", "dari", "Elfo."]) for _ in range(400))
    other = ITEM.replace("40", "65").replace("Alice", "Carla").replace("Bob", "David").replace("3 hours", "7 hours").replace(" km", " miles")
    mixed = ITEM.replace("at 40 km", "at 65 km")  # one value, two counterparts; 17 of 24 windows as they were
    torn = " ".join(w.replace("40", str(60 + i)) for i, w in enumerate(ITEM.split()[:-7])).replace("Alice", "Carla").replace("3 hours", "9 days")  # few unchanged
    docs = [
        (1, prose + " " + ITEM + " " + prose, "x"), (2, other, "x"), (3, mixed, "x"), (4, prose, "x"), (5, None, None), (6, "", "x"), (None, ITEM, "x"),
        (7, ITEM.upper(), "x"), (8, "\n".join(w + "###" for w in ITEM.split()), "x"), (9, ITEM + " " + ITEM, "x"), (9, ITEM, "x"), (10, ITEM[: len(ITEM) // 8], "x"), (11, "THE 1 2 3 4 5 6 7 8 9 " * 50, "x"), (12, torn, "x"),
    ]
    got = found(spark, docs)
    assert {k for k in got if k[0] in (1, 2, 3, 9)} == {(1, 1), (2, 1), (3, 1), (9, 1)}
    assert got[1, 1] is False and got[2, 1] is True and got[3, 1] is True and got[9, 1] is False
    assert not {4, 5, 6, 10, 11, 12, None} & {k[0] for k in got}
    assert (8, 1) in got


def test_short_items_and_empty_tables(spark):
    assert found(spark, [(1, "we saw two small WORDS here", "x"), (2, "two words", "x")], [(5, "two small words"), (6, None), (7, "")]) == {(1, 5): False}
    assert found(spark, [(1, ITEM, "x")], []) == {}
    assert found(spark, [], [(1, ITEM)]) == {}


def test_placeholders():
    w, h, kinds = d.canonical([b"At 3.5 km, Anna met Otto. Then 1,000 USD left 'NASA' and \xc3\x89va"])
    assert kinds.tolist() == [0, d.NUMBER, d.UNIT, d.NAME, 0, d.NAME, 0, d.NUMBER, d.UNIT, 0, 0, 0, d.NAME]


def test_inserted_and_deleted_words_do_not_split_a_passage(spark):
    r = random.Random(5)
    words = lambda n, mark: [mark + "".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    items = {i: words(n, "x") for i, n in ((1, 20), (2, 24), (3, 38), (4, 59))}
    put = lambda w, *at: " ".join(x for i, v in enumerate(w) for x in (["anew", v] if i in at else [v]))
    out = lambda w, *at: " ".join(v for i, v in enumerate(w) if i not in at)
    prose = " ".join(words(60, "y"))
    texts = {1: put(items[1], 10), 2: put(items[2], 12), 3: put(items[3], 13, 25), 4: put(items[4], 20, 40), 5: out(items[3], 13, 25), 6: out(items[2], 12)}
    texts[7] = prose.join(" ".join(items[4][i : i + 12]) for i in range(0, 59, 12))  # pieces too far apart
    docs = [(i, f"{prose} {t} {prose}", "x") for i, t in texts.items()]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in d.leaks(spark.createDataFrame(docs, "doc_id long, text string, item_id string"), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 3), (6, 2)}
    assert abs(got[2, 2].coverage - 10 / 17) < 1e-9 and not any(r.changed for r in got.values())
    longer = ITEM.replace("Alice", "Mary Ann").replace("Bob", "Carl Otto").replace("3 hours", "7 hours")
    assert found(spark, [(1, longer, "x")]) == {(1, 1): True}


def test_the_longest_chain_of_matches():
    assert d.in_order([(5, 2, []), (4, 1, []), (6, 9, []), (7, 3, []), (7, 2, [])]) == [(4, 1, []), (5, 2, []), (7, 3, [])]
    same, other = [(1, 1)], [(1, 2)]
    assert d.passage([(0, 0, same), (2, 1, same), (0, 6, other)], 2) == (2, False)
    assert d.passage([(0, 0, same), (2, 1, other)], 2) is None
    assert d.passage([(0, 0, same), (1, 1, []), (2, 2, other)], 2) == (2, True)
    assert d.passage([(0, 0, same), (1, 1, []), (2, 2, other)], 3) is None


def test_copies_in_small_letters_and_capitals(spark):
    dense = "We told Anna that Otto met Clara near Paris while Hugo saw Berta with Emil at Rome before Ida left Bonn for Wien and Karl."
    copies = [(1, dense, "x"), (2, dense.lower(), "x"), (3, dense.upper(), "x"), (4, dense.replace("Anna", "Olga"), "x"), (5, ITEM.upper(), "x"), (6, ITEM.lower().replace("3 hours", "7 hours"), "x")]
    got = found(spark, copies, [(1, dense), (2, dense.lower()), (3, ITEM)])
    assert set(got) == {(i, j) for i in (1, 2, 3, 4) for j in (1, 2)} | {(5, 3), (6, 3)}
    assert not any(got[i, 1] for i in (1, 2, 3)) and got[4, 1] and not got[5, 3] and got[6, 3]


UNITS, OPENERS = set(d.UNITS), set(d.OPENERS)


def plain_kinds(text):
    """(token in small letters, kind) of a text of ASCII letters, one token after the other."""
    out, before = [], None
    for m in re.finditer(r"[A-Za-z0-9]+(?:(?<=[0-9])[.,](?=[0-9])[A-Za-z0-9]+)*", text):
        t = m[0]
        low = t.lower()
        kind = d.NUMBER if t[0].isdigit() else d.UNIT if before == d.NUMBER and low in UNITS else d.NAME if t[0].isupper() and any(c.islower() for c in t) and low not in OPENERS else 0
        out.append((low, kind))
        before = d.NUMBER if t[0].isdigit() else kind
    return out


def plain_windows(tokens, k):
    """For each place the ways in which a window can be met: as a template, and with its names as they are; with slots."""
    for at in range(len(tokens) - k + 1):
        some = tokens[at : at + k]
        for kinds in ({d.NUMBER, d.UNIT}, {d.NUMBER, d.UNIT, d.NAME}):
            literal = sum(kind not in kinds for _, kind in some)
            shape = tuple(f"<{kind}>" if kind in kinds else t for t, kind in some) if literal >= min(d.LEAST_LITERALS, k) else ("as is", *(t for t, _ in some))
            yield at, shape, tuple(t for t, kind in some if kind in kinds)


def plain_leaks(docs, items):
    """Windows, slots and passages of all documents and items by loops; passages by the operator's own rule."""
    out = {}
    for i, item in items.items():
        its = plain_kinds(item)
        k = min(d.WINDOW, len(its))
        known = {}
        for at, shape, slots in plain_windows(its, k):
            known.setdefault(shape, set()).add((at, slots))
        n = len(its) - k + 1
        for j, text in docs.items():
            matches = {(at, place, tuple(zip(mine, slots))) for at, shape, slots in plain_windows(plain_kinds(text), k) for place, mine in known.get(shape, ())}
            rows = sorted(matches, key=lambda m: m[0] - m[1])
            chains, last = [], None
            for m in rows:
                if last is None or m[0] - m[1] - last > d.SHIFT:
                    chains.append([])
                chains[-1].append(m)
                last = m[0] - m[1]
            found = [f for f in (d.passage([(a, p, list(s)) for a, p, s in c], d.COVERAGE * n) for c in chains) if f]
            if found:
                best = min(found, key=lambda f: (-f[0], f[1]))
                out[j, i] = (round(best[0] / n, 9), best[1])
    return out


def test_leaks_equal_those_of_plain_loops(spark):
    r = random.Random(11)
    word = lambda: r.choice([f"w{chr(97 + r.randrange(9))}", "the", "Anna", "Otto", "40", "3.5", "km", "hours", "7", "train", "goes", "fast"])
    items = {i: " ".join(word() for _ in range(r.choice([4, 10, 25, 40]))) for i in range(12)}
    items[12] = items[3] + " " + items[3]  # repeats its own windows
    docs = {}
    for j in range(80):
        tokens = [word() for _ in range(r.randrange(5, 30))]
        for _ in range(r.randrange(3)):
            copy = items[r.randrange(13)].split()
            change = r.choice([{}, {"40": "55"}, {"Anna": "Berta", "7": "8"}, {"3.5": "40"}])
            copy = [change.get(w, w) for w in copy if r.random() > 0.03]
            at = r.randrange(len(tokens))
            tokens[at:at] = copy * r.choice([1, 1, 2])
        docs[j] = " ".join(tokens)
    out = d.leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    got, want = {(x.doc_id, x.item_id): (round(x.coverage, 9), x.changed) for x in out}, plain_leaks(docs, items)
    assert set(got) == set(want) and len(want) > 40
    # A diagonal that is consistent by itself may tell more of an item than a chain that holds it.
    assert all(got[k][0] >= want[k][0] for k in want) and sum(got[k] == want[k] for k in want) >= 0.9 * len(want)


def test_the_filter_grows_with_the_benchmark(spark):
    r = random.Random(13)
    bench = [(i, " ".join(f"b{r.randrange(10**6)}" for _ in range(30))) for i in range(3000)]
    docs = [(i, " ".join(f"d{r.randrange(10**6)}" for _ in range(300)), "x") for i in range(20)] + [(99, bench[5][1], "x")]
    assert found(spark, docs, bench) == {(99, 5): False}
