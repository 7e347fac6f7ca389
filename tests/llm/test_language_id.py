import math
import random
import zlib

import pytest

from slipscope.llm import language_id as l

WORDS = {"aa": ["toko", "makato", "tomako"], "bb": ["rishel", "shirel", "lesh"], "cc": ["ünor", "noür", "ürno"]}


def corpus(n=240):
    r = random.Random(4)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(3, 40))), lang, "s"))
    return out


def spec_bits(train, text, order):
    """Code length by dictionaries, byte by byte."""
    seen = {}
    for t in train:
        data = b"\0" * order + t
        for i in range(order, len(data)):
            for o in range(order + 1):
                at = seen.setdefault(data[i - o : i], {})
                at[data[i]] = at.get(data[i], 0) + 1
    bits, data = 0.0, b"\0" * order + text
    for i in range(order, len(data)):
        for o in range(order, -1, -1):
            at = seen.get(data[i - o : i])
            if not at:
                continue
            n, t = sum(at.values()), len(at)
            if data[i] in at:
                bits -= math.log2(at[data[i]] / (n + t))
                break
            bits -= math.log2(t / (n + t))
        else:
            bits += 8
    return bits


def test_code_lengths_equal_a_plain_specification():
    train = [t.encode() for _, t, lang, _ in corpus(60) if lang == "cc"]
    coder = l.Coder([l.Model("cc", train)], bits=6)  # a table so small that windows push each other out
    texts = ["ünor xyz", "", "noür noür \n", "q", "日本"] * 3
    for _ in range(2):
        got = coder.texts([t.encode() for t in texts])[:, 0]
        assert got == pytest.approx([spec_bits(train, t.encode(), l.ORDER) for t in texts], rel=1e-12)


def test_held_out_accuracy_and_undefined_texts(spark):
    rows = corpus() + [(1000, None, "aa", "s"), (1001, " 123 !", "bb", "s"), (1002, "", None, None), (None, "toko toko makato", "bb", None), (3, "toko tomako", "aa", "s"), (3, "toko tomako", "aa", "s")]
    out = l.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(out) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows[:240] if i != 3}
    assert all(r.lang_pred == truth[r.doc_id] for r in out if r.doc_id in truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    by_id = {r.doc_id: r for r in out}
    assert {by_id[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by_id[None].lang_pred == "aa" and not by_id[None].held_out
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in l.identified(df).collect()] == [("und", 0.0)]
    assert l.identified(df.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    r = random.Random(6)
    words = {f"l{i:02}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for i in range(70)}
    # Language 69 has long texts only, and so has 68 but for one.
    size = lambda i, j: 3_000 if i == 69 or i == 68 and j else 40
    rows = [(i * 10 + j, " ".join(r.choices(words[f"l{i:02}"], k=size(i, j))), f"l{i:02}") for i in range(70) for j in range(10)]
    out = l.identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(out) == 700 and {r.lang_pred for r in out} == set(words)
    assert all(r.lang_pred == f"l{r.doc_id // 10:02}" for r in out)


def test_many_languages_shrink_tables_and_portions(monkeypatch):
    models = [l.Model(k, [" ".join(v).encode()]) for k, v in WORDS.items()]
    texts = [b"toko makato", b"", "ünor lesh".encode(), b"rishel"]
    whole = l.Coder(models).texts(texts)
    monkeypatch.setattr(l, "CELLS", 24)
    assert l.Coder(models).texts(texts) == pytest.approx(whole)
