import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slipscope.functions import lexicon as x
from slipscope.functions.markers import Matcher, count_sets
from slipscope.functions.text import WHITE
from slipscope.operators import surface as s

SETS = {"boosters": x.BOOSTERS, "hedges": x.HEDGES, "direct": x.DIRECT_EVIDENCE, "indirect": x.INDIRECT_EVIDENCE, "concessives": x.CONCESSIVES}


def plain(low, markers):
    """Each marker on its own: single words among the words, phrases by str.count."""
    words = [w for w in re.split(r"\W+", low) if w]
    return sum(low.count(m) if " " in m else words.count(m) for m in markers)


PIECES = [*(m for ms in SETS.values() for m in ms), "it might be", "unlikely", "might_be", "émight", "never-never", ". ", "\n", " ", "_", "9", "é", "The", "aaa", "İt is", "it is possible it is possible"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=3)), max_size=25), st.booleans())
def test_counts_equal_those_of_each_marker(pieces, spaced):
    low = (" " if spaced else "").join(pieces).lower()
    assert Matcher(SETS.values()).counts(low) == [plain(low, ms) for ms in SETS.values()]


def test_phrases_do_not_overlap_themselves_and_markers_may_be_shared():
    assert Matcher([["a a"], ["a", "a a"]]).counts("a a a a") == [2, 6]
    assert Matcher([[]]).counts("anything") == [0] and Matcher([["x"]]).counts("") == [0]


def test_one_pass_for_all_sets(spark):
    df = spark.createDataFrame([("I think it might be. In fact, it could be!",), (None,), ("",)], "t string")
    out = df.select(count_sets(F.col("t"), SETS).alias("c")).select("c.*")
    assert [tuple(r) for r in out.collect()] == [(1, 4, 0, 0, 0), (0,) * 5, (0,) * 5]
    assert count_sets(F.col("t"), {"n": ["I think"]}, fix_case=True) is not None
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert df.limit(0).select(count_sets(F.col("t"), SETS).alias("c")).count() == 0


def by_sentence(text):
    """The rules, sentence by sentence, with regular expressions only."""
    parts = [p.strip(WHITE) for p in re.split("[\x01\n]", re.sub(r"([.!?])[ \t\n\x0b\f\r]+", "\\1\x01", text))]
    sentences = [p for p in parts if p]
    words = [re.findall(r"\w+", p.lower()) for p in sentences]
    participle = lambda w: w.endswith("ed") or w in x.PARTICIPLES

    def passive(w):
        w = [*w, "", ""]
        return any(w[i] in x.BE and (participle(w[i + 1]) or ((w[i + 1] == "not" or w[i + 1].endswith("ly")) and participle(w[i + 2]))) for i in range(len(w) - 2))

    tokens = sum(len(re.findall(r"\w+|[^\w \t\n\x0b\f\r]", p)) for p in sentences)
    return sentences, [v for w in words for v in w], tokens, sum(map(passive, words))


BITS = ["was", "is", "not", "fully", "opened", "seen", "the", "It", ".", "! ", "?\n", "\n\n", " ", ", ", "\xa0", "\u2003", "é", "ÀB", "İx", "Ω", "🙂", "_", "7", "...  ", "were made", "be quietly taken.", "\x01", "\x85"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(BITS), st.text(max_size=2)), max_size=30))
def test_rules_equal_those_by_sentence(bits):
    for text in ("".join(bits), " ".join(bits)):
        assert tuple(s.rules(text)) == by_sentence(text)


def test_repeats_over_many_words():
    r = random.Random(1)
    words = [f"w{i}" for i in range(20_000)]
    assert not s.repeats(words) and s.repeats(words + words[100:103]) and not s.repeats(words + words[100:102])
    for _ in range(300):
        some = [r.choice("abcd") for _ in range(r.randrange(12))]
        grams = list(zip(some, some[1:], some[2:]))
        assert s.repeats(some) == (len(set(grams)) < len(grams))


def test_another_analyser(spark):
    df = spark.createDataFrame([("1", "d", "Maybe it was seen. Never.")], "task_id string, domain string, response string")
    row = s.features(df, analyser=lambda t: s.Analysis([t], ["maybe"], 10, 0)).first()
    assert (row.n_sentences, row.mean_sentence_length, row.active_voice_ratio, row.n_hedges, row.claim_in_first_sentence) == (1, 10.0, 1.0, 1, False)


def test_long_texts_take_time_in_proportion():
    import time

    def took(n):
        began = time.perf_counter()
        s.Counter()("It was seen that it might be. " * n)
        return time.perf_counter() - began

    took(100)
    small, large = took(5_000), took(40_000)
    assert large < 30 * small
