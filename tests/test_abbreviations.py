import random

import pytest

from slipscope.operators import abbreviations as a
from slipscope.operators import surface as s


def corpus(spark, seed=1):
    r = random.Random(seed)
    plain = ["walked", "home", "river", "said", "green", "talking", "it", "is"]
    texts = []
    for _ in range(300):
        sentences = []
        for _ in range(r.randrange(1, 8)):
            w = [r.choice(plain) for _ in range(r.randrange(3, 9))]
            if r.random() < 0.4:
                w.insert(r.randrange(len(w)), r.choice(["Dr. Who", "vs. Kent", "Mr. Bean", "e.g. this", "No. 7", "U.S. law"]))
            sentences.append(" ".join(w).capitalize() + r.choice(".....?!"))
        texts.append((" ".join(sentences),))
    return spark.createDataFrame([*texts, (None,), ("",), ("3.5 km. 2.",)], "text string").repartition(3)


def test_abbreviations_are_found_and_words_are_not(spark):
    found = a.learned(corpus(spark))
    assert {"dr", "vs", "mr", "e.g", "u.s"} <= found
    assert not found & {"walked", "home", "river", "said", "green", "talking", "who", "bean", "3.5", "2"}
    assert a.learned(corpus(spark), most=2) < found and len(a.learned(corpus(spark), most=2)) == 2
    assert a.learned(corpus(spark).limit(0)) == frozenset()


def test_counts(spark):
    df = spark.createDataFrame([("Dr. Who met Dr. No. The dr said e.g. no.",), (None,)], "text string")
    got = {r.word: (r.n, r.n_stops) for r in a.counts(df).collect()}
    assert got == {"dr": (3, 2), "who": (1, 0), "met": (1, 0), "no": (2, 2), "the": (1, 0), "said": (1, 0), "e.g": (1, 1)}


def test_full_stops_of_abbreviations_close_no_sentence(spark):
    text = "Dr. Who vs. Mr. X. It was seen, e.g. here. Was it? No.\nEnd"
    told = a.analyser(frozenset({"dr", "vs", "mr", "e.g"}))
    assert s.rules(text).sentences == ["Dr.", "Who vs.", "Mr.", "X.", "It was seen, e.g.", "here.", "Was it?", "No.", "End"]
    assert told(text).sentences == ["Dr. Who vs. Mr. X.", "It was seen, e.g. here.", "Was it?", "No.", "End"]
    assert told(text)[1:] == s.rules(text)[1:3] + (1,)
    df = spark.createDataFrame([("1", "d", text)], "task_id string, domain string, response string")
    plain, joined = s.features(df).first(), s.features(df, analyser=told).first()
    assert (plain.n_sentences, joined.n_sentences) == (9, 5) and plain.n_boosters == joined.n_boosters
    assert joined.mean_sentence_length == pytest.approx(plain.mean_sentence_length * 9 / 5)


def test_long_words_are_no_abbreviations():
    told = a.analyser(frozenset({"x" * a.LONGEST, "x" * (a.LONGEST + 1)}))
    for n, sentences in ((a.LONGEST, 1), (a.LONGEST + 1, 2), (90, 2)):
        assert len(told("x" * n + ". Then").sentences) == sentences
