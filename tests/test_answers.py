import random

import pytest
from pyspark.sql import functions as F

from slipscope.functions import answers as a
from slipscope.functions import text as t
from slipscope.functions.lexicon import CUES, OPENINGS, SPLITTERS
from slipscope.operators import judging


def value(spark, column, x):
    return spark.createDataFrame([(x,)], "x string").select(column(F.col("x")).alias("y")).first().y


FACTUAL = [
    ("Paris.", "Paris"),
    ("Let me think.\nIn short: Mount Elbrus!", "Mount Elbrus"),
    ("In short:\nSimply put, Lake Nyos.", "Lake Nyos"),
    ("The answer is A: Oslo;", "Oslo"),
    ("The tallest peak on that list was said to be K2 but it is Everest", "Everest"),
    ("The answer to the question is Rome", "Rome"),
    ("The tallest peak on that long list IS Everest", "Everest"),
    ("The tallest peaks on that long list WERE two, but it Is K2.", "K2"),
    ("  \n ", ""),
    ("", ""),
    (None, ""),
]
NUMERICAL = [
    ("The answer is $1,250.50.", "1250.50"), ("the answer is: 42", "42"), ("The answer is **7**", "7"), ("The answer is -5", "-5"),
    ("Total is 42. So, done", ""), ("THE ANSWER IS 9 or 10", "10"), ("No digits here", ""), (None, ""),
]
LETTER = [("b", "B"), ("(C) because", "C"), ("The answer is B", ""), ("The answer is B.", "B"), ("I found it", "D"), ("Although", ""), ("D-", "D"), (None, "")]
NORMAL = [("The  U.S.A.", "us"), ("A man, an axe & the_dog", "man axe the_dog"), ("Vitamin A", "vitamin"), ("É-an-b", "é b"), (None, "")]


@pytest.mark.parametrize("column, cases", [(a.factual, FACTUAL), (a.numerical, NUMERICAL), (a.letter, LETTER), (t.normalise, NORMAL)])
def test_scalars(spark, column, cases):
    rows = spark.createDataFrame(list(enumerate(x for x, _ in cases)), "i int, x string")
    got = {r.i: r.y for r in rows.select("i", column(F.col("x")).alias("y")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_clean_response(spark):
    cases = [("yes <|im_end|> more", "yes"), ("You are an AI assistant x", "You are an AI assistant x"), ("a <|endoftext|> b <|im_start|>", "a"), (None, ""), (" \n x ", "x")]
    for x, want in cases:
        assert value(spark, t.clean_response, x) == want


MATCHES = [
    ("The Nile", "nile", None, True), ("Nile", "River Nile", None, True), ("cat", "concatenate", None, True),
    ("he was born in the year 1934", "1934", [], True), ("thick pea soup with some extra bread", "soup", None, True),
    ("a long sentence that mentions mount everest early", "Mount Everest", None, False), ("Big Apple", "NYC", ["The Big Apple"], True),
    ("", "Everest", None, True), ("", "K2", None, False), ("x", None, [None, "!"], False),
]


def test_match_factual(spark):
    rows = spark.createDataFrame([(i, *m) for i, m in enumerate(MATCHES)], "i int, e string, t string, al array<string>, want boolean")
    for r in rows.select("i", "want", a.match_factual(F.col("e"), F.col("t"), F.col("al")).alias("got")).collect():
        assert r.got == r.want, MATCHES[r.i]


def test_match_numbers_and_letters(spark):
    cases = [("1250.50", "1,250.5", True), ("1d", "1", False), ("", "1", False), ("1e2", "100", True), (None, None, False)]
    rows = spark.createDataFrame(cases, "e string, t string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", a.match_numerical(F.col("e"), F.col("t")).alias("got")).collect())
    rows = spark.createDataFrame([(" b ", "B", True), ("c", "B", False)], "e string, t string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", a.match_letter(F.col("e"), F.col("t")).alias("got")).collect())


def test_judging_of_nothing_has_null_rates(spark):
    rows = spark.createDataFrame([("1", "odd", "It is Rome.", "rome", ([],))], "task_id string, domain string, response string, ground_truth string, metadata struct<aliases: array<string>>")
    judged = judging.judge(rows)
    assert judged.first().is_correct
    assert [r.total for r in judging.judged_counts(judged).collect()] == [1, 1]
    empty = judging.judged_counts(judged.limit(0)).collect()
    assert all(r.correct_rate is None for r in empty)


WHITE = t.WHITE
PARTS = [*CUES, *(o.title() for o in OPENINGS), *SPLITTERS, "\n", " ", ": ", ".", "!", "Mount Elbrus", "it is K2", "one two three four five six", "İ", "é", "\t", "IN SHORT", ";", ","]


def plain_factual(response):
    whole = (response or "").strip(WHITE)
    lines = [x for x in (x.strip(WHITE) for x in whole.split("\n")) if x]
    found = [x[x.lower().find(c) + len(c) :].lstrip(":,; ").strip(WHITE).rstrip(".!,;:") for x in lines for c in CUES if c in x.lower()]
    out = next((x for x in found if x), lines[0] if lines else "")
    for o in OPENINGS:
        if out.lower().startswith(o):
            out = out[len(o) :].strip(WHITE)
    out = out.rstrip(".!,;:")
    used = next((s for s in SPLITTERS if s in out.lower()), None)
    if used and len(out.split()) > 6:
        tail = out[out.lower().find(used) + len(used) :].strip(WHITE).rstrip(".")
        if 1 <= len(tail.split()) <= len(out.split()) - 2:
            out = tail
    return out.strip(WHITE)


def test_factual_answers_equal_a_plain_version(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(PARTS) + r.choice(["", " "]) for _ in range(r.randrange(12))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = {x.i: x.y for x in df.select("i", a.factual(F.col("x")).alias("y")).collect()}
    for i, x in enumerate(texts):
        assert got[i] == plain_factual(x), repr(x)
