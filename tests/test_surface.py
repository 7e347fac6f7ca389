import pytest
from pyspark.sql import functions as F

from slipscope.functions import lexicon as x
from slipscope.functions import sql
from slipscope.functions.markers import count_markers
from slipscope.functions.text import sentences
from slipscope.operators import surface as s


def features(spark, *texts):
    rows = s.features(spark.createDataFrame([(str(i), "d", t) for i, t in enumerate(texts)], "task_id string, domain string, response string")).collect()
    return sorted(rows, key=lambda r: int(r.task_id))


def test_empty_text_has_the_neutral_score(spark):
    for r in features(spark, "", None, " \n "):
        assert r.lcs_score == pytest.approx(0.475)
        assert (r.n_sentences, r.booster_ratio, r.claim_in_first_sentence, r.has_repetition) == (0, 0.5, False, False)


MARKERS = [
    ("I think so, I believe", x.HEDGES, 0), ("It might be", x.HEDGES, 2), ("it could be", x.HEDGES, 2), ("unlikely", x.HEDGES, 1),
    ("in factories", x.BOOSTERS, 1), ("Never, ALWAYS exactly", x.BOOSTERS, 3), ("However it is fine; howevers", x.CONCESSIVES, 1), ("", x.BOOSTERS, 0),
]


def test_markers(spark):
    for t, markers, n in MARKERS:
        row = spark.createDataFrame([(t,)], "t string").select(count_markers(F.col("t"), markers).alias("n")).first()
        assert row.n == n, t
    row = spark.createDataFrame([("I think",)], "t string").select(count_markers(F.col("t"), x.HEDGES, fix_case=True).alias("n")).first()
    assert row.n == 1


def test_rules(spark):
    a, b, c = features(spark, "It was firmly established. Is it so? Perhaps.", "Perhaps not. The the a) an", "one two three four. One two three!")
    assert (a.n_sentences, a.claim_in_first_sentence) == (3, True)
    assert a.active_voice_ratio == pytest.approx(2 / 3) and a.declarative_ratio == pytest.approx(2 / 3)
    assert not b.claim_in_first_sentence and b.definite_reference_ratio == pytest.approx(0.5)
    assert c.has_repetition and c.mean_sentence_length == pytest.approx(4.5)


def test_sentences(spark):
    row = spark.createDataFrame([("A b.  C!\n\nD? e.f",)], "t string").select(sentences(F.col("t")).alias("s")).first()
    assert row.s == ["A b.", "C!", "D?", "e.f"]


def test_scores_stay_in_range_whatever_the_partitions(spark):
    texts = ["Certainly, in fact it was said. " * k + "maybe" * (k % 2) for k in range(12)]
    rows = features(spark, *texts)
    assert all(0 <= r.lcs_score <= 1 for r in rows)
    df = spark.createDataFrame([(str(i), "d", t) for i, t in enumerate(texts)], "task_id string, domain string, response string").repartition(7)
    assert sorted(s.features(df).collect(), key=lambda r: int(r.task_id)) == rows


def test_sql_functions_agree_with_columns(spark):
    df = spark.createDataFrame([("It might be. In fact, The U.S.A. never; the answer is $1,200.",), (None,)], "t string")
    sql.register(spark, said=df)
    got = spark.sql("SELECT count_hedges(t) h, count_boosters(t) b, normalise_answer(t) n, extract_number(t) x, count_words(t) w FROM said").collect()
    assert (got[0].h, got[0].b, got[0].x, got[0].w) == (2, 2, "1200", 12)
    assert got[0].n.startswith("it might be in fact us never") and got[1].n == "" and got[1].w == 0
