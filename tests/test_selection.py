import math
import random
import statistics

import pytest

from slipscope.operators import reports, selection, stats

VALUES = {
    "even": [1.0, 2.0, 3.0, 4.0],
    "odd": [3.0, 1.0, 2.0],
    "one": [7.5],
    "ties": [0.5] * 600 + [0.1] * 399 + [0.9] * 2,
    "all tied": [2.0] * 8,
    "negative": [-1.0, -1e-300, 0.0, -0.0, 1e300, -1e300],
    "scales": [10.0**-k for k in range(0, 300, 3)],
    "neighbours": [1.0, 1.0 + 2**-52, 1.0 - 2**-53, 1.0 + 2**-51],
    "widest": [-1.7e308, 1.7e308, 1.0, 2.0, 3.0],
    "infinite": [-math.inf, -math.inf, 1.0, 2.0, math.inf],
    "mostly infinite": [math.inf, math.inf, 1.0],
}


def frame(spark, columns):
    longest = max(map(len, columns.values()))
    rows = list(zip(*[c + [None] * (longest - len(c)) for c in columns.values()]))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in columns)).repartition(5)


def test_medians_equal_sorting(spark):
    r = random.Random(2)
    columns = VALUES | {"even spread": [r.random() for _ in range(5000)], "skewed": [r.random() ** 40 for _ in range(4999)], "coarse": [r.randrange(7) / 7 for _ in range(5000)]}
    got = selection.medians(frame(spark, columns), *columns).first()
    for name, values in columns.items():
        assert got[name] == pytest.approx(statistics.median(values), rel=1e-15), name


def test_no_values_and_not_a_number(spark):
    df = spark.createDataFrame([(None, math.nan, 1.0), (None, 1.0, math.nan), (None, 2.0, math.nan)], "a double, b double, c double")
    got = selection.medians(df, "a", "b", "c").first()
    assert got.a is None and got.b == 2.0 and math.isnan(got.c)
    assert selection.medians(df.limit(0), "b").first().b is None


def test_passes_are_few_and_send_bins_only(spark, monkeypatch):
    calls = []
    histograms = selection._histograms
    monkeypatch.setattr(selection, "_histograms", lambda df, spans: calls.append(len(spans)) or histograms(df, spans))
    df = spark.range(200_000).selectExpr("cast(id % 65536 as double) / 65536 as x")
    assert selection.medians(df, "x").first().x == statistics.median([i % 65536 / 65536 for i in range(200_000)])
    assert len(calls) == 2 and max(calls) <= 2


def test_plans_hold_no_gathering_aggregate(spark):
    df = spark.createDataFrame([("a", 0.1, 0.2, 0.3, 0.4), ("b", 0.5, 0.4, 0.3, 0.2)], "domain string, isd_score double, lcs_score double, pei_score double, pei_multiplicative double")
    gone = spark.createDataFrame([("a", 1)], "domain string, n_excluded long")
    isd = spark.createDataFrame([(True, 0.5)], "is_correct boolean, isd_score double")
    for out in (stats.overall_summary(df), reports.summary(df)[0], reports.extended_summary(df, gone, isd)):
        plan = out._jdf.queryExecution().toString().lower()
        assert "percentile" not in plan and "median(" not in plan and "collect_" not in plan


def test_summary_and_ranking_agree(spark):
    r = random.Random(3)
    for n in (1, 2, 101, 400):
        rows = [(r.choice("abc"), r.random(), r.random(), r.choice([r.random(), 0.5])) for _ in range(n)]
        df = spark.createDataFrame(rows, "domain string, isd_score double, lcs_score double, pei_score double").repartition(3)
        want = statistics.median([x[3] for x in rows])
        overall, by_domain = reports.summary(df)
        assert stats.overall_summary(df).first()["median"] == pytest.approx(want) and overall.first()["median"] == pytest.approx(want)
        assert {x.domain: (x.n, pytest.approx(x.mean)) for x in by_domain.collect()} == {d: (sum(y[0] == d for y in rows), statistics.mean([y[3] for y in rows if y[0] == d])) for d in {y[0] for y in rows}}
        alone = stats.domain_summary(df).collect()
        assert {x.domain: (x.n, pytest.approx(x.mean), x.std and pytest.approx(x.std)) for x in by_domain.collect()} == {x.domain: (x.n, x.mean, x.std) for x in alone}
