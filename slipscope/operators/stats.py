"""Summaries, tests and histograms."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import staged
from .ranks import average_ranks, running_total
from .selection import medians


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for chi-squared: closed forms for one and two degrees, then the recurrence."""
    if x <= 0:
        return 1.0
    k, q = (1, math.erfc(math.sqrt(x / 2))) if df % 2 else (2, math.exp(-x / 2))
    while k < df:
        q += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
        k += 2
    return q


def correlation(a: str, b: str) -> Column:
    """Pearson's r as an aggregate; null where a column doesn't vary."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _figures(score: str) -> list[Column]:
    return [F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), correlation("isd_score", "lcs_score").alias("isd_lcs_correlation")]


def summary_rows(df: DataFrame, score: str = "pei_score") -> DataFrame:
    """The columns that summaries are about, written once for all of them."""
    return staged(df.select("domain", "isd_score", "lcs_score", score), "summary")


def overall_summary(df: DataFrame, score: str = "pei_score") -> DataFrame:
    rows = summary_rows(df, score)
    # One row each.
    out = rows.agg(*_figures(score)).crossJoin(F.broadcast(medians(rows, score).withColumnRenamed(score, "median")))
    return out.select("n", "mean", "std", "median", "isd_lcs_correlation")


def domain_summary(df: DataFrame, score: str = "pei_score") -> DataFrame:
    return df.groupBy("domain").agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"))


def summaries(rows: DataFrame, score: str = "pei_score") -> DataFrame:
    """The figures of the whole set (``overall``) and of each domain, in one pass."""
    sets = rows.groupingSets([["domain"], []], "domain").agg(*_figures(score), F.grouping("domain").alias("_all"))
    return sets.select("domain", (F.col("_all") == 1).alias("overall"), "n", "mean", "std", "isd_lcs_correlation")


@dataclass(frozen=True)
class Ranking:
    """A column as a table of its values: by (group, value) with ``n`` rows, and by value with ``n`` and ``upto``, the rows up to it."""

    cells: DataFrame
    values: DataFrame


def ranking(df: DataFrame, group: str, value: str) -> Ranking:
    """The ranking of the rows that have a value: one pass over them serves all that depends on ranks."""
    some = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("group"), F.col(value).alias("value")).agg(F.count("*").alias("n"))
    cells = staged(some, "cells")
    values = cells.groupBy("value").agg(F.sum("n").alias("n"))
    return Ranking(cells, running_total(values, [F.col("value")], F.col("n"), "upto"))


def kruskal_of(ranked: Ranking) -> DataFrame:
    """One row: n, groups and H with correction for ties; H is null for one group or all values tied."""
    values = ranked.values.select("value", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))
    each = ranked.cells.join(values, "value").groupBy("group").agg(F.sum("n").cast("double").alias("c"), F.sum(F.col("n") * F.col("rank")).alias("r"))
    sums = each.agg(F.sum("c").alias("n"), F.count("*").alias("groups"), F.sum(F.col("r") * F.col("r") / F.col("c")).alias("s"))
    t = F.col("n").cast("double")
    one = sums.crossJoin(F.broadcast(ranked.values.agg(F.sum(t * t * t - t).alias("ties"))))  # one row each
    n = F.col("n")
    plain = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    share = 1 - F.col("ties") / (n * n * n - n)
    return one.select(n.cast("long").alias("n"), F.col("groups"), F.when((F.col("groups") > 1) & (F.col("ties") < n * n * n - n), plain / share).alias("h"))


def median_of(ranked: Ranking) -> DataFrame:
    """One row, ``median``: the least values up to which the middle ranks are reached."""
    whole = ranked.values.agg(F.sum("n").alias("_n"))
    reached = lambda k: F.min(F.when(F.col("upto") >= k, F.col("value")))
    low, high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    return ranked.values.crossJoin(F.broadcast(whole)).agg((reached(low) / 2 + reached(high) / 2).alias("median"))  # one row joined


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    return kruskal_of(ranking(df, group, value))


def kruskal_test(ranked: Ranking) -> DataFrame:
    """kruskal_of with its p; the statistic is one row, the tail is computed on the driver."""
    r = kruskal_of(ranked).first()
    p = chi2_tail(r.h, r.groups - 1) if r.h is not None else None
    return ranked.cells.sparkSession.createDataFrame([(r.n, r.groups, r.h, p)], "n long, groups long, h double, p double")


def auc(df: DataFrame, label: str, score: str, by: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting half; 0.5 if there is one class only. ``by``: for each group, in the same pass.

    For each value, its ones meet the others below it: running totals of the others over (group, value).
    """
    is_one = F.col(label) == 1
    cells = df.where(F.col(score).isNotNull()).groupBy((F.col(by) if by else F.lit(0)).alias("_group"), F.col(score).alias("_value")).agg(F.count_if(is_one).alias("_ones"), F.count_if(~is_one).alias("_others"))
    upto = running_total(cells, [F.col("_group"), F.col("_value")], F.col("_others"), "_upto")
    ones, others = F.sum("_ones").cast("double"), F.sum("_others").cast("double")
    met = F.sum(F.col("_ones") * (F.col("_upto") - F.col("_others") / 2.0))
    sums = upto.groupBy("_group").agg(ones.alias("p"), others.alias("q"), met.alias("met"), F.min(F.col("_upto") - F.col("_others")).alias("before"))
    p, q = F.col("p"), F.col("q")
    area = F.when((p > 0) & (q > 0), (F.col("met") - p * F.col("before")) / F.nullif(p * q, F.lit(0.0))).otherwise(0.5).alias("auc")
    if by:
        return sums.select(F.col("_group").alias(by), area)
    # One row, also of an empty table.
    return sums.select(area).agg(F.coalesce(F.max("auc"), F.lit(0.5)).alias("auc"))


def separation(df: DataFrame, score: str = "isd_score") -> DataFrame:
    """n, mean and population standard deviation by correctness."""
    return df.groupBy("is_correct").agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))


def histogram(df: DataFrame, value: str, bins: int, by: str | None = None) -> DataFrame:
    """Counts in equal bins between a group's own least and greatest value; the last bin holds its upper end."""
    keys = [by] if by else []
    ends = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    spread = df.join(ends.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).drop("_by") if by else df.crossJoin(F.broadcast(ends))
    span = F.col("_hi") - F.col("_lo")
    place = F.least(F.floor((F.col(value) - F.col("_lo")) / F.nullif(span, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    rows = spread.where(F.col(value).isNotNull()).withColumn("bin", F.coalesce(place, F.lit(bins // 2)))
    low = F.col("_lo") + F.col("bin") * span / bins
    return rows.groupBy(*keys, "bin", low.alias("low")).agg(F.count("*").alias("n"))


def quadrant(isd: Column, lcs: Column) -> Column:
    side = lambda c, name: F.when(c >= 0.5, "high_" + name).otherwise("low_" + name)
    return F.concat_ws("_", side(isd, "isd"), side(lcs, "lcs"))


def quadrants(df: DataFrame) -> DataFrame:
    return df.groupBy(quadrant(F.col("isd_score"), F.col("lcs_score")).alias("quadrant")).agg(F.count("*").alias("n"))


def domains(df: DataFrame) -> DataFrame:
    return df.select("domain").distinct()
