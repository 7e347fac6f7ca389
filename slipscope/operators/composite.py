"""The composite risk index: join, filter, normalise, combine, rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_words, text
from .ranks import average_ranks, numbered
from .stats import correlation

ISD_WEIGHT = LCS_WEIGHT = 0.5
#: Below this range, min-max normalisation has nothing to tell apart.
FLAT = 1e-8
LEAST_WORDS = 20


def joined(isd: DataFrame, lcs: DataFrame) -> DataFrame:
    """Rows with both scores; domain and correctness from the first."""
    return isd.select("task_id", "domain", "is_correct", "isd_score").join(lcs.select("task_id", "lcs_score"), "task_id")


def errors_only(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_correct"))


def normalised(df: DataFrame, columns: list[str], method: str = "min_max") -> DataFrame:
    """Columns scaled over the rows of df: to their range (0.5 where it is flat), or to percentiles (NaN for one row)."""
    if method == "min_max":
        ends = df.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
        out = df.crossJoin(F.broadcast(ends))  # one row
        for c in columns:
            lo, span = F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
            out = out.withColumn(c, F.when(span < FLAT, 0.5).otherwise((F.col(c) - lo) / F.greatest(span, F.lit(FLAT))))
        return out.drop(*ends.columns)
    if method == "percentile":
        n = df.count()
        for c in columns:
            scaled = F.lit(float("nan")) if n < 2 else (F.col("_rank") - 1) / (n - 1)
            df = average_ranks(df, c, "_rank").withColumn(c, scaled).drop("_rank")
        return df
    raise ValueError(f"unknown normalisation: {method!r}; min_max and percentile are known")


def additive(isd: Column, lcs: Column, isd_weight: float = ISD_WEIGHT, lcs_weight: float = LCS_WEIGHT) -> Column:
    return isd_weight * isd + lcs_weight * lcs


def multiplicative(isd: Column, lcs: Column) -> Column:
    return isd * lcs


def ranked(df: DataFrame, score: str = "pei_score", out: str = "pei_rank") -> DataFrame:
    """1, 2, 3 ... by falling score, ties by task_id."""
    return numbered(df, [F.col(score).desc(), F.col("task_id").asc()], out)


def index(isd: DataFrame, lcs: DataFrame, isd_weight: float = ISD_WEIGHT, lcs_weight: float = LCS_WEIGHT, method: str = "min_max", only_errors: bool = True) -> DataFrame:
    """The ranked index over the rows with both scores. No rows give no rows."""
    both = joined(isd, lcs)
    both = errors_only(both) if only_errors else both
    scaled = normalised(both, ["isd_score", "lcs_score"], method)
    scored = scaled.withColumn("pei_score", additive(F.col("isd_score"), F.col("lcs_score"), isd_weight, lcs_weight))
    return ranked(scored).select("task_id", "domain", "is_correct", "isd_score", "lcs_score", "pei_score", "pei_rank")


def extended_index(isd: DataFrame, lcs: DataFrame, responses: DataFrame, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The index over responses of enough words, with the multiplicative composite too."""
    out = index(long_enough(isd, responses, least_words), lcs, **options)
    return out.withColumn("pei_multiplicative", multiplicative(F.col("isd_score"), F.col("lcs_score")))


def n_words(response: Column) -> Column:
    return F.size(blank_words(text(response)))


def long_enough(df: DataFrame, responses: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Rows whose response has enough words; a missing response has none."""
    words = responses.select("task_id", n_words(F.col("response")).alias("_words"))
    return df.join(words, "task_id", "left").where(F.coalesce("_words", F.lit(0)) >= least).drop("_words")


def excluded_by_domain(df: DataFrame, kept: DataFrame) -> DataFrame:
    return df.join(kept.select("task_id"), "task_id", "left_anti").groupBy("domain").agg(F.count("*").alias("n_excluded"))


def composition_correlation(df: DataFrame) -> DataFrame:
    """Pearson's r of the two composites, and Spearman's by its own name."""
    ranks = average_ranks(average_ranks(df, "pei_score", "_ra"), "pei_multiplicative", "_rm")
    return ranks.agg(correlation("pei_score", "pei_multiplicative").alias("pearson"), correlation("_ra", "_rm").alias("spearman"))


def disagreement(df: DataFrame, n: int = 20) -> DataFrame:
    """The n rows whose composites differ most."""
    gap = F.abs(F.col("pei_score") - F.col("pei_multiplicative"))
    return df.withColumn("disagreement", gap).orderBy(F.col("disagreement").desc(), "pei_rank").limit(n)


def attached(df: DataFrame, scores: DataFrame, column: str) -> DataFrame:
    """df with a score looked up by task_id; a missing one is null."""
    return df.join(scores.select("task_id", column), "task_id", "left")


def extremes(df: DataFrame) -> DataFrame:
    return df.agg(F.max("pei_score").alias("top"), F.min("pei_score").alias("bottom"), F.avg("pei_score").alias("mean"))
