"""Judging responses: taking the answer, matching it, and counting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.answers import extracted, matched


def judge(responses: DataFrame) -> DataFrame:
    """responses with extracted_answer and is_correct. One narrow select."""
    taken = responses.withColumn("extracted_answer", extracted(F.col("domain"), F.col("response")))
    return taken.withColumn("is_correct", matched(F.col("domain"), F.col("extracted_answer"), F.col("ground_truth"), F.col("metadata.aliases")))


def judged_counts(judged: DataFrame) -> DataFrame:
    """total, correct, errors and their rates, by domain and overall (domain null). No rows have null rates, not an error."""
    out = judged.rollup("domain").agg(F.count("*").alias("total"), F.count_if("is_correct").alias("correct"), F.grouping("domain").alias("overall"))
    errors = F.col("total") - F.col("correct")
    return out.select("domain", (F.col("overall") == 1).alias("overall"), "total", "correct", errors.alias("errors"), F.try_divide("correct", "total").alias("correct_rate"), F.try_divide(errors, "total").alias("error_rate"))


def label_counts(judged: DataFrame) -> DataFrame:
    """n, errors, correct and the share of errors, of the whole set."""
    return judged.agg(F.count("*").alias("n"), F.count_if(~F.col("is_correct")).alias("errors"), F.count_if("is_correct").alias("correct"), F.avg(F.when(F.col("is_correct"), 0.0).otherwise(1.0)).alias("error_rate"))
