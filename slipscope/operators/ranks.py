"""Running totals and ranks over whole tables, without gathering them into one task.

Rows are dealt by ranges of the order, written, and summed within each range; the ranges' totals (one number for each
partition) give the offsets.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import staged


def running_total(df: DataFrame, order: list[Column], weight: Column, out: str) -> DataFrame:
    """df with the sum of ``weight`` over its row and all before it, in the given order. Ties in the order are ranked anyhow."""
    ranged = staged(df.withColumn("_w", weight).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = {r["_part"]: r.total for r in ranged.groupBy("_part").agg(F.sum("_w").alias("total")).collect()}
    offsets = list(zip(sorted(totals), accumulate([totals[part] for part in sorted(totals)], initial=0)))
    kind = ranged.select(F.sum("_w")).schema[0].dataType.simpleString()
    # One row for each partition.
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, f"_part int, _before {kind}"))
    within = F.sum("_w").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(out, within).join(before, "_part").withColumn(out, F.col(out) + F.col("_before")).drop("_w", "_part", "_before")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with 1, 2, 3 ... in the given order."""
    return running_total(df, order, F.lit(1).cast("long"), out)


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """df with the rank of its value, ties sharing their mean rank. Null values have no rank."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    upto = running_total(counts, [F.col("_value")], F.col("_n"), "_upto")
    ranks = upto.select("_value", (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return df.join(ranks, F.col(value) == F.col("_value"), "left").drop("_value")


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order``."""
    best = df.groupBy(key).agg(F.max_by(F.struct(*df.columns), order).alias("_row"))
    return best.select("_row.*")
