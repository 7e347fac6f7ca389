"""Examples and summaries for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..sources.store import staged
from . import composite, stats
from .selection import medians

#: Chance, and the range of the axis, in the figure of probe accuracies.
PROBE_CHANCE, PROBE_AXIS = 0.5, (0.4, 1.0)
N_EXAMPLES, PROMPT_CHARS, RESPONSE_CHARS = 5, 200, 300


def shortened(c: Column, n: int) -> Column:
    return F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def showcase(scored: DataFrame, judged: DataFrame, n: int = N_EXAMPLES) -> DataFrame:
    """The n highest and the n lowest errors (both by falling score), with what was asked and said.

    Examples without a judged row keep empty texts. With fewer than 2 n errors, the buckets overlap.
    """
    errors = scored.where(~F.col("is_correct"))
    top = errors.orderBy(F.col("pei_score").desc(), "pei_rank").limit(n).withColumn("bucket", F.lit("high"))
    low = errors.orderBy(F.col("pei_score").asc(), F.col("pei_rank").desc()).limit(n).withColumn("bucket", F.lit("low"))
    picked = top.unionByName(low)
    from pyspark.sql import Window

    picked = picked.withColumn("pos", F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("pei_score").desc(), "pei_rank")))
    words = judged.select("task_id", "prompt", "response", "ground_truth", "extracted_answer")
    out = picked.join(words, "task_id", "left")
    scores = [F.round(c, 3).alias(c) for c in ("pei_score", "isd_score", "lcs_score", "pei_multiplicative") if c in scored.columns]
    return out.select(
        "bucket", "pos", "task_id", "domain", *scores,
        shortened(text("prompt"), PROMPT_CHARS).alias("prompt"), shortened(text("response"), RESPONSE_CHARS).alias("response"),
        text("ground_truth").alias("ground_truth"), text("extracted_answer").alias("extracted_answer"),
    )


def summary(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Overall (with median and the Kruskal-Wallis test of domains) and by domain: one pass for all sums, one ranking for the rest."""
    rows = stats.summary_rows(scored)
    both, ranked = staged(stats.summaries(rows), "summaries"), stats.ranking(rows, "domain", "pei_score")
    test = stats.kruskal_test(ranked).select(F.col("h").alias("kruskal_h"), F.col("p").alias("kruskal_p"))
    whole = both.where("overall").crossJoin(F.broadcast(stats.median_of(ranked))).crossJoin(F.broadcast(test))  # one row each
    return whole.select("n", "mean", "std", "median", "isd_lcs_correlation", "kruskal_h", "kruskal_p"), both.where("not overall").select("domain", "n", "mean", "std")


def extended_summary(extended: DataFrame, excluded: DataFrame, isd: DataFrame) -> DataFrame:
    """Totals, exclusions, both composites, their correlation and the separation of the calibrated scores; one row."""
    rows = staged(extended.select("pei_score", "pei_multiplicative", "isd_score", "lcs_score"), "extended")
    both = rows.agg(
        F.count("*").alias("n_errors"),
        F.avg("pei_score").alias("additive_mean"), F.stddev_samp("pei_score").alias("additive_std"),
        F.avg("pei_multiplicative").alias("multiplicative_mean"), F.stddev_samp("pei_multiplicative").alias("multiplicative_std"),
        stats.correlation("isd_score", "lcs_score").alias("isd_lcs_correlation"), stats.correlation("pei_score", "pei_multiplicative").alias("composition_correlation"),
    )
    gone = excluded.agg(F.coalesce(F.sum("n_excluded"), F.lit(0)).alias("n_excluded"))
    mean = lambda ok: F.avg(F.when(F.col("is_correct") == ok, F.col("isd_score")))
    apart = isd.agg(mean(True).alias("isd_mean_correct"), mean(False).alias("isd_mean_errors"))
    middle = medians(rows, "pei_score").withColumnRenamed("pei_score", "additive_median")
    return both.crossJoin(F.broadcast(middle)).crossJoin(F.broadcast(gone)).crossJoin(F.broadcast(apart))


def probe_bars(results: DataFrame) -> DataFrame:
    """Two bars for each layer, accuracy and area under the curve, with the chance line and the axis of the figure."""
    bars = F.explode(F.array(*[F.struct(F.lit(i).alias("bar"), F.lit(name).alias("measure"), F.col(c).alias("value")) for i, (c, name) in enumerate((("accuracy", "Accuracy"), ("auc", "AUC")))]))
    rows = results.select("layer_idx", bars.alias("b"))
    return rows.select("layer_idx", "b.measure", "b.value", (F.col("b.value") - PROBE_CHANCE).alias("above_chance"), F.col("b.value").between(*PROBE_AXIS).alias("on_axis"))


def figures(extended: DataFrame, isd: DataFrame, bins: int = 30, domain_bins: int = 20) -> dict[str, DataFrame]:
    """The data of all figures by name; drawing them is left to the caller."""
    return {
        "distribution": stats.histogram(extended, "pei_score", bins),
        "distribution_by_domain": stats.histogram(extended, "pei_score", domain_bins, "domain"),
        "multiplicative": stats.histogram(extended, "pei_multiplicative", bins),
        "isd_vs_lcs": extended.select("task_id", "domain", "isd_score", "lcs_score", stats.quadrant(F.col("isd_score"), F.col("lcs_score")).alias("quadrant")),
        "isd_by_correctness": stats.histogram(isd, "isd_score", bins, "is_correct"),
        "composites": extended.select("task_id", "domain", "pei_score", "pei_multiplicative"),
        "disagreement": composite.disagreement(extended),
    }
