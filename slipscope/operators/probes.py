"""Linear probes on hidden states, and the scores they give.

Activations are a long table (task_id, layer_idx, act). The probes of all layers are fitted together: a step of the
search is one pass over the table, in which each task adds up the gradients of every layer on its own rows, and Spark adds
those up; what reaches the driver is a row for each layer. A probe is a row of a table: its scaler, its weights and its
sigmoid. Scores come from one join with that table and a dot product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import discard, staged
from . import stats
from .ranks import numbered
from .solvers import lbfgs, newton_sigmoid, together

SEED, TEST_SHARE, CALIBRATION_SHARE = 42, 0.2, 0.15
#: Rows of an Arrow batch that become a matrix at once.
ROWS = 4_096


def selected_layers(n_layers: int) -> list[int]:
    """First, last and the quarters between."""
    return sorted({0, n_layers // 4, n_layers // 2, 3 * n_layers // 4, n_layers - 1})


def selected_layers_of(n_layers: Column) -> Column:
    quarter = lambda k: F.floor(n_layers * k / 4).cast("int")
    return F.array_sort(F.array_distinct(F.array(F.lit(0), quarter(1), quarter(2), quarter(3), (n_layers - 1).cast("int"))))


def quotas(counts: dict[int, int], share: float) -> dict[int, int]:
    """Rows of each label that make up the share: largest remainders fill the total (rounded up)."""
    total = -(-round(sum(counts.values()) * share * 1e9) // 10**9)
    exact = {k: n * share for k, n in counts.items()}
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (-(exact[k] - out[k]), k))[: max(0, total - sum(out.values()))]:
        out[k] += 1
    return out


def stratified_split(df: DataFrame, share: float, label: str = "label", key: str = "task_id", seed: int = SEED) -> DataFrame:
    """df with ``held``: true for the share of each label that comes first by a hash of seed and key."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().orderBy(label).collect()}
    keyed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))))
    rows = numbered(keyed, [F.col(label), F.col("_h"), F.col(key)], "_pos")
    before, limit = 0, F.lit(False)
    take = quotas(counts, share)
    for k, n in counts.items():
        limit = F.when(F.col(label) == k, F.col("_pos") - before <= take[k]).otherwise(limit)
        before += n
    return rows.withColumn("held", limit).drop("_h", "_pos")


def standardised(df: DataFrame, train: DataFrame, column: str = "act") -> DataFrame:
    """Per layer and place, (x - mean) / population deviation of the training rows; a constant place is only centred."""
    flat = train.select("layer_idx", F.posexplode(column).alias("i", "x"))
    scale = flat.groupBy("layer_idx", "i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    packed = scale.groupBy("layer_idx").agg(F.array_sort(F.collect_list(F.struct("i", "mean", "sd"))).alias("_s"))
    safe = lambda s: F.when(s["sd"] > 0, s["sd"]).otherwise(1.0)
    out = df.join(packed, "layer_idx")
    return out.withColumn(column, F.zip_with(column, "_s", lambda x, s: (x - s["mean"]) / safe(s))).drop("_s")


@dataclass
class Probe:
    layer: int
    #: The scaler, and the weights and intercept on what it gives.
    mean: list[float] = field(repr=False)
    scale: list[float] = field(repr=False)
    weights: list[float] = field(repr=False)
    intercept: float
    accuracy: float = math.nan
    auc: float = math.nan
    n_train: int = 0
    n_test: int = 0
    #: Platt's sigmoid on the margin, for calibrated probes.
    slope: float | None = None
    shift: float | None = None


_TABLE = "layer int, mean array<double>, scale array<double>, weights array<double>, intercept double, accuracy double, auc double, n_train long, n_test long, slope double, shift double"


def table(spark: SparkSession, probes: list[Probe]) -> DataFrame:
    """A row for each probe."""
    return spark.createDataFrame([asdict(p) for p in probes], _TABLE)


def scales(train: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    """By layer: mean, population deviation (1 where it is 0) and rows. One aggregate of vectors for each layer."""
    figures = train.groupBy("layer_idx").agg(Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("act")).alias("s"))
    out = {}
    for r in figures.select("layer_idx", vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"), "s.count").collect():
        # The variance given is the sample's.
        sd = np.sqrt(np.array(r.variance) * (r["count"] - 1) / r["count"])
        out[r.layer_idx] = np.array(r.mean), np.where(sd > 0, sd, 1.0), r["count"]
    return out


def _gradients(points: dict[int, np.ndarray], scaled: dict[int, tuple[np.ndarray, np.ndarray, int]]):
    """For mapInArrow: loss and gradient of each layer's logistic loss over the rows of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss = dict.fromkeys(points, 0.0)
        gradient = {k: np.zeros_like(w) for k, w in points.items()}
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                layers, y = part["layer_idx"].to_numpy(zero_copy_only=False), part["label"].to_numpy(zero_copy_only=False)
                for layer in points.keys() & set(layers.tolist()):
                    mine = np.flatnonzero(layers == layer)
                    mean, sd, _ = scaled[layer]
                    x = (part["act"].take(pa.array(mine)).flatten().to_numpy(zero_copy_only=False).reshape(len(mine), -1) - mean) / sd
                    w = points[layer]
                    margin = x @ w[:-1] + w[-1]
                    # log(1 + exp(-m)) for ones, log(1 + exp(m)) for the others.
                    loss[layer] += float(np.logaddexp(0, np.where(y[mine] == 1, -margin, margin)).sum())
                    off = 1 / (1 + np.exp(-np.clip(margin, -700, 700))) - y[mine]
                    gradient[layer][:-1] += off @ x
                    gradient[layer][-1] += off.sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.int32()), pa.array(list(loss.values()), pa.float64()), pa.array([g.tolist() for g in gradient.values()], pa.list_(pa.float64()))], names=["layer_idx", "loss", "gradient"])

    return run


def fitted(rows: DataFrame, scaled: dict[int, tuple[np.ndarray, np.ndarray, int]]) -> dict[int, np.ndarray]:
    """Weights and, last, intercept of each layer: half the squared norm of the weights against the sum of losses.

    rows: layer_idx, act array<double>, label. The passes are those of the slowest layer, not the sum of all. A layer with
    rows of one class only has no best intercept: it gets no weights, and the log-odds of that class with half a row
    added to each.
    """
    counts = {r.layer_idx: (r.ones, r.n) for r in rows.groupBy("layer_idx").agg(F.count_if(F.col("label") == 1).alias("ones"), F.count("*").alias("n")).collect()}
    sizes = {k: n for k, (_, n) in counts.items()}
    alone = {k: np.append(np.zeros(len(scaled[k][0])), math.log((ones + 0.5) / (n - ones + 0.5))) for k, (ones, n) in counts.items() if ones in (0, n)}

    def answer(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        sums = rows.select("layer_idx", "label", "act").mapInArrow(_gradients(points, scaled), "layer_idx int, loss double, gradient array<double>")
        whole = sums.groupBy("layer_idx").agg(F.sum("loss").alias("loss"), Summarizer.sum(array_to_vector("gradient")).alias("gradient"))
        out = {}
        for r in whole.select("layer_idx", "loss", vector_to_array("gradient").alias("gradient")).collect():
            w, n = points[r.layer_idx], sizes[r.layer_idx]
            ridge = np.append(w[:-1], 0.0)
            out[r.layer_idx] = (r.loss + float(ridge @ ridge) / 2) / n, (np.array(r.gradient) + ridge) / n
        return out

    return alone | together({k: lbfgs(np.zeros(len(scaled[k][0]) + 1)) for k in sizes.keys() - alone.keys()}, answer)


def margins(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """rows (layer_idx, act) with ``margin``, by a dot product with the row of their layer; rows of other layers go.

    The table of probes is a row for each layer, as long as its activations: it goes to every task.
    """
    raw = F.zip_with("weights", "scale", lambda w, s: w / s)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    told = probes.select(F.col("layer").alias("layer_idx"), raw.alias("_w"), (F.col("intercept") - dot(raw, F.col("mean"))).alias("_b"), "slope", "shift")
    out = rows.join(F.broadcast(told), "layer_idx")
    return out.withColumn("margin", dot(F.col("act"), F.col("_w")) + F.col("_b")).drop("_w", "_b")


def probabilities(rows: DataFrame, probes: DataFrame) -> DataFrame:
    """rows with p, the probability of being correct."""
    calibrated = F.coalesce(F.col("slope"), F.lit(1.0)) * F.col("margin") + F.coalesce(F.col("shift"), F.lit(0.0))
    return margins(rows, probes).withColumn("p", 1 / (1 + F.exp(-calibrated))).drop("margin", "slope", "shift")


def accuracy(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def sigmoids(rows: DataFrame, by: str) -> dict[int, tuple[float, float]]:
    """Platt's slope and intercept for each group of rows (``by``, margin, label), with his smoothed targets.

    A step of all groups is one aggregate: a row of sums for each.
    """
    spark = rows.sparkSession
    is_one = F.col("label") == 1
    sizes = {r[by]: (r.pos, r.neg) for r in rows.groupBy(by).agg(F.count_if(is_one).alias("pos"), F.count_if(~is_one).alias("neg")).collect()}
    targets = {k: ((pos + 1) / (pos + 2), 1 / (neg + 2)) for k, (pos, neg) in sizes.items()}
    mean = {k: (pos * targets[k][0] + neg * targets[k][1]) / (pos + neg) for k, (pos, neg) in sizes.items()}
    kind = rows.schema[by].dataType.simpleString()

    def answer(points: dict[int, np.ndarray]) -> dict[int, tuple]:
        asked = [(k, float(a), float(b), *targets[k]) for k, (a, b) in points.items()]
        # A row for each group.
        given = F.broadcast(spark.createDataFrame(asked, f"{by} {kind}, _a double, _b double, _high double, _low double"))
        z = F.col("_a") * F.col("margin") + F.col("_b")
        # The sigmoid and the loss from the exponential of a number that is not positive.
        tail = F.exp(-F.abs(F.col("_z")))
        told = rows.join(given, by).withColumn("_z", z).withColumn("_t", F.when(is_one, F.col("_high")).otherwise(F.col("_low")))
        told = told.withColumn("_p", F.when(F.col("_z") >= 0, 1 / (1 + tail)).otherwise(tail / (1 + tail)))
        m, p, off = F.col("margin"), F.col("_p"), F.col("_p") - F.col("_t")
        loss = F.greatest(F.col("_z"), F.lit(0.0)) - F.col("_t") * F.col("_z") + F.log1p(tail)
        sums = [loss, off * m, off, p * (1 - p) * m * m, p * (1 - p) * m, p * (1 - p)]
        return {r[0]: (r[1], r[2:4], r[4:7]) for r in told.groupBy(by).agg(*[F.avg(x) for x in sums]).collect()}

    return together({k: newton_sigmoid(mean[k]) for k in sizes}, answer)


def platt(rows: DataFrame) -> tuple[float, float]:
    """Slope and intercept of a sigmoid on the margin; columns margin, label."""
    return sigmoids(staged(rows.select(F.lit(0).alias("layer_idx"), "margin", "label"), "margins"), "layer_idx")[0]


def train(activations: DataFrame, labels: DataFrame, layers: list[int] | None = None, calibrated: bool = False, seed: int = SEED, test_share: float = TEST_SHARE) -> list[Probe]:
    """A probe for each layer; all share one stratified split. labels: task_id and label (1: correct).

    Calibrated: of the training part, a share fits the sigmoid only, while the scaler sees all of it.
    """
    spark = activations.sparkSession
    split = stratified_split(labels.select("task_id", F.col("label").cast("double").alias("label")), test_share, seed=seed)
    split = split.withColumnRenamed("held", "test")
    if calibrated:
        inner = stratified_split(split.where("not test"), CALIBRATION_SHARE, seed=seed + 1).select("task_id", F.col("held").alias("calibration"))
        split = split.join(inner, "task_id", "left")
    else:
        split = split.withColumn("calibration", F.lit(False))
    split = split.withColumn("calibration", F.coalesce("calibration", F.lit(False)))
    wanted = activations if layers is None else activations.where(F.col("layer_idx").isin(layers))
    rows = wanted.where("act is not null").join(split, "task_id").select(F.col("layer_idx").cast("int").alias("layer_idx"), F.col("act").cast("array<double>").alias("act"), "label", "test", "calibration")
    rows = staged(rows, "layers")
    scaled = scales(rows.where("not test"))
    fits = fitted(rows.where("not test and not calibration"), scaled)
    probes = [Probe(k, scaled[k][0].tolist(), scaled[k][1].tolist(), w[:-1].tolist(), float(w[-1])) for k, w in sorted(fits.items())]
    if calibrated:
        held = staged(margins(rows.where("calibration"), table(spark, probes)).select("layer_idx", "margin", "label"), "margins")
        for k, (slope, shift) in sigmoids(held, "layer_idx").items():
            next(p for p in probes if p.layer == k).__dict__.update(slope=slope, shift=shift)
        discard(held)
    scored = margins(rows.where("test"), table(spark, probes))
    margin = F.coalesce("slope", F.lit(1.0)) * F.col("margin") + F.coalesce("shift", F.lit(0.0))
    scored = staged(scored.select("layer_idx", "label", margin.alias("margin")).withColumn("prediction", F.when(F.col("margin") > 0, 1.0).otherwise(0.0)), "scored")
    hits = {r.layer_idx: r.accuracy for r in accuracy(scored, "layer_idx").collect()}
    areas = {r.layer_idx: r.auc for r in stats.auc(scored, "label", "margin", "layer_idx").collect()}
    sizes = {r.layer_idx: (r.fit, r.test) for r in rows.groupBy("layer_idx").agg(F.count_if(~F.col("test") & ~F.col("calibration")).alias("fit"), F.count_if("test").alias("test")).collect()}
    for p in probes:
        p.accuracy, p.auc = hits.get(p.layer, math.nan), areas.get(p.layer, 0.5)
        p.n_train, p.n_test = sizes[p.layer]
    discard(rows, scored)
    return probes


def results(spark: SparkSession, probes: list[Probe]) -> DataFrame:
    return spark.createDataFrame([(p.layer, p.accuracy, p.auc, p.n_train, p.n_test) for p in probes], "layer_idx int, accuracy double, auc double, n_train long, n_test long")


def internal_scores(activations: DataFrame, judged: DataFrame, probes: list[Probe]) -> DataFrame:
    """task_id, domain, is_correct, layer_scores and isd_score (their mean) of all rows, training rows included. One pass over the activations."""
    told = probabilities(activations, table(activations.sparkSession, probes))
    scores = told.groupBy("task_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer_idx", "p")))).alias("layer_scores"), F.avg("p").alias("isd_score"))
    return judged.select("task_id", "domain", "is_correct").join(scores, "task_id")


def save(probes: list[Probe], path: str) -> None:
    """The table of probes under the path."""
    table(SparkSession.active(), probes).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> list[Probe]:
    return [Probe(**r.asDict()) for r in spark.read.schema(_TABLE).parquet(path).orderBy("layer").collect()]
