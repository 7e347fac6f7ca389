"""Small tools for fitting linear models on a bounded sample: sparse products and a quasi-Newton search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strata that get the full number of rows in a sample, and the least number for each where there are more.
STRATA, LEAST_EACH = 64, 8
#: Short texts of a stratum with which its long ones are left out.
ENOUGH_SHORT = 100


class Sparse:
    """A matrix by (row, column, value), columns compacted to those that occur."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int):
        self.rows, self.values, self.n_rows = rows, values, n_rows
        self.names, self.columns = np.unique(columns, return_inverse=True)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * weights[self.columns], self.n_rows)

    def transposed(self, per_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * per_row[self.rows], len(self.names))


def minimised(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 80, memory: int = 8) -> np.ndarray:
    """L-BFGS with backtracking; loss gives value and gradient."""
    x = start
    value, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, used = -g, []
        for s, y in reversed(past):
            a = (s @ d) / (y @ s)
            used.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(past, reversed(used)):
            d = d + (a - (y @ d) / (y @ s)) * s
        slope, t = g @ d, 1.0 if past else 1.0 / max(1.0, float(np.abs(g).sum()))
        if slope >= 0:
            d, slope, past = -g, -(g @ g), []
        for _ in range(30):
            new, new_g = loss(x + t * d)
            if new <= value + 1e-4 * t * slope:
                break
            t /= 2
        else:
            return x
        s, y = t * d, new_g - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, g, gained, value = x + s, new_g, value - new, new
        if gained < 1e-7 * max(1.0, abs(value)):
            break
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def sampled(labels: DataFrame, key: str, stratum: str, each: int) -> DataFrame:
    """At most about twice ``each`` rows of every stratum, by a hash of the key, with ``weight``: rows it stands for.

    Of several rows with one key, the least counts.

    No stratum is left out by its rank. With more than STRATA of them each gets fewer rows (LEAST_EACH at least), and
    with so many that even this exceeds ``each`` times STRATA rows (continuous ratings), all shares shrink alike. What is
    returned is bounded, however many labels there are.
    """
    rest = [c for c in labels.columns if c != key]
    labels = labels.where(F.col(key).isNotNull() & F.col(stratum).isNotNull())
    labels = labels.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row")).select(key, "_row.*")
    counts = labels.groupBy(stratum).agg(F.count("*").alias("_n"))
    n, most = counts.count(), each * STRATA
    if not n:
        return labels.withColumn("weight", F.lit(1.0)).limit(0)
    quota = each if n <= STRATA else min(each, max(LEAST_EACH, most // n))
    total = counts.agg(F.sum(F.least(F.col("_n"), F.lit(quota)))).first()[0]
    of = F.least(F.lit(1.0), F.lit(float(quota)) / F.col("_n")) * min(1.0, most / total)
    rows = labels.join(counts, stratum).withColumn("_of", of)
    kept = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000)) < F.col("_of") * 1_000_000)
    return kept.withColumn("weight", 1.0 / F.col("_of")).drop("_n", "_of").orderBy(F.xxhash64(key), key).limit(2 * each * min(n, STRATA))


def labelled_sample(docs: DataFrame, sample: DataFrame, longest: int) -> DataFrame:
    """The sample with texts as bytes, ``long`` ones cut to ``longest`` bytes. The sample is bounded, so it goes to every task.

    Of several texts with one id, the least counts, short ones first, so that what comes back is bounded too. ``settled``
    decides which long ones are used.
    """
    cut = F.struct((F.octet_length("text") > longest).alias("long"), F.substring(F.encode("text", "UTF-8"), 1, longest).alias("text"))
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", cut.alias("_text"))
    mine = texts.join(F.broadcast(sample), "doc_id")
    return mine.groupBy(*sample.columns).agg(F.min("_text").alias("_text")).select(*sample.columns, "_text.*")


def settled(frame: pd.DataFrame, stratum: str, enough: int = ENOUGH_SHORT) -> pd.DataFrame:
    """The rows to fit on: long texts, of which only the beginning is at hand, step in where a stratum has too few short ones.

    The rows that stay also stand for those of their stratum that don't.
    """
    short = (~frame.long).groupby(frame[stratum]).transform("sum")
    kept = frame[~frame.long | (short < enough)]
    whole, left = frame.groupby(stratum).weight.sum(), kept.groupby(stratum).weight.sum()
    return kept.assign(weight=kept.weight * kept[stratum].map(whole / left))


def uncut(text: bytes) -> bytes:
    """Without the rest of a letter that a cut has split."""
    return bytes(text).decode("utf-8", "ignore").encode()
