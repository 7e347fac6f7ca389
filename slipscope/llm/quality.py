"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of hashed-text weights is shared by all grades; ordered thresholds cut the line: P(grade <= j) =
logistic(threshold_j - w.x). Features are relative frequencies of hashed byte trigrams, hashed lower-case words, and
marks of words (same as the one before, all capitals, with symbols, very long). From the fitted model every document
gets its expected grade and the tail probability of reaching the selection grade.

The model is fitted in one task on a bounded sample of labelled rows: about SAMPLE_EACH texts of each grade (fewer
where there are more than 64 grades), weighted back to the grades' shares. Texts longer than SAMPLE_BYTES bytes are used where
their grade has fewer than 100 short ones, and only their beginning is. Scoring reads all documents and whole texts.

Defined cases: a null text counts as an empty one and has no features (the thresholds alone decide); with fewer than
two grades there is nothing to learn and every document gets the only grade (0 if none) with tail probability 1;
repeated labels of a document count once, labels without id or with a grade that is null or not a finite number not at all; repeated rows are scored each for
itself; an empty table gives an empty one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .fitting import Sparse, labelled_sample, minimised, sampled, settled, sigmoid, uncut
from .shared import bounded_batches, frugal, text_portions

#: Texts of each grade that the fit may see, and their greatest length in bytes.
SAMPLE_EACH, SAMPLE_BYTES = 1_000, 16_384
#: Weights, as a power of two; strength of the penalty on them; and the scale of relative frequencies.
BITS, PENALTY, SCALE = 18, 3e-4, 10.0
#: Least tail probability of a document that is selected.
SELECT = 0.5
MARKS = 4


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group of features: the hashed feature at each place, and where each text's begin (and one more)."""
    data, offsets = tb.joined(texts)
    shift = np.uint64(64 - BITS)
    if not len(data):
        return []
    wide = data.astype(np.uint64)
    three = (wide[2:] | wide[1:-1] << np.uint64(8) | wide[:-2] << np.uint64(16)) if len(data) > 2 else np.empty(0, np.uint64)
    # Trigrams inside a text and its closing blank; a text shorter than two bytes has none.
    first = np.minimum(offsets, len(three))
    trigrams = (tb.mix(three + np.uint64(1)) >> shift).astype(np.int64)
    last = np.minimum(np.maximum(offsets[1:] - 2, offsets[:-1]), len(three))
    keep = np.zeros(len(three) + 1, np.int64)
    np.add.at(keep, first[:-1], 1)
    np.add.at(keep, last, -1)
    inside = np.cumsum(keep)[:-1] > 0
    counts = np.concatenate([[0], np.cumsum(last - first[:-1])])
    lowered = tb.runs(tb.LOWER[data], offsets, ~tb.WHITE[data])
    h = lowered.hashes()
    # Marks, on the text as it is.
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    odd = np.concatenate([[0], np.cumsum((data < 128) & (data > 32) & ~_PLAIN[data])])
    b, e = lowered.begin, lowered.end
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    starts = lowered.first[:-1]
    same[starts[starts < len(h)]] = False
    marks = [same, (upper[e] - upper[b] >= 2) & (small[e] == small[b]), odd[e] > odd[b], e - b > 24]
    groups = [(trigrams[inside], counts), ((tb.mix(h + np.uint64(7)) >> shift).astype(np.int64), lowered.first)]
    for i, mark in enumerate(marks):
        groups.append((np.where(mark, (1 << BITS) + i, -1), lowered.first))
    return groups


_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, ".,;:'\"-()?")]] = True


@dataclass
class Ordinal:
    grades: list[float]
    thresholds: np.ndarray
    weights: np.ndarray

    def line(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros(len(texts))
        table = np.append(self.weights, 0.0)
        for hashed, first in features(texts):
            n = np.maximum(np.diff(first), 1)
            total += SCALE * tb.sums(table[hashed], first) / n
        return total

    def upto(self, texts: list[bytes]) -> np.ndarray:
        """P(grade <= j) for all grades but the last, one row for each text."""
        return sigmoid(self.thresholds[None, :] - self.line(texts)[:, None])

    def scores(self, texts: list[bytes], from_grade: float) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of a grade of at least ``from_grade``."""
        if len(self.grades) < 2:
            only = self.grades[0] if self.grades else 0.0
            return np.full(len(texts), only), np.full(len(texts), float(not self.grades or only >= from_grade))
        below = np.concatenate([np.zeros((len(texts), 1)), self.upto(texts), np.ones((len(texts), 1))], 1)
        grades = np.array(self.grades)
        return np.diff(below, axis=1) @ grades, 1 - below[:, int(np.searchsorted(grades, from_grade))]


def fit(texts: list[bytes], ratings: np.ndarray, weights: np.ndarray) -> Ordinal:
    grades = sorted(set(ratings.tolist()))
    if len(grades) < 2:
        return Ordinal(grades, np.empty(0), np.zeros((1 << BITS) + MARKS))
    y, n, cuts = np.searchsorted(grades, ratings), len(texts), len(grades) - 1
    weights = weights / weights.sum()
    rows, columns, values = [], [], []
    # Portions bound what the places of features take; texts stay whole.
    for p in text_portions(texts):
        for hashed, first in features(texts[p]):
            counts = np.diff(first)
            owner = np.repeat(np.arange(len(counts)), counts)
            some = hashed >= 0
            cell, times = np.unique(owner[some] * (1 << (BITS + 1)) + hashed[some], return_counts=True)
            mine = cell >> (BITS + 1)
            rows.append(mine + p.start)
            columns.append(cell & ((1 << (BITS + 1)) - 1))
            values.append(SCALE * times / np.maximum(counts, 1)[mine])
    if not rows:
        rows, columns, values = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    x = Sparse(np.concatenate(rows), np.concatenate(columns), np.concatenate(values), n)

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        # Thresholds are the first and then growing by exponentials, so that they stay in order.
        w, gaps = p[cuts:], np.exp(np.clip(p[1:cuts], -20, 20))
        theta = np.concatenate([[p[0]], p[0] + np.cumsum(gaps)])
        edge = np.concatenate([[-np.inf], theta, [np.inf]])
        line = x.times(w)
        with np.errstate(over="ignore", invalid="ignore"):
            hi, lo = sigmoid(edge[y + 1] - line), sigmoid(edge[y] - line)
        hi[y == cuts], lo[y == 0] = 1.0, 0.0
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = weights * hi * (1 - hi) / prob, weights * lo * (1 - lo) / prob
        g_theta = np.array([d_lo[y == j + 1].sum() - d_hi[y == j].sum() for j in range(cuts)])
        later = np.cumsum(g_theta[::-1])[::-1]
        g = np.concatenate([[later[0]], later[1:] * gaps, x.transposed(d_hi - d_lo) + 2 * PENALTY * w])
        return float(-(weights * np.log(prob)).sum() + PENALTY * (w @ w)), g

    share = np.cumsum(np.bincount(y, weights, cuts + 1))[:cuts]
    theta = np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
    start = np.concatenate([[theta[0]], np.log(np.maximum(np.diff(theta), 1e-3)), np.zeros(len(x.names))])
    p = minimised(loss, start)
    out = np.zeros((1 << BITS) + MARKS)
    out[x.names] = p[cuts:]
    return Ordinal(grades, np.concatenate([[p[0]], p[0] + np.cumsum(np.exp(p[1:cuts]))]), out)


def learn(docs: DataFrame, labels: DataFrame, grade: str = "quality", each: int = SAMPLE_EACH) -> Ordinal:
    value = F.col(grade).cast("double")
    ratings = labels.select("doc_id", value.alias("grade")).where(F.abs("grade") < float("inf"))
    sample = labelled_sample(docs, sampled(ratings, "doc_id", "grade", each), SAMPLE_BYTES)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = settled(frame.sort_values(["doc_id", "text"]), "grade")
        model = fit([uncut(t) for t in frame.text], frame.grade.to_numpy(), frame.weight.to_numpy())
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    fitted = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").collect()
    return pickle.loads(fitted[0].model) if fitted else Ordinal([], np.empty(0), np.zeros((1 << BITS) + MARKS))


def score(df: DataFrame, model: Ordinal, text: str = "text", from_grade: float | None = None, select: float = SELECT) -> DataFrame:
    """df with expected_grade, tail_prob (of the selection grade, by default the lowest but one) and selected.

    Columns of df with these names are replaced.
    """
    df = df.drop("expected_grade", "tail_prob", "selected")
    bounded_batches(df.sparkSession)
    target = from_grade if from_grade is not None else (model.grades[1] if len(model.grades) > 1 else (model.grades or [0.0])[0])
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema) + "expected_grade double, tail_prob double, selected boolean"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.encoded(batch.column(names.index(text)).to_pylist())
            for p in text_portions(texts):
                grade, tail = shared.value.scores(texts[p], target)
                some = batch.slice(p.start, p.stop - p.start).columns
                yield pa.RecordBatch.from_arrays([*some, pa.array(grade), pa.array(tail), pa.array(tail >= select)], names=[*names, "expected_grade", "tail_prob", "selected"])

    return df.mapInArrow(run, schema)


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_prob and selected of every document."""
    return score(docs.select("doc_id", "text"), learn(docs, labels)).drop("text")
