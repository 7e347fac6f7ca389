"""Toxicity by classifier chains.

Categories are predicted one after the other. Each has a linear model over hashed words and beginnings of words (4, 5
and 6 bytes; each counts once in a text), and the log-odds of all earlier categories as further features. For training,
those come from models that didn't see the text (out-of-fold predictions, FOLDS folds by a hash of the id); for
scoring, from the models fitted on the whole sample. Features are picked by their association with the category in
the sample: seen in LEAST_TEXTS texts and LEAST_SHARE of them or more, and their share of texts with the category
differing from that of texts without by LEAST_Z standard errors. Near copies in the sample count once.

The models are fitted in one task on a bounded sample of labelled rows: about SAMPLE_EACH texts of each combination of
categories, weighted back. Texts longer than SAMPLE_BYTES bytes are used where their combination has fewer than 100 short
ones, and only their beginning is. Scoring reads all documents and whole texts.

Defined cases: a null text counts as an empty one; a category with only one value in the sample has a constant
probability near its share; repeated labels of a document count once, labels with nulls not at all; repeated rows are
scored each for itself; an empty table gives an empty one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .fitting import Sparse, labelled_sample, minimised, sampled, settled, sigmoid, uncut
from .shared import bounded_batches, frugal, text_portions

SAMPLE_EACH, SAMPLE_BYTES = 2_000, 16_384
BITS, PENALTY, FOLDS = 20, 1e-5, 5
LEAST_TEXTS, LEAST_SHARE, LEAST_Z = 4, 0.005, 5.0
#: Probability from which a text has a category.
FLAG = 0.5

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Text and feature of every place; a feature may occur more than once."""
    data, offsets = tb.joined(texts)
    w = tb.runs(tb.LOWER[data], offsets, _LETTERS[data])
    if not len(w.begin):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shift, owner = np.uint64(64 - BITS), w.owner()
    rows, columns = [owner], [tb.mix(w.hashes() + np.uint64(3)) >> shift]
    packed = np.zeros(len(w.begin), np.uint64)
    length = w.end - w.begin
    for i in range(6):
        some = length > i
        packed[some] |= w.data[w.begin[some] + i].astype(np.uint64) << np.uint64(8 * i)
        if i >= 3:
            long = length > i
            rows.append(owner[long])
            columns.append(tb.mix(packed[long] + np.uint64(i << 56)) >> shift)
    return np.concatenate(rows), np.concatenate(columns).astype(np.int64)


@dataclass
class Link:
    """One category's model."""

    name: str
    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        rows, columns = hashed(texts)
        known = np.zeros(1 << BITS, bool)
        for link in self.links:
            known[link.features] = True
        some = known[columns]
        cell = np.unique((rows[some] << BITS) | columns[some])
        rows, columns = cell >> BITS, cell & ((1 << BITS) - 1)
        return _run(self.links, rows, columns, len(texts))


def _run(links: list[Link], rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """Probabilities of the chain, one column for each link; (row, column) without repeats."""
    odds = np.zeros((n, len(links)))
    for j, link in enumerate(links):
        table = np.zeros(1 << BITS)
        table[link.features] = link.weights
        odds[:, j] = np.bincount(rows, table[columns], n) + odds[:, :j] @ link.earlier + link.bias
        odds[:, j] = np.clip(odds[:, j], -30, 30)
    return sigmoid(odds)


def fit_link(name: str, rows: np.ndarray, columns: np.ndarray, y: np.ndarray, weight: np.ndarray, earlier: np.ndarray) -> Link:
    """earlier: log-odds of earlier categories, one column each."""
    n, share = len(y), float((weight * y).sum() / max(weight.sum(), 1e-9))
    none = Link(name, np.empty(0, np.int64), np.empty(0), np.zeros(earlier.shape[1]), float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5))))
    if not n or y.min() == y.max():
        return none
    with_, without = np.bincount(columns[y[rows] == 1], minlength=1 << BITS), np.bincount(columns[y[rows] == 0], minlength=1 << BITS)
    n1, n0, either = y.sum(), n - y.sum(), with_ + without
    spread = np.sqrt(np.maximum(either / n * (1 - either / n), 1e-12) * (1 / n1 + 1 / n0))
    z = (with_ / n1 - without / n0) / spread
    picked = np.flatnonzero((either >= max(LEAST_TEXTS, LEAST_SHARE * n)) & (np.abs(z) >= LEAST_Z))
    keep = np.isin(columns, picked)
    x = Sparse(np.append(rows[keep], 0), np.append(columns[keep], 0), np.append(np.ones(int(keep.sum())), 0.0), n)
    share_of = weight / weight.sum()

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, v = p[1 : 1 + len(x.names)], p[1 + len(x.names) :]
        line = p[0] + x.times(w) + earlier @ v
        prob = sigmoid(line)
        cost = float((share_of * (np.logaddexp(0, line) - y * line)).sum() + PENALTY * (w @ w + v @ v))
        d = share_of * (prob - y)
        return cost, np.concatenate([[d.sum()], x.transposed(d) + 2 * PENALTY * w, earlier.T @ d + 2 * PENALTY * v])

    p = minimised(loss, np.concatenate([[none.bias], np.zeros(len(x.names) + earlier.shape[1])]))
    return Link(name, x.names, p[1 : 1 + len(x.names)], p[1 + len(x.names) :], float(p[0]))


def without_copies(texts: list[bytes]) -> np.ndarray:
    """Indices of texts that share neither of two least hashes of five-word groups with an earlier one."""
    w = tb.words(texts)
    grams, seen, out = tb.windows(w.hashes(), 5), set(), []
    for i, (lo, hi) in enumerate(zip(w.first, w.first[1:])):
        mine = grams[lo : max(lo, hi - 4)]
        names = {int(mine.min()), int(tb.mix(mine).min())} if len(mine) else {("short", texts[i])}
        if not names & seen:
            out.append(i)
        seen |= names
    return np.array(out, np.int64)


def fit(texts: list[bytes], keys: np.ndarray, labels: np.ndarray, weight: np.ndarray, names: list[str]) -> Chain:
    """labels: one 0/1 column for each category, in the order of the chain."""
    first = without_copies(texts)
    texts, keys, labels, weight = [texts[i] for i in first], keys[first], labels[first], weight[first]
    n = len(texts)
    rows, columns = hashed(texts)
    cell = np.unique((rows << BITS) | columns)
    rows, columns = cell >> BITS, cell & ((1 << BITS) - 1)
    fold = (tb.mix(keys.astype(np.int64).astype(np.uint64)) % np.uint64(FOLDS)).astype(int)
    unseen = np.zeros((n, len(names)))
    chain = Chain()
    for j, name in enumerate(names):
        earlier = unseen[:, :j]
        chain.links.append(fit_link(name, rows, columns, labels[:, j], weight, earlier))
        for f in range(FOLDS):
            train, test = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            if not len(train) or not len(test):
                continue
            place = np.full(n, -1)
            place[train] = np.arange(len(train))
            mine = place[rows] >= 0
            link = fit_link(name, place[rows[mine]], columns[mine], labels[train, j], weight[train], earlier[train])
            table = np.zeros(1 << BITS)
            table[link.features] = link.weights
            odds = np.bincount(rows, table[columns], n) + earlier @ link.earlier + link.bias
            unseen[test, j] = np.clip(odds[test], -30, 30)
    return chain


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], each: int = SAMPLE_EACH) -> Chain:
    """categories: name to a boolean column of labels, in the order of the chain."""
    names = list(categories)
    marks = labels.select("doc_id", *[c.cast("int").alias(f"_c{i}") for i, c in enumerate(categories.values())]).dropna()
    marks = marks.withColumn("_all", F.concat_ws(",", *[f"_c{i}" for i in range(len(names))]))
    sample = labelled_sample(docs, sampled(marks, "doc_id", "_all", each), SAMPLE_BYTES)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = settled(frame.sort_values(["doc_id", "text"]), "_all")
        y = frame[[f"_c{i}" for i in range(len(names))]].to_numpy()
        return pd.DataFrame({"chain": [pickle.dumps(fit([uncut(t) for t in frame.text], frame.doc_id.to_numpy(), y, frame.weight.to_numpy(), names))]})

    fitted = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "chain binary").collect()
    return pickle.loads(fitted[0].chain) if fitted else Chain([Link(n, np.empty(0, np.int64), np.empty(0), np.zeros(j), -30.0) for j, n in enumerate(names)])


def score(df: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """df with p_<category> of each category, in place of columns of these names."""
    bounded_batches(df.sparkSession)
    new = [f"p_{x.name}" for x in chain.links]
    df = df.drop(*new)
    shared, names = df.sparkSession.sparkContext.broadcast(chain), df.columns
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema) + ", ".join(f"`{n}` double" for n in new)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tb.encoded(batch.column(names.index(text)).to_pylist())
            for some in text_portions(texts):
                p = shared.value.probabilities(texts[some])
                yield pa.RecordBatch.from_arrays([*batch.slice(some.start, some.stop - some.start).columns, *(pa.array(p[:, j]) for j in range(len(new)))], names=[*names, *new])

    return df.mapInArrow(run, schema)


def categories() -> dict[str, Column]:
    """The chain of the query: toxic at all, then toxic inside text of the lowest grade."""
    return {"toxic": F.col("toxic") == 1, "toxic_low_grade": (F.col("toxic") == 1) & (F.col("quality") == 0)}


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_toxic, p_toxic_low_grade and toxic of every document."""
    out = score(docs.select("doc_id", "text"), learn(docs, labels, categories())).drop("text")
    return out.withColumn("toxic", F.col("p_toxic") >= FLAG)
