"""Language identification by prediction by partial matching.

For each language, byte contexts of length 0 to ORDER with the counts of what followed them are learned and frozen. A
text's code length under a language is the exact sum over its bytes: a byte seen after the longest known context costs
-log2(c / (n + t)); a context that never saw it costs the escape -log2(t / (n + t)) and the next shorter one is
tried; a byte unknown everywhere costs 8 bits more (n: how often the context came, t: how many different bytes
followed, c: how often this one). The language with the shortest code wins; the score is its share of the
probability, all languages being equally likely beforehand.

Every language with a labelled text is learned, from a sample of TOTAL_BYTES bytes at most over all languages: whole
texts of at most SAMPLE_BYTES bytes, SAMPLE_TEXTS of them at most for each language, picked by a hash of their id; where a
language has too few of these, the first SAMPLE_BYTES bytes of longer ones too. The more languages, the fewer texts for
each (one at least), and with more than TOTAL_BYTES / SAMPLE_BYTES languages, the fewer bytes of a text.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be
learned; ties go to the language name that sorts first; repeated rows are predicted each for itself; rows whose
language or id is null teach nothing; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import bounded_batches, frugal, text_portions

#: Longest context, in bytes.
ORDER = 4
#: Bounds of the sample.
TOTAL_BYTES, SAMPLE_TEXTS, SAMPLE_BYTES = 1 << 28, 256, 16_384
#: Entries of each worker's table of code lengths, as a power of two; and code lengths held at once, in the table (whose
#: entries become fewer with many languages) and in the texts at hand.
TABLE_BITS, CELLS = 20, 1 << 22
U = np.uint64


def grams(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, it and the bytes before it as one number, the byte itself lowest."""
    out = data.astype(np.uint64)
    for back in range(1, order + 1):
        out[back:] |= data[:-back].astype(np.uint64) << U(8 * back)
    return out


def padded(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts, each after ``order`` zero bytes; where each begins and ends."""
    gap = b"\0" * order
    data = np.frombuffer(gap + gap.join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lengths + order) - lengths
    return data, begin, begin + lengths


class Model:
    """Frozen counts of one language, as sorted arrays for each order."""

    def __init__(self, language: str, texts: list[bytes], order: int = ORDER):
        self.language, self.order = language, order
        data, begin, end = padded(texts, order)
        inside = np.zeros(len(data) + 1, np.int64)
        np.add.at(inside, begin, 1)
        np.add.at(inside, end, -1)
        every = grams(data, order)[np.cumsum(inside)[:-1] > 0]
        self.levels = []
        for o in range(order + 1):
            keys, counts = np.unique(every & U(256 ** (o + 1) - 1), return_counts=True)
            contexts, first = np.unique(keys >> U(8), return_index=True)
            n = np.add.reduceat(counts, first) if len(keys) else counts
            t = np.diff(np.append(first, len(keys)))
            self.levels.append((keys, counts.astype(np.float64), contexts, n.astype(np.float64), t.astype(np.float64)))

    def code_lengths(self, windows: np.ndarray) -> np.ndarray:
        """Bits for the lowest byte of each window after the others."""
        bits, open_ = np.zeros(len(windows)), np.ones(len(windows), bool)
        for o in range(self.order, -1, -1):
            keys, counts, contexts, n, t = self.levels[o]
            if not len(keys):
                continue
            window = windows & U(256 ** (o + 1) - 1)
            at = np.minimum(np.searchsorted(keys, window), len(keys) - 1)
            context = window >> U(8)
            where = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            known = open_ & (contexts[where] == context)
            seen = known & (keys[at] == window)
            total = n[where] + t[where]
            bits[seen] -= np.log2(counts[at] / total)[seen]
            escaped = known & ~seen
            bits[escaped] -= np.log2(t[where] / total)[escaped]
            open_ &= ~seen
        bits[open_] += 8
        return bits


class Coder:
    """Code lengths of all models for whole texts; windows met before are kept in a table of fixed size."""

    def __init__(self, models: list[Model], bits: int = TABLE_BITS):
        bits = max(1, min(bits, (CELLS // len(models)).bit_length() - 1))
        self.models, self.shift = models, U(64 - bits)
        self.keys = np.full(1 << bits, 2**64 - 1, np.uint64)
        self.values = np.zeros((1 << bits, len(models)))

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Bits, one row for each text and one column for each model."""
        data, begin, end = padded(texts)
        window = grams(data)
        # Sums up to where each text begins and ends, over portions of windows.
        marks, total = np.concatenate([begin, end]), np.zeros(len(self.models))
        out, step = np.zeros((len(marks), len(self.models))), max(1, CELLS // len(self.models))
        for lo in range(0, len(window), step):
            bits = self._windows(window[lo : lo + step])
            sums = np.concatenate([total[None, :], bits]).cumsum(0)
            here = (marks >= lo) & (marks <= lo + len(bits))
            out[here], total = sums[marks[here] - lo], sums[-1]
        return out[len(begin) :] - out[: len(begin)]

    def _windows(self, window: np.ndarray) -> np.ndarray:
        slot = (window * U(0x9E3779B97F4A7C15)) >> self.shift
        missed = np.flatnonzero(self.keys[slot] != window)
        bits = self.values[slot]
        if len(missed):
            fresh, back = np.unique(window[missed], return_inverse=True)
            lengths = np.stack([m.code_lengths(fresh) for m in self.models], 1)
            bits[missed] = lengths[back]
            at = (fresh * U(0x9E3779B97F4A7C15)) >> self.shift
            # Two new windows of one slot: the later wins both arrays, as positions are the same.
            at, last = np.unique(at[::-1], return_index=True)
            self.keys[at], self.values[at] = fresh[::-1][last], lengths[::-1][last]
        return bits


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> list[Model]:
    """Models from a bounded sample of the rows."""
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("h")).where(
        "lang is not null and text is not null and text rlike '\\\\p{L}'"
    )
    short = F.octet_length("text") <= SAMPLE_BYTES
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(short).alias("short")).collect()
    if not counts:
        return []
    each = max(1, min(SAMPLE_TEXTS, TOTAL_BYTES // (len(counts) * SAMPLE_BYTES)))
    longest = max(1, min(SAMPLE_BYTES, TOTAL_BYTES // len(counts)))
    # A first cut by the hash alone leaves a few times the sample, however many rows a language has.
    first = lambda n: min(1.0, max(4.0 * each, 64.0) / max(n, 1))
    shares = [(r.lang, first(r.short), first(r.n - r.short) if r.short < each else 0.0) for r in counts]
    shares = labelled.sparkSession.createDataFrame(shares, "lang string, of_short double, of_long double")
    rows = rows.withColumn("lang", F.col("lang").cast("string")).withColumn("long", ~short).join(F.broadcast(shares), "lang")
    rows = rows.where(F.pmod("h", F.lit(1_000_000)) < F.when(F.col("long"), F.col("of_long")).otherwise(F.col("of_short")) * 1_000_000)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "text"))
    rows = rows.select("lang", "long", "h", F.substring(F.encode("text", "UTF-8"), 1, longest).alias("text"))
    sample = rows.withColumn("rank", rank).where(F.col("rank") <= each)

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        import pickle

        # A cut may have split the last letter.
        texts = [bytes(t).decode("utf-8", "ignore").encode() for t in frame.sort_values(["rank"]).text]
        return pd.DataFrame({"lang": [frame.lang.iloc[0]], "model": [pickle.dumps(Model(frame.lang.iloc[0], texts))]})

    import pickle

    fitted = sample.groupBy("lang").applyInPandas(fit, "lang string, model binary").collect()
    return [pickle.loads(r.model) for r in sorted(fitted, key=lambda r: r.lang)]


def predict(df: DataFrame, models: list[Model], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, lang_pred and score for every row of df."""
    spark = df.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    kept = [df[c].alias(f"_id_{i}") for i, c in enumerate(keep)]
    names = [f"_id_{i}" for i in range(len(keep))]
    rows = df.select(*kept, F.when(value.rlike(r"\p{L}"), value).alias("_id_text"))
    restore = [F.col(n).alias(c) for n, c in zip(names, keep)]
    if not models:
        return rows.select(*restore, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(models)
    schema = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep)) + "lang_pred string, score double"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        languages = [m.language for m in shared.value]
        for batch in batches:
            given = batch.column(len(names)).to_pylist()
            pred, score = ["und"] * len(given), np.zeros(len(given))
            which = [i for i, t in enumerate(given) if t is not None]
            texts = [given[i].encode("utf-8", "replace") for i in which]
            for p in text_portions(texts):
                some, bits = which[p], coder.texts(texts[p])
                best = bits.argmin(1)
                odds = np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000)).sum(1)
                for j, i in enumerate(some):
                    pred[i], score[i] = languages[best[j]], 1 / odds[j]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(pred), pa.array(score)], names=[*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema).select(*restore, "lang_pred", "score")


def held_out(key: str | Column = "doc_id") -> Column:
    """One row in five, by the CRC-32 of the id as text; false for a null id."""
    return F.coalesce(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % 5 == 0, F.lit(False))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned on the rows that aren't held out."""
    models = learn(docs.where(F.col("doc_id").isNotNull() & ~held_out()))
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    return predict(rows, models, keep=("doc_id", "held_out"))
