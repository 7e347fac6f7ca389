"""Exact medians without sorting and without gathering values in one task.

A value range is narrowed by histograms. Each pass counts the rows of every bin of the range that still holds the wanted
rank, and takes the least and the greatest value in each; the bin that holds the rank gives the next range. A range ends
when its least and greatest value are one. Since these fall into different bins as long as they differ, every pass narrows
the range, by BINS for values that are spread evenly: a thousand million scores take three passes. Rows are grouped by
bin, never by value, so ties cost nothing; what reaches the driver is a row for each bin of two ranges for each column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import discard, staged

BINS = 4_096


@dataclass
class Search:
    """The value of one rank (from 1) of a column: it lies in [low, high], and ``before`` rows lie below low."""

    column: str
    rank: int
    low: float
    high: float
    before: int

    @property
    def span(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high


def _bin(x: Column, low: float, high: float) -> Column:
    # Halves, where the difference itself is too large for a double.
    less = 1.0 if math.isfinite(high - low) else 0.5
    return F.least(F.floor((x * less - low * less) / (high * less - low * less) * BINS), F.lit(BINS - 1)).cast("int")


def _histograms(df: DataFrame, spans: list[tuple[str, float, float]]) -> dict[tuple[str, float, float], list]:
    """For each span its bins that hold rows, in order: rows, least and greatest value."""
    cells = [F.when(F.col(c).between(low, high), F.struct(F.lit(i).alias("span"), _bin(F.col(c), low, high).alias("bin"), F.col(c).alias("x"))) for i, (c, low, high) in enumerate(spans)]
    rows = df.select(F.explode(F.array_compact(F.array(*cells))).alias("cell")).select("cell.*")
    bins = rows.groupBy("span", "bin").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    out: dict[tuple[str, float, float], list] = {s: [] for s in spans}
    for b in sorted(bins, key=lambda b: (b.span, b.bin)):
        out[spans[b.span]].append(b)
    return out


def _narrowed(s: Search, bins: list) -> Search:
    before = s.before
    for b in bins:
        if before + b.n >= s.rank:
            return Search(s.column, s.rank, b.low, b.high, before)
        before += b.n
    raise ValueError(f"rows of {s.column} changed between passes")


def ranked_values(df: DataFrame, wanted: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """The values at the wanted ranks (from 1, smallest first) of double columns; nulls have no rank, NaN is greatest."""
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    finite = lambda c: number(c) & (F.abs(c) < math.inf)
    columns = list(wanted)
    figures = []
    for c in columns:
        figures += [F.count_if(F.col(c) == -math.inf), F.count_if(finite(c)), F.count_if(number(c) & (F.col(c) == math.inf)), F.min(F.when(finite(c), F.col(c))), F.max(F.when(finite(c), F.col(c)))]
    first = df.agg(*figures).first() if figures else ()
    found: dict[tuple[str, int], float] = {}
    searches: list[Search] = []
    for i, c in enumerate(columns):
        lowest, between, highest, low, high = first[5 * i : 5 * i + 5]
        for k in wanted[c]:
            if lowest < k <= lowest + between:
                searches.append(Search(c, k, low, high, lowest))
            else:
                found[c, k] = -math.inf if k <= lowest else math.inf if k <= lowest + between + highest else math.nan
    while True:
        found |= {(s.column, s.rank): s.low for s in searches if s.low == s.high}
        searches = [s for s in searches if s.low != s.high]
        if not searches:
            return found
        bins = _histograms(df, sorted({s.span for s in searches}))
        searches = [_narrowed(s, bins[s.span]) for s in searches]


def medians(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the median of each column; the mean of the middle two for even counts, null for none, NaN counts as greatest."""
    spark = df.sparkSession
    # Passes read these few columns, not what they were made of.
    rows = staged(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "selection")
    counts = rows.agg(*[F.count(c) for c in columns]).first()
    middles = {c: sorted({(n + 1) // 2, n // 2 + 1}) for c, n in zip(columns, counts) if n}
    values = ranked_values(rows, middles)
    discard(rows)
    middle = {c: [values[c, k] for k in ks] for c, ks in middles.items()}
    row = tuple(middle[c][0] / 2 + middle[c][-1] / 2 if c in middle else None for c in columns)
    return spark.createDataFrame([row], ", ".join(f"`{c}` double" for c in columns))
