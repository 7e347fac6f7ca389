"""Mixing sources to target weights by a time-varying curriculum, in DataFrame functions only.

Every source has a schedule: knots (time, weight), linear between them. Its integral is the source's weight, and the
sources share the budget of words by weight; targets stop at a multiple of what their source holds, and the excess is
shared anew. That is a water level, found in one pass over the sources sorted by the weight at which they fill up. The
documents of a source, in an order by a hash of their ids, lie on a line of words, passed over again until the target is
reached; the one in which it is reached is cut there. A word at place c of that line is due when the source's cumulative
demand reaches c: the inverse of the schedule's integral, a root in the segment that holds it. That time is the training
position of the copy of the document that begins there, and documents are sorted by it, dealt by ranges.

Sums over what comes before never gather a source in one task: rows are dealt by ranges of the order, summed within, and
one total for each partition gives the offsets.

Defined cases: a null or empty text has size 0, takes no words and has no position; a null source is a source of its
own, the last; rows without an id, repeated rows and repeated ids are documents each for itself, ordered by size and a
hash of the text where their ids tie; sources whose weight is 0, and all if nothing can be shared, have target 0; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Share of all words that the mix takes, and how often a document is taken at most.
BUDGET, MOST = 1.5, 2
#: The schedules of the query, repeating over the sources: weights at the beginning and at the end, 3, 1 and 2 in the mean.
RAMPS = ((4.5, 1.5), (1.0, 1.0), (1.0, 3.0))
WORD = r"[^\x20\x09-\x0D]+"


def before(df: DataFrame, order: Sequence[Column], name: str, **values: Column) -> DataFrame:
    """df with the sum of each of ``values`` over the rows before its own in the given order, which must tell rows apart."""
    held = {f"_value_{n}": v for n, v in values.items()}
    ranged = written(df.withColumns(held).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    earlier = lambda of: of.rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*[F.sum(v).alias(v) for v in held])
    # One row for each partition, so one window and a broadcast hold them.
    offsets = totals.select("_part", *[F.sum(f"_value_{n}").over(earlier(Window.orderBy("_part"))).alias(f"_offset_{n}") for n in values])
    within = earlier(Window.partitionBy("_part").orderBy(*order))
    sums = ranged.withColumns({n: F.sum(v).over(within) for n, v in zip(values, held)}).join(F.broadcast(offsets), "_part")
    zero = lambda c, n: F.coalesce(c, F.lit(0).cast(ranged.schema[f"_value_{n}"].dataType))
    return sums.withColumns({n: zero(F.col(n), n) + zero(F.col(f"_offset_{n}"), n) for n in values}).drop("_part", *held, *[f"_offset_{n}" for n in values])


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and what orders documents, written: texts are read once."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key, tie = F.unhex(F.md5(F.col("doc_id").cast("string"))), F.xxhash64("text")
    return written(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("_key"), tie.alias("_tie"), F.monotonically_increasing_id().alias("_row")), "sizes")


def in_turn(sources: DataFrame, ramps: Sequence[tuple[float, float]] = RAMPS) -> DataFrame:
    """sources with ``knots``: the ramps in turn, by ``place``, over a time from 0 to 1."""
    knots = [F.array(*[F.struct(F.lit(float(t)).alias("at"), F.lit(float(w)).alias("weight")) for t, w in enumerate(r)]) for r in ramps]
    return sources.withColumn("knots", F.get(F.array(*knots), F.pmod("place", F.lit(len(ramps))).cast("int")))


def segments(knots: Column) -> Column:
    """The linear pieces of a schedule: start, span, weights at both ends, area, and the area before."""
    pairs = F.zip_with(F.slice(knots, 1, F.size(knots) - 1), F.slice(knots, 2, F.size(knots) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    area = lambda p: (p["b"]["at"] - p["a"]["at"]) * (p["a"]["weight"] + p["b"]["weight"]) / 2
    areas = F.transform(pairs, area)

    def piece(p: Column, i: Column) -> Column:
        done = F.aggregate(F.slice(areas, F.lit(1), i), F.lit(0.0), lambda total, x: total + x)
        return F.struct(p["a"]["at"].alias("at"), (p["b"]["at"] - p["a"]["at"]).alias("span"), p["a"]["weight"].alias("first"), p["b"]["weight"].alias("last"), F.get(areas, i).alias("area"), done.alias("before"))

    return F.transform(pairs, piece)


def due(area: Column, pieces: Column) -> Column:
    """The time at which the schedule's integral reaches an area: the inverse, a root in the piece that holds it."""
    held = F.filter(pieces, lambda p: (p["area"] > 0) & (p["before"] <= area))
    p = F.try_element_at(held, F.lit(-1))
    rest = area - p["before"]
    root = F.sqrt(F.greatest(p["first"] * p["first"] + 2 * (p["last"] - p["first"]) / p["span"] * rest, F.lit(0.0)))
    inside = F.coalesce(2 * rest / F.nullif(p["first"] + root, F.lit(0.0)), F.lit(0.0))
    return p["at"] + F.least(inside, p["span"])


def plan(sources: DataFrame, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """sources (source_size, knots) with ``pieces``, ``weight`` and ``target``."""
    room = most * F.col("source_size").cast("double")
    weighed = sources.withColumn("pieces", segments(F.col("knots"))).withColumn("weight", F.aggregate("pieces", F.lit(0.0), lambda total, p: total + p["area"])).drop("knots")
    # Sources in the order in which a rising level fills them; those without weight are never filled.
    ratio = F.try_divide(room, F.col("weight"))
    filling = before(weighed.withColumn("_ratio", ratio), [F.col("_ratio").asc_nulls_last(), F.col("source").asc_nulls_last()], "filling", _filled=room, _weights=F.col("weight"))
    whole = sources.agg((budget * F.sum("source_size").cast("double")).alias("_budget")).crossJoin(F.broadcast(weighed.agg(F.sum("weight").alias("_weight"))))  # one row each
    held = filling.crossJoin(F.broadcast(whole))
    # A source is full if it would be, were just those before it full.
    full = (F.col("weight") > 0) & (room * (F.col("_weight") - F.col("_weights")) <= F.col("weight") * (F.col("_budget") - F.col("_filled")))
    held = written(held.withColumn("_full", full), "filled")
    level = held.agg(
        F.try_divide(F.first("_budget") - F.sum(F.when(F.col("_full"), room).otherwise(0.0)), F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0.0))).alias("_level"),
    )
    target = F.when(F.col("_full"), room).otherwise(F.coalesce(F.least(F.col("weight") * F.col("_level"), room), F.lit(0.0)))
    return held.crossJoin(F.broadcast(level)).withColumn("target", target).select(*sources.drop("knots").columns, "weight", "pieces", "target")


def mix(docs: DataFrame, schedule: Callable[[DataFrame], DataFrame] = in_turn, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, taken and ``copies``: position and words of each pass that takes any.

    schedule: gets the sources (source, source_size, place: 0, 1, ... by code point, null last) and adds ``knots``, an
    array of (at, weight) in order of time, where two of one time make a jump, and no weight is negative.
    """
    rows = sized(docs)
    by_name = [F.col("source").asc_nulls_last()]
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = before(totals, by_name, "sources", place=F.lit(1).cast("long"), _start=F.col("source_size"))
    planned = written(plan(schedule(sources).drop("place"), budget, most), "plan").withColumnRenamed("source", "_source")
    line = before(rows, [*by_name, *[F.col(c) for c in ("_key", "doc_id", "size", "_tie", "_row")]], "lines", _at=F.col("size"))
    told = line.join(planned, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_at", F.col("_at") - F.col("_start"))
    end = F.floor(F.col("target") + 0.5)

    def copy(i: int) -> Column:
        at = F.col("_at") + i * F.col("source_size")
        words = F.least(F.col("size"), end - at)
        return F.struct(due(at * F.col("weight") / F.col("target"), F.col("pieces")).alias("position"), words.alias("words"))

    some = F.when(F.col("target") > 0, F.filter(F.array(*[copy(i) for i in range(most)]), lambda c: c["words"] > 0))
    told = told.withColumn("copies", F.coalesce(some, F.array().cast("array<struct<position:double,words:bigint>>")))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"])
    return told.select("doc_id", "source", "size", "source_size", "weight", "target", taken.alias("taken"), "copies")


def curriculum(mixed: DataFrame) -> DataFrame:
    """A row for each copy that is taken (position, doc_id, source, words), sorted by position."""
    return mixed.select(F.explode("copies").alias("c"), "doc_id", "source").select("c.position", "doc_id", "source", "c.words").orderBy("position", "doc_id")


def digests(mixed: DataFrame) -> DataFrame:
    """A row for each document, with the positions of its first and second copy, sorted by the first."""
    at = lambda i: F.get("copies", F.lit(i))["position"]
    out = mixed.select("doc_id", "size", "source_size", "target", "taken", at(0).alias("position"), at(1).alias("again"))
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS room, CASE turn WHEN 0 THEN 4.5::DOUBLE ELSE 1.0::DOUBLE END AS w0,
    CASE turn WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 3.0::DOUBLE END AS w1, CASE turn WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM s),
f AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS budget, sum(weight) OVER () AS weights,
    coalesce(sum(room) OVER o, 0) AS filled, coalesce(sum(weight) OVER o, 0) AS passed
  FROM w WINDOW o AS (ORDER BY room / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, room * (weights - passed) <= weight * (budget - filled) AS is_full FROM f),
l AS (SELECT (max(budget) - coalesce(sum(room) FILTER (is_full), 0)) / nullif(coalesce(sum(weight) FILTER (NOT is_full), 0), 0) AS level FROM g),
t AS (SELECT g.*, CASE WHEN is_full THEN room ELSE coalesce(least(weight * level, room), 0) END AS target FROM g CROSS JOIN l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.w0, t.w1, t.weight, floor(t.target + 0.5) AS stop,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (
  SELECT *, greatest(0, least(size, stop - c)) AS once, greatest(0, least(size, stop - (c + source_size))) AS twice,
    c * weight / target AS y1, (c + source_size) * weight / target AS y2
  FROM p)
SELECT doc_id, size, source_size, target, CAST(once + twice AS BIGINT) AS taken,
  CASE WHEN once > 0 THEN least(2 * y1 / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * y1, 0))), 1) END AS position,
  CASE WHEN twice > 0 THEN least(2 * y2 / (w0 + sqrt(greatest(w0 * w0 + 2 * (w1 - w0) * y2, 0))), 1) END AS again
FROM x
"""
