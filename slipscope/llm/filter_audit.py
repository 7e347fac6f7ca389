"""Filter interaction audit by adjacent transpositions.

Every document gets a mask, one bit for each filter that it fails. Counts of documents by part and mask are all that the
audit needs. All orders of the filters are then visited by single swaps of neighbours (plain changes): a swap at places i
and i + 1 leaves every other step as it was, so only those two are counted anew, from the mask cells. A filter's removals
are added up along the walk, each as often as its step stands unchanged, which gives its Shapley sum over all orders.

The masks take whole texts and one narrow row for each document; equal texts are told by SHA-256. Rows are joined on
(digest, id) and on id, never on the digest alone, so that a text with many copies is spread over tasks.

Defined cases: a null text counts as empty, and empty texts are copies of each other; a null part is the part ''; a document
without an id is no copy of another and has no label; rows that share id and text are all first or all copies;
of several labels of one id, any that marks it counts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, frugal, written

#: The filters of the query, by letter.
NAMES = ("A", "B", "C", "D", "E")
#: Orders grow as the factorial of the filters: more than this are refused.
MOST_FILTERS = 8
#: Parts walked over at once.
PARTS = 64
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
GAP, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"


def text_failures(docs: DataFrame, text: str = "_text") -> DataFrame:
    """docs with ``mask``: bits 0 to 3 for the filters A to D."""
    value = F.col(text)
    words = docs.withColumn("_words", F.array_remove(F.split(value, GAP), ""))
    sized = words.withColumn("_n", F.size("_words")).withColumn("_distinct", F.size(F.array_distinct("_words"))).drop("_words")
    capitals, length = F.regexp_count(value, F.lit("[A-Z]")), F.char_length(value)
    failed = [
        F.col("_n") < LEAST_WORDS,
        100 * F.col("_distinct").cast("long") < LEAST_DISTINCT * F.col("_n").cast("long"),
        100 * capitals.cast("long") > MOST_CAPITALS * length.cast("long"),
        value.rlike(SIGNS),
    ]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed)), F.lit(0))
    return sized.withColumn("mask", mask).drop("_n", "_distinct")


def with_copies(rows: DataFrame, bit: int, key: str = "doc_id", digest: str = "digest") -> DataFrame:
    """rows with the bit set in ``mask`` where a row of a smaller key has the same digest."""
    first = rows.where(F.col(key).isNotNull()).groupBy(digest).agg(F.min(key).alias(key)).withColumn("_first", F.lit(True))
    told = rows.join(first, [digest, key], "left")
    copy = F.col(key).isNotNull() & F.col("_first").isNull()
    return told.withColumn("mask", F.col("mask").bitwiseOR(F.when(copy, 1 << bit).otherwise(0))).drop("_first")


def masks(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part and mask of every document, written: texts are read once."""
    value = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), value.alias("_text"))
    rows = text_failures(texts).select("doc_id", "part", "mask", F.unhex(F.sha2("_text", 256)).alias("digest"))
    return with_copies(written(rows, "masks"), 4).select("doc_id", "part", "mask")


def cells(rows: DataFrame, labels: DataFrame, **marks: Column) -> DataFrame:
    """part, mask, docs, and for each name the documents that one of their labels marks."""
    names = list(marks)
    marked = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in marks.items()])
    some = marked.where(" or ".join(names)).withColumn("_spread", F.lit(0).cast("long"))
    # Rows without an id meet no label: they are spread, or one task would get them all.
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0)
    told = rows.withColumn("_spread", spread).join(some, ["doc_id", "_spread"], "left")
    return told.groupBy("part", "mask").agg(F.count("*").alias("docs"), *[F.count_if(F.col(n)).alias(n) for n in names])


def plain_changes(n: int) -> Iterator[int]:
    """Left places of the swaps of neighbours that visit all orders of n things once each."""
    if n < 2:
        return
    left, right = range(n - 2, -1, -1), range(n - 1)
    yield from left
    for i, place in enumerate(plain_changes(n - 1)):
        # The last thing stands at the left end after every other sweep, and the rest one place further.
        yield place + (i % 2 == 0)
        yield from right if i % 2 == 0 else left


class Walk:
    """The orders of n filters over the mask cells of some parts: counts by (measure, part, mask)."""

    def __init__(self, counts: np.ndarray, n: int):
        self.counts, self.n, self.all_masks = counts, n, np.arange(1 << n)
        self.order = list(range(n))
        self.removed = np.stack([self.step(i) for i in range(n)])
        self.held = [0] * n
        self.shapley = np.zeros((n, counts.shape[1]), np.int64)

    def step(self, i: int) -> np.ndarray:
        """What the i-th filter of the order removes, by measure and part: fails it, and none before it."""
        before, own = sum(1 << f for f in self.order[:i]), 1 << self.order[i]
        return self.counts[:, :, (self.all_masks & before == 0) & (self.all_masks & own > 0)].sum(-1)

    def settle(self, i: int) -> None:
        """Add what stood at step i to its filter, for each order in which it stood."""
        self.shapley[self.order[i]] += self.held[i] * self.removed[i, 0]
        self.held[i] = 0

    def orders(self) -> Iterator[tuple[list[int], np.ndarray]]:
        """Each order with what its steps remove, by (step, measure, part)."""
        self.held = [1] * self.n
        yield self.order, self.removed
        for i in plain_changes(self.n):
            self.settle(i)
            self.settle(i + 1)
            self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
            self.removed[i], self.removed[i + 1] = self.step(i), self.step(i + 1)
            self.held = [h + 1 for h in self.held]
            yield self.order, self.removed
        for i in range(self.n):
            self.settle(i)


def _walked(names: Sequence[str], measures: Sequence[str]):
    n = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, PARTS):
                rows = batch.slice(lo, PARTS).to_pylist()
                counts = np.zeros((len(measures), len(rows), 1 << n), np.int64)
                for p, row in enumerate(rows):
                    for cell in row["cells"]:
                        counts[:, p, cell["mask"]] = [cell[m] for m in measures]
                yield _table([r["part"] for r in rows], Walk(counts, n), names, measures)

    return run


def _table(parts: list[str], walk: Walk, names: Sequence[str], measures: Sequence[str]) -> pa.RecordBatch:
    n, p = walk.n, len(parts)
    seen = [(list(order), removed.copy()) for order, removed in walk.orders()]
    filters = np.array([order for order, _ in seen])
    # By (part, order, step), and the measure first.
    removed = np.stack([r for _, r in seen]).transpose(2, 3, 0, 1)
    docs = walk.counts[0]
    fails = np.stack([docs[:, walk.all_masks >> f & 1 == 1].sum(-1) for f in range(n)], 1)
    alone = docs[:, [1 << f for f in range(n)]]
    kept = docs.sum(-1)[:, None, None] - removed[0].cumsum(-1)
    of_filter = lambda x: x[:, filters]
    orders = ["".join(names[f] for f in order) for order, _ in seen]
    columns = {
        "part": pa.array(np.repeat(np.array(parts, object), len(seen) * n), pa.string()),
        "filter_order": pa.array(np.tile(np.repeat(np.array(orders, object), n), p), pa.string()),
        "step": pa.array(np.tile(np.arange(1, n + 1), p * len(seen)), pa.int32()),
        "kept": kept,
        "removed": removed[0],
        "redundant": of_filter(fails) - removed[0],
        "unique_fails": of_filter(alone),
        **{f"{m}_lost": removed[i] for i, m in enumerate(measures) if i},
        "shapley": of_filter(walk.shapley.T),
    }
    return pa.RecordBatch.from_pydict({k: c if isinstance(c, pa.Array) else pa.array(np.broadcast_to(c, removed[0].shape).reshape(-1), pa.int64()) for k, c in columns.items()})


def audit(of_parts: DataFrame, names: Sequence[str] = NAMES) -> DataFrame:
    """A row for each part, order of the filters and step of it, from ``cells``. A part has at most 2 ** n cells."""
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters, not {len(names)}")
    bounded_batches(of_parts.sparkSession)
    measures = [c for c in of_parts.columns if c not in ("part", "mask")]
    whole = of_parts.groupBy("part").agg(F.collect_list(F.struct("mask", *measures)).alias("cells"))
    lost = "".join(f", {m}_lost long" for m in measures[1:])
    schema = f"part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long{lost}, shapley long"
    return whole.mapInArrow(frugal(_walked(names, measures)), schema)


def audited(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(cells(masks(docs), labels, good=F.col("quality") == 1, toxic=F.col("toxic") == 1))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CAST(len(ws) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(w.doc_id > first_id, false) AS INT) AS mask
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS docs, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)),
o AS (
  SELECT [a.name, b.name, c.name, d.name, e.name] AS names, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.name, b.name, c.name, d.name, e.name])) = 5),
s AS (
  SELECT array_to_string(names, '') AS filter_order, i AS step, bits[i] AS own, CAST(coalesce(list_sum(bits[1:i - 1]), 0) AS INT) AS before
  FROM o, range(1, 6) AS r(i)),
x AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN docs ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN docs ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN docs ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN docs ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM x
"""
