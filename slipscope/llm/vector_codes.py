"""Vector codes: each part of a vector is told by the nearest entry of a codebook, found in a ball tree.

Vectors become whole numbers and are cut into equal parts. The codebook of a part position holds at most 256 entries,
so a tree of balls over them (centre, radius rounded up, at most ``LEAF`` entries in a leaf) goes to every task. A batch
of parts walks the tree together: first each part goes down to its nearest leaf, whose best entry bounds the search;
then a ball is visited by those parts whose distance to its centre, rounded down, less its radius does not exceed their
bound. Visits at equality are made too, so that of equally near entries the one with the lowest index is found, and
distances are compared as exact whole numbers: as doubles that hold them exactly where they can, else in 64 bits.

A round assigns all parts, adds them up by entry within each task and then over tasks, and moves the entries to the
floors of their means. What reaches the driver is the codebooks and their sums.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part, and neither do those of
another dimension than the commonest (of equally common ones, the smaller); a dimension that the parts don't divide is
cut as evenly as can be; components are held to a bound at which the error of a vector fits 62 bits (131,072 before
scaling for 64 dimensions), and sums of errors stop at the largest 64-bit number; rows without an id are coded, and
stand last where the first entries are taken; repeated rows are rows; null labels are one label; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, frugal, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries of a leaf at most; parts that walk a tree together.
LEAF, TOGETHER = 8, 8_192
EXACT = 2**53


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between rows of whole numbers, exact in 64 bits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if a.shape[1] * (int(np.abs(a).max()) + int(np.abs(b).max())) ** 2 < EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)).astype(np.int64)
    out = np.zeros((len(a), len(b)), np.int64)
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[None, :, i]
        out += d * d
    return out


class Ball:
    """Some entries: a centre of whole numbers and a radius that holds them, rounded up."""

    __slots__ = ("centre", "radius", "members", "halves")

    def __init__(self, entries: np.ndarray, members: np.ndarray, leaf: int):
        points = entries[members]
        self.members, self.halves = members, ()
        self.centre = points.sum(0) // len(points)
        away = squares(self.centre[None], points)[0]
        most = int(away.max())
        root = math.isqrt(most)
        self.radius = root + (root * root < most)
        if len(members) > leaf and most:
            # Two entries far from each other share out the rest.
            one = squares(points[[away.argmax()]], points)[0]
            two = squares(points[[one.argmax()]], points)[0]
            if (one > two).any():
                self.halves = (Ball(entries, members[one <= two], leaf), Ball(entries, members[one > two], leaf))


class Balls:
    """The nearest entries of a codebook by branch and bound; ``seen`` counts the distances to entries that were made."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.root, self.seen = entries, Ball(entries, np.arange(len(entries)), leaf), 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part; of equally near ones, the lowest index."""
        found = [self._together(parts[lo : lo + TOGETHER]) for lo in range(0, len(parts), TOGETHER)]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _together(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(parts)
        index, best = np.full(n, len(self.entries), np.int64), np.full(n, np.iinfo(np.int64).max, np.int64)
        home: dict[Ball, np.ndarray] = {}

        def look(ball: Ball, rows: np.ndarray) -> None:
            away = squares(parts[rows], self.entries[ball.members])
            self.seen += away.size
            at = away.argmin(1)
            least, which = away[np.arange(len(rows)), at], ball.members[at]
            better = (least < best[rows]) | ((least == best[rows]) & (which < index[rows]))
            index[rows[better]], best[rows[better]] = which[better], least[better]

        todo = [(self.root, np.arange(n))]
        while todo:
            ball, rows = todo.pop()
            if ball.halves:
                away = [squares(parts[rows], half.centre[None])[:, 0] for half in ball.halves]
                first = away[0] <= away[1]
                todo += [(half, mine) for half, mine in zip(ball.halves, (rows[first], rows[~first])) if len(mine)]
            else:
                home[ball] = rows
                look(ball, rows)
        todo = [(self.root, np.arange(n))]
        while todo:
            ball, rows = todo.pop()
            # Rounded down, and one less for the rounding of the root itself.
            away = np.floor(np.sqrt(squares(parts[rows], ball.centre[None])[:, 0].astype(np.float64))).astype(np.int64) - 1
            gap = np.maximum(away - ball.radius, 0)
            rows = rows[gap * gap <= best[rows]]
            if ball.halves:
                todo += [(half, rows) for half in ball.halves if len(rows)]
            else:
                rows = np.setdiff1d(rows, home[ball], assume_unique=True) if ball in home else rows
                if len(rows):
                    look(ball, rows)
        return index, best


class Codebooks:
    """Entries by part position, and where vectors are cut."""

    def __init__(self, entries: list[np.ndarray], cuts: list[int]):
        self.entries, self.cuts = entries, cuts

    @classmethod
    def of(cls, vectors: np.ndarray, parts: int) -> Codebooks:
        cuts = [i * vectors.shape[1] // parts for i in range(parts + 1)]
        return cls([vectors[:, lo:hi] for lo, hi in zip(cuts, cuts[1:])], cuts)

    def trees(self) -> list[Balls]:
        return [Balls(e) for e in self.entries]

    def cut(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[:, lo:hi] for lo, hi in zip(self.cuts, self.cuts[1:])]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for e in self.entries for x in e.ravel().tolist()).encode()).hexdigest()


def prepared(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label and whole numbers ``v`` of the vectors that take part, written."""
    x = F.col(embedding)
    whole = df.where(F.size(x) > 0).where(F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)) & ~F.isnan(c)))
    most = F.floor(F.sqrt(2.0**62 / F.size(x)) / 2).cast("double")
    v = F.transform(x, lambda c: F.least(F.greatest(F.floor(SCALE * c.cast("double")).cast("double"), -most), most).cast("long"))
    out = written(whole.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), v.alias("v")), "vectors")
    common = out.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    return out.where(F.size("v") == (common.d if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        sums = [np.zeros_like(e) for e in books.entries]
        for batch in batches:
            if batch.num_rows:
                for p, part in enumerate(books.cut(_matrix(batch["v"]))):
                    index, _ = trees[p].nearest(part)
                    counts[p] += np.bincount(index, minlength=len(counts[p]))
                    np.add.at(sums[p], index, part)
        some = [(p, i) for p, n in enumerate(counts) for i in np.flatnonzero(n).tolist()]
        if some:
            columns = ([p for p, _ in some], [i for _, i in some], [int(counts[p][i]) for p, i in some], [sums[p][i].tolist() for p, i in some])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=["part", "entry", "n", "sums"])

    return run


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks with each entry at the floors of its parts' means; entries without parts stay."""
    sums = vectors.select("v").mapInArrow(frugal(_sums(books)), "part int, entry int, n long, sums array<long>")
    each = sums.select("part", "entry", "n", F.posexplode_outer("sums").alias("place", "x"))
    entries = [e.copy() for e in books.entries]
    # A row for each entry and place in it.
    for r in each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).where("place is not null").collect():
        entries[r.part][r.entry, r.place] = r.x // r.n
    return Codebooks(entries, books.cuts)


def learned(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of prepared vectors: those of the smallest ids, moved as often as ``rounds``. None without vectors."""
    bounded_batches(vectors.sparkSession)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return None
    books = Codebooks.of(np.array([r.v for r in first], np.int64), parts)
    for _ in range(rounds):
        books = moved(vectors, books)
    return books


def _coded(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        for batch in batches:
            if batch.num_rows:
                found = [tree.nearest(part) for tree, part in zip(trees, books.cut(_matrix(batch["v"])))]
                codes = np.stack([index for index, _ in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([c.hex() for c in map(bytes, codes)], pa.string()), pa.array(sum(away for _, away in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def coded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """vec_id, label, code (two hex digits for each part) and error of prepared vectors."""
    bounded_batches(vectors.sparkSession)
    kinds = dict(vectors.dtypes)
    return vectors.mapInArrow(frugal(_coded(books)), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def restored(codes: DataFrame, books: Codebooks) -> DataFrame:
    """codes with ``restored``: the whole numbers that a code stands for, as one array."""
    entry = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    tables = [F.array(*[F.array(*map(F.lit, row)).cast("array<bigint>") for row in e.tolist()]) for e in books.entries]
    return codes.withColumn("restored", F.concat(*[F.get(t, entry(p)) for p, t in enumerate(tables)]))


def compressed(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that takes part."""
    vectors = prepared(df, vec_id, embedding, label)
    books = learned(vectors)
    if books is None:
        return vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = written(coded(vectors, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    # Written, so that a join on a label with many rows can be split.
    totals = written(codes.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")), "labels")
    told = codes.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return told.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    """Distances and means by joins of single components, round after round."""
    steps = [
        """v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))""",
        """c AS MATERIALIZED (
  SELECT r, (i - 1) // (len(v) // 4) AS part, (i - 1) % (len(v) // 4) AS place, v[i] AS x FROM v, range(1, len(v) + 1) AS t(i))""",
        "b0 AS MATERIALIZED (SELECT part, CAST(r - 1 AS BIGINT) AS entry, place, x FROM c WHERE r <= 256)",
    ]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, part, min(away * 256 + entry) AS best
  FROM (SELECT c.r, c.part, b.entry, CAST(sum((c.x - b.x) * (c.x - b.x)) AS HUGEINT) AS away FROM c JOIN b{k} b ON c.part = b.part AND c.place = b.place GROUP BY c.r, c.part, b.entry)
  GROUP BY r, part)""")
        if k < ROUNDS:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x
  FROM b{k} b LEFT JOIN (
    SELECT c.part, a.best % 256 AS entry, c.place, CAST(floor(CAST(sum(c.x) AS DOUBLE) / count(*)) AS BIGINT) AS x
    FROM c JOIN a{k} a ON c.r = a.r AND c.part = a.part GROUP BY ALL) m ON b.part = m.part AND b.entry = m.entry AND b.place = m.place)""")
    last = f"""
SELECT v.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{ROUNDS}) AS codebooks_sha256
FROM v JOIN (
  SELECT r, string_agg(printf('%02x', CAST(best % 256 AS INT)), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r) e ON v.r = e.r
"""
    return "WITH " + ",\n".join(steps) + last


ORACLE = _oracle()
