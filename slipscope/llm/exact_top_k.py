"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length over the whole table, longest first, and packed into blocks of neighbours (a table in the
shared folder); a block is cut into buckets. Queries are rows too. First, each meets the block of the longest vectors,
which gives it a threshold, its k-th best product so far. Queries are then grouped by the length that a vector needs to
reach their threshold, and each group meets, by a join, the blocks that hold a vector so long: blocks are dealt out by
length, so that a group isn't even sent where none does. Within a block, each
bucket has a local threshold for each query, the least cosine a vector there must have: above 1, the bucket is skipped;
else the cheaper of two prunings is chosen, by length (the vectors long enough at a cosine of 1) or by coordinate (those
whose normalised value at the query's largest coordinate is possible at that cosine). What is left is verified by exact
integer products. The best of a query in all blocks meet in one ranking; no query passes the driver.

Defined cases: vectors that are null or empty, or hold a null or a non-finite component, and rows without an id take
no part; vectors are compared with those of the same dimension; a repeated row is a candidate of its own (only the
query's very row is left out); ties go to the smaller vec_id; products are ranked as whole numbers of any size, and a
score beyond 64 bits is given as the nearest 64-bit number; queries without candidates return nothing; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, frugal, written

#: Vectors of a block and of a bucket; queries of a group; blocks that a task keeps while groups pass by, at most.
BLOCK, BUCKET, GROUP, SPAN = 4_096, 512, 1_024, 16
#: Copies of the longest block, by which queries meet it in many tasks.
SALT = 64
#: Ranges of length into which blocks are dealt, at most; a group of queries is sent to those only that can reach its need.
TIERS = 256
#: Whole numbers up to this are exact as doubles. Components from LARGE on are taken as whole numbers of Python.
EXACT, LARGE = 2.0**53, 1e100


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as doubles, which hold it exactly; for large components as whole numbers of Python."""
    if len(x) and np.abs(x).max() >= LARGE:
        return np.array([int(v) * 256 if abs(v) >= EXACT else math.floor(256 * v) for v in x.ravel().tolist()], object).reshape(x.shape)
    return np.floor(256.0 * x)


def lengths(vectors: np.ndarray) -> np.ndarray:
    if vectors.dtype == object:
        return np.full(len(vectors), np.inf)
    return np.sqrt((vectors**2).sum(1))


class Queries:
    """Queries of one dimension: vectors, ids and their own rows (block, place)."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, block: np.ndarray, place: np.ndarray):
        self.vectors, self.ids, self.block, self.place = vectors, ids, block, place
        self.norms = lengths(vectors)
        if vectors.dtype != object and len(vectors):
            safe = np.where(self.norms > 0, self.norms, 1.0)
            self.focus = np.abs(vectors).argmax(1)
            self.peak = vectors[np.arange(len(vectors)), self.focus] / safe


class Best:
    """The k best (score, vec_id) of one query so far, from a known lower bound of the k-th on."""

    __slots__ = ("k", "found", "floor")

    def __init__(self, k: int, floor: int | None = None):
        self.k, self.found, self.floor = k, [], floor

    @property
    def kth(self) -> int | None:
        """What a product must reach; None if anything will do."""
        return -self.found[-1][0] if len(self.found) >= self.k else self.floor

    @property
    def least(self) -> float:
        """kth as a double, rounded down."""
        kth = self.kth
        try:
            return -np.inf if kth is None else float(np.nextafter(float(kth), -np.inf))
        except OverflowError:
            return -np.inf if kth < 0 else float(np.finfo(float).max)

    def add(self, scores: list[int], ids: list[int]) -> None:
        kth = self.kth
        fresh = [(-s, i) for s, i in zip(scores, ids) if kth is None or s >= kth]
        if fresh:
            self.found = sorted(self.found + fresh)[: self.k]


def exact(q: np.ndarray, vectors: np.ndarray) -> list[int]:
    a = [int(x) for x in q.tolist()]
    return [sum(x * int(y) for x, y in zip(a, v)) for v in vectors.tolist()]


def search_block(queries: Queries, bests: list[Best], block: int, ids: np.ndarray, vectors: np.ndarray, bucket: int = BUCKET, counts: dict | None = None) -> None:
    """Adds one block's vectors, sorted by length, longest first, to the bests of all queries."""
    counts = {} if counts is None else counts
    own = {int(i): int(queries.place[i]) for i in np.flatnonzero(queries.block == block)}
    if vectors.dtype == object or queries.vectors.dtype == object:
        for i, best in enumerate(bests):
            take = np.array([j for j in range(len(ids)) if j != own.get(i)], int)
            best.add(exact(queries.vectors[i], vectors[take]), ids[take].tolist())
        return
    norms = lengths(vectors)
    unit = vectors / np.where(norms > 0, norms, 1.0)[:, None]
    q, d = queries.vectors, vectors.shape[1]
    least = np.array([b.least for b in bests])
    for lo in range(0, len(ids), bucket):
        hi = min(lo + bucket, len(ids))
        reach = queries.norms * norms[lo]
        # A margin keeps rounding from pruning a vector that just reaches the threshold.
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where((least > -np.inf) & (reach > 0), least / reach, -np.inf) - 1e-9
            needed = np.where((least > 0) & (queries.norms > 0), least / queries.norms, -np.inf)
        active = np.flatnonzero(cosine <= 1)
        if not len(active):
            continue
        long = np.searchsorted(-norms[lo:hi], -needed[active] + 1e-9 * norms[lo], "right")
        inside = np.arange(hi - lo)[:, None] < long[None, :]
        # At cosine 0.5 or less the possible range of one coordinate is too wide to be worth a look.
        sharp = np.flatnonzero(cosine[active] > 0.5)
        if len(sharp):
            at, t = active[sharp], np.minimum(cosine[active[sharp]], 1.0)
            p = queries.peak[at]
            slack = np.sqrt(np.maximum(0.0, 1 - p * p)) * np.sqrt(np.maximum(0.0, 1 - t * t)) + 1e-9 + np.abs(p) * (1 - t)
            inside[:, sharp] &= np.abs(unit[lo:hi, queries.focus[at]] - (p * t)[None, :]) <= slack[None, :]
        for j, i in enumerate(active):
            if i in own and lo <= own[i] < hi:
                inside[own[i] - lo, j] = False
        kept = int(inside.sum())
        counts["verified"] = counts.get("verified", 0) + kept
        if not kept:
            continue
        error = 2.0**-50 * d * float(np.abs(q[active]).max()) * float(np.abs(vectors[lo:hi]).max())
        sure = error * 2.0**50 < EXACT
        if 8 * kept < inside.size:
            rows, columns = np.nonzero(inside)
            product = np.einsum("ij,ij->i", vectors[lo + rows], q[active[columns]])
        else:
            every = vectors[lo:hi] @ q[active].T
            rows, columns = np.nonzero(inside & (every >= least[active][None, :] - error))
            product = every[rows, columns]
        good = product >= least[active[columns]] - error
        rows, columns, product = rows[good], columns[good], product[good]
        order = np.argsort(columns, kind="stable")
        rows, columns, product = rows[order], columns[order], product[order]
        cuts = np.flatnonzero(np.diff(columns, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(columns)]):
            i, some = active[columns[a]], slice(a, b)
            if sure and b - a > bests[i].k:
                top = np.lexsort((ids[lo + rows[some]], -product[some]))[: bests[i].k] + a
                bests[i].add(product[top].astype(np.int64).tolist(), ids[lo + rows[top]].tolist())
            else:
                scores = product[some].astype(np.int64).tolist() if sure else exact(q[i], vectors[lo + rows[some]])
                bests[i].add(scores, ids[lo + rows[some]].tolist())
            least[i] = bests[i].least


_BLOCKS = "dim int, block long, top double, ids binary, vectors binary, is_query binary, n_queries long"


def pack(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", query: Column | None = None) -> DataFrame:
    """Blocks of vectors of one dimension, in the order of length, as a table; is_query marks rows that satisfy ``query``."""
    bounded_batches(df.sparkSession)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("q"))
    usable = F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(usable).withColumn("dim", F.size("v")).withColumn("large", F.exists("v", lambda x: F.abs(x) >= LARGE))
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.floor(F.when(F.col("large"), 0.0).otherwise(256 * x)).cast("double") * F.floor(F.when(F.col("large"), 0.0).otherwise(256 * x)).cast("double"))
    order = [F.col("dim"), F.col("large").desc(), F.col("length").desc(), F.xxhash64("vec_id")]
    rows = rows.withColumn("length", square).repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v", "q", "dim", "large")
    block = BLOCK

    def emitted(number: int, dim: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, values, marks = (np.concatenate(x) for x in zip(*held))
        values = values.reshape(len(ids), dim)
        norms = lengths(integers(values))
        order = np.argsort(-norms, kind="stable")
        columns = [[dim], [number], [float(norms.max())], [ids[order].astype("<i8").tobytes()], [values[order].astype("<f8").tobytes()], [marks[order].tobytes()], [int(marks.sum())]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names=["dim", "block", "top", "ids", "vectors", "is_query", "n_queries"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kind, held, size = TaskContext.get().partitionId() << 32, None, [], 0
        for batch in batches:
            ids, q = batch.column(0).to_numpy(), np.asarray(batch.column(2).to_pylist(), bool)
            dims, large = batch.column(3).to_numpy(), np.asarray(batch.column(4).to_pylist(), bool)
            change = np.flatnonzero(np.diff(dims * 2 + large, prepend=-1))
            for a, b in zip(change, [*change[1:], len(ids)]):
                flat = np.asarray(batch.column(1).slice(a, b - a).flatten())
                mine = (int(dims[a]), bool(large[a]))
                if held and mine != kind:
                    yield emitted(number, kind[0], held)
                    number, held, size = number + 1, [], 0
                kind = mine
                for i in range(a, b, block):
                    for lo, hi in ((i, min(b, i + block - size)), (min(b, i + block - size), min(b, i + block))):
                        if hi > lo:
                            held.append((ids[lo:hi], flat[(lo - a) * kind[0] : (hi - a) * kind[0]], q[lo:hi]))
                            size += hi - lo
                        if size == block:
                            yield emitted(number, kind[0], held)
                            number, held, size = number + 1, [], 0
        if held:
            yield emitted(number, kind[0], held)

    return written(rows.mapInArrow(run, _BLOCKS), "vectors")


_FOUND = "dim int, block long, place int, query_id long, vec_id long, score long, strength binary"


def strength(score: int) -> bytes:
    """Bytes in the order of whole numbers of any size."""
    size = (abs(score).bit_length() + 7) // 8
    head = size.to_bytes(2, "big") + abs(score).to_bytes(size, "big")
    return b"\1" + head if score >= 0 else b"\0" + bytes(255 - x for x in head)


def _results(dim: int, queries: Queries, bests: list[Best]) -> pa.RecordBatch:
    which = [i for i, b in enumerate(bests) for _ in b.found]
    rows = [(-s, i) for b in bests for s, i in b.found]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    columns = [[dim] * len(rows), queries.block[which], queries.place[which], queries.ids[which], [i for _, i in rows], [clip(s) for s, _ in rows], [strength(s) for s, _ in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["dim", "block", "place", "query_id", "vec_id", "score", "strength"])


def _of(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, "<i8"), integers(np.frombuffer(vectors, "<f8").reshape(-1, dim))


def _seeded(k: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of a block against the longest block: one row each, with what they found."""
        for batch in batches:
            for r in batch.to_pylist():
                dim, place = r["dim"], np.flatnonzero(np.frombuffer(r["is_query"], bool)).astype("<i4")
                ids, raw = np.frombuffer(r["ids"], "<i8")[place], np.frombuffer(r["vectors"], "<f8").reshape(-1, dim)[place]
                queries = Queries(integers(raw), ids, np.full(len(place), r["block"]), place)
                bests = [Best(k) for _ in ids]
                search_block(queries, bests, r["seed"], *_of(r["seed_ids"], r["seed_vectors"], dim))
                needs = [b.least / n if 0 < n < np.inf else -np.inf for b, n in zip(bests, queries.norms)]
                floors = [str(b.kth) if b.kth is not None else None for b in bests]
                found = [[{"vec_id": i, "score": str(-s)} for s, i in b.found] for b in bests]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim] * len(ids), pa.int32()), pa.array(queries.block, pa.int64()), pa.array(place, pa.int32()), pa.array(ids, pa.int64()), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(needs, pa.float64()), pa.array(floors, pa.string()), pa.array(found, pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.string())])))],
                    names=["dim", "block", "place", "query_id", "vector", "need", "floor", "found"],
                )

    return run


def _grouped(size: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of neighbouring queries of one dimension; need: the least of theirs."""
        number, held, dim = TaskContext.get().partitionId() << 32, [], None

        def emitted() -> pa.RecordBatch:
            columns = [[dim], [number], [min(r["need"] for r in held)], [np.array([r["block"] for r in held], "<i8").tobytes()], [np.array([r["place"] for r in held], "<i4").tobytes()], [np.array([r["query_id"] for r in held], "<i8").tobytes()], [b"".join(r["vector"] for r in held)], [[r["floor"] for r in held]]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string())))], names=["dim", "number", "need", "blocks", "places", "query_ids", "vectors", "floors"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and (r["dim"] != dim or len(held) == size):
                    yield emitted()
                    number, held = number + 1, []
                dim = r["dim"]
                held.append(r)
        if held:
            yield emitted()

    return run


def _searched(k: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups against blocks; what a group finds in the blocks that it meets in a row is told at once."""
        now, dim, queries, bests = None, 0, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {n: batch.column(n)[i] for n in batch.schema.names}
                if (number := r["number"].as_py()) != now:
                    if now is not None:
                        yield _results(dim, queries, bests)
                    now, dim = number, r["dim"].as_py()
                    ids, vectors = _of(r["query_ids"].as_py(), r["query_vectors"].as_py(), dim)
                    queries = Queries(vectors, ids, np.frombuffer(r["blocks"].as_py(), "<i8"), np.frombuffer(r["places"].as_py(), "<i4"))
                    bests = [Best(k, None if f is None else int(f)) for f in r["floors"].as_py()]
                search_block(queries, bests, r["block"].as_py(), *_of(r["ids"].as_py(), r["vectors"].as_py(), dim))
        if now is not None:
            yield _results(dim, queries, bests)

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What queries found in the longest block, one row for each vector."""
    for batch in batches:
        out = [(r["dim"], r["block"], r["place"], r["query_id"], f["vec_id"], max(-(2**63), min(2**63 - 1, int(f["score"]))), strength(int(f["score"]))) for r in batch.to_pylist() for f in r["found"]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["dim", "block", "place", "query_id", "vec_id", "score", "strength"])


def tiers(blocks: DataFrame, span: int) -> tuple[list[float], list[int]]:
    """Lengths that part the blocks into tiers, longest first; and the spans of ``span`` blocks up to the end of each tier.

    Blocks of one length are one tier, of as many spans as they fill.
    """
    n = min(TIERS, -(-blocks.count() // span))
    bounds = blocks.agg(F.percentile_approx("top", [i / n for i in range(1, n)])).first()[0] if n > 1 else []
    bounds = sorted(set(bounds or ()), reverse=True)
    held = {r.tier: r["count"] for r in blocks.groupBy(_tier(F.col("top"), bounds).alias("tier")).count().collect()}
    return bounds, list(accumulate(-(-held.get(t, 0) // span) for t in range(len(bounds) + 1)))


def _tier(length: Column, bounds: list[float]) -> Column:
    """How many bounds lie above a length."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b > length)) if bounds else F.lit(0)


def _reach(need: Column) -> Column:
    """What the length of a vector must reach; a margin keeps rounding from passing by one that just does."""
    return need * F.when(need > 0, 1 - 1e-9).otherwise(1 + 1e-9)


def dealt(blocks: DataFrame, bounds: list[float], ends: list[int]) -> DataFrame:
    """blocks with ``span``: those of their tier, by hash."""
    tier = _tier(F.col("top"), bounds)
    begin, n = (F.get(F.array(*map(F.lit, x)), tier) for x in ([0, *ends[:-1]], [b - a for a, b in zip([0, *ends], ends)]))
    return blocks.withColumn("span", (begin + F.pmod(F.xxhash64("block"), F.greatest(n, F.lit(1)))).cast("int"))


def sent(groups: DataFrame, bounds: list[float], ends: list[int]) -> DataFrame:
    """groups with ``span``, once for each span of the tiers that hold a vector long enough."""
    upto = F.get(F.array(*map(F.lit, ends)), _tier(_reach(F.col("need")), bounds))
    return groups.where(upto > 0).withColumn("span", F.explode(F.sequence(F.lit(0), upto - 1)))


def search(blocks: DataFrame, k: int = 5, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score for every marked row of a packed table. The plan is the same for any number of rows."""
    spark = blocks.sparkSession
    n_blocks = blocks.count()
    # The longest block of each dimension, in copies, so that the queries meet it in many tasks.
    first = blocks.groupBy("dim").agg(F.min("block").alias("block"))
    seeds = blocks.join(first, ["dim", "block"]).select("dim", F.col("block").alias("seed"), F.col("ids").alias("seed_ids"), F.col("vectors").alias("seed_vectors"))
    seeds = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(min(SALT, n_blocks) or 1) - 1)))
    asking = blocks.where("n_queries > 0").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(min(SALT, n_blocks) or 1)).cast("int"))
    met = asking.join(seeds, ["dim", "salt"]).select("dim", "block", "ids", "vectors", "is_query", "seed", "seed_ids", "seed_vectors")
    seeded = met.mapInArrow(_seeded(k), "dim int, block long, place int, query_id long, vector binary, need double, floor string, found array<struct<vec_id:long,score:string>>")
    seeded = written(seeded, "seeded")
    order = [F.col("dim"), F.col("need").desc(), F.col("query_id")]
    groups = seeded.drop("found").repartitionByRange(*order).sortWithinPartitions(*order)
    groups = groups.mapInArrow(_grouped(group), "dim int, number long, need double, blocks binary, places binary, query_ids binary, vectors binary, floors array<string>")
    groups = written(groups, "queries").withColumnRenamed("vectors", "query_vectors")
    # The other blocks are dealt into spans that a task can hold while groups pass by: by length into tiers, then by hash.
    span = max(1, min(SPAN, n_blocks // (2 * spark.sparkContext.defaultParallelism)))
    bounds, ends = tiers(blocks, span)
    others = dealt(blocks.join(first, ["dim", "block"], "left_anti").select("dim", "block", "top", "ids", "vectors"), bounds, ends)
    cells = sent(groups, bounds, ends).join(others, ["dim", "span"]).where(F.col("top") >= _reach(F.col("need")))
    cells = cells.select("dim", "number", "blocks", "places", "query_ids", "query_vectors", "floors", "block", "ids", "vectors")
    found = cells.mapInArrow(_searched(k), _FOUND).unionByName(seeded.mapInArrow(_told, _FOUND))
    best = Window.partitionBy("block", "place").orderBy(F.col("strength").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k best rows of df for each of its rows that satisfy ``query``."""
    return search(pack(df, vec_id, embedding, query), k)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS (
  SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5
"""
