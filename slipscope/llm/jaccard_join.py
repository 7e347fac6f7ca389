"""N-gram Jaccard join, size-aware: fixed-size subsets for small sets, inverted lists for large ones.

A document's set holds its distinct shingles; documents with one and the same set are collapsed first. Sets A and B
link if 100 |A & B| >= PERCENT |A | B|, that is if their overlap reaches a share of max(|A|, |B|).

* Small sets enumerate their subsets of every size that such an overlap with a partner can have; linked sets share
  one. Large sets go to the inverted lists of their prefixes: in one global order of shingles, linked sets share a
  shingle among the first |A| - ceil(PERCENT |A| / 100) + 1. The boundary is the size up to which subsets cost less
  than lists, from the number of sets of each size and the mean length of the lists. Sets just below it do both.
* The order puts frequent shingles last, so that lists stay short: shingles are counted over all documents, and a table
  of bytes tells the class (the logarithm of the count) of those of HEAVY documents or more. It grows with the shingles
  up to MOST_SLOTS bytes; beyond that, and where a bucket of them is too full, the least count that is told grows
  instead. The order is the same function of a shingle everywhere, so what the table can't tell costs time, never links.
* Short lists give all their pairs, by size and position filters. In a long list (near copies), each set is paired
  with two pivots: the one of the earliest document, as originals come before copies, and the one of least hash. A second filter drops pairs whose parity signatures
  differ in more bits than linked sets can: every shingle that only one of them has turns over one bit at most. What
  is left is verified on the full sets and gives links, and these components.
* Long lists that still hold more components than one give all pairs between components that pass the same filters,
  which are verified too. They are made in cells: members outside the most frequent component in blocks, against all
  members in blocks, one task for a pair of blocks. So every link between two components is found, no list gives all
  pairs within one, and sets that only share a passage give none.

``grouped`` returns components. ``linked`` returns every link between two different sets: there, long lists give all
pairs that pass the filters.

Defined cases: null texts and texts without words have empty sets and link with nothing (their component is their own
id); repeated rows are rows with equal sets; null ids link as others do, and a component's id is its smallest
non-null one; empty tables give empty results; extra columns are ignored. Case is folded for A-Z.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .components import components
from .shared import bounded_batches, discard, frugal, released, text_portions, written

SHINGLE, PERCENT = 5, 80
#: Documents from which a shingle counts as frequent (more than a short list holds); bits of a counter's number in its
#: bucket; and of the table of classes: shingles for each slot, most slots, and the fullest that a bucket's may get.
HEAVY, KEY_BITS, SHINGLES_A_SLOT, MOST_SLOTS, FULL = 9, 24, 16, 1 << 25, 4
#: Lists up to this length give all their pairs.
SHORT = 8
#: Largest set size for which subsets may be chosen.
MOST_SMALL = 14
#: Bytes of text whose shingles make one bucket; postings that a task holds before it sends them.
BUCKET_BYTES, HELD = 16 << 20, 500_000
#: Bits of a signature, as a power of two; it is kept in columns of 64.
SIGNATURE_BITS = 9
SIGNATURE_BYTES = (1 << SIGNATURE_BITS) // 8
MARKS = [f"s{i}" for i in range(SIGNATURE_BYTES // 8)]
#: Bits of the filter of wanted sets for each of them, and at most.
FILTER_EACH, FILTER_MOST = 16, 1 << 28
#: Members of a block of a long list; rows of cells that a task takes at a time; copies of the narrow table of long lists, by which hot ones are dealt out.
CELL, CELL_ROWS, SALT = 256, 100_000, 16
#: Sets that this share of all documents have, or more, are joined apart (at most so many, so their list goes to every task).
HOT_SHARE = 1_000
#: Nodes up to this number are sent to every task to pick their sets.
FEW = 50_000
U = np.uint64


def need(n: int) -> int:
    """Least overlap of two linked sets of which the larger has n shingles."""
    return -(-PERCENT * n // 100)


def prefix(n: int) -> int:
    return n - need(n) + 1


def subset_sizes(n: int) -> list[int]:
    """Overlaps that a set of n shingles may need with a partner no smaller, and with smaller ones: need(n)."""
    return sorted({need(m) for m in range(n, n * 100 // PERCENT + 1)})


def subset_count(n: int) -> int:
    return sum(comb(n, k) for k in subset_sizes(n))


def boundary(sizes: dict[int, int], mean_list: float) -> int:
    """The largest size up to which all sets together are cheaper by subsets than by lists."""
    best, best_cost, cost = 0, 0.0, 0.0
    for n in range(1, MOST_SMALL + 1):
        cost += sizes.get(n, 0) * (subset_count(n) - prefix(n) * (1 + mean_list))
        if cost <= best_cost:
            best, best_cost = n, cost
    return best


def shingles(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles' hashes of each text, sorted."""
    w = tb.words(texts, lower=True)
    h = w.hashes()
    grams = tb.windows(h, k)
    out = []
    for lo, hi in zip(w.first, w.first[1:]):
        if hi - lo >= k:
            out.append(np.unique(grams[lo : hi - k + 1]))
        elif hi > lo:
            out.append(tb.windows(h[lo:hi], int(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    return int(tb.mix(s + U(1)).sum(dtype=np.uint64).astype(np.int64)), int(tb.mix(s ^ U(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).astype(np.int64))


def signature(s: np.ndarray) -> bytes:
    """For each of 2 ** SIGNATURE_BITS places, whether an odd number of shingles falls there."""
    odd = np.bincount((tb.mix(s ^ U(0xA0761D6478BD642F)) >> U(64 - SIGNATURE_BITS)).astype(np.int64), minlength=1 << SIGNATURE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(left: str, right: str) -> Column:
    """In how many bits the signatures of two aliased tables differ."""
    return sum((F.bit_count(F.col(f"{left}.{m}").bitwiseXOR(F.col(f"{right}.{m}"))) for m in MARKS), F.lit(0))


def most_apart(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most shingles that only one of two linked sets can have."""
    return (n_a + n_b) - 2 * (-(-PERCENT * (n_a + n_b) // (100 + PERCENT)))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((tb.mix(h) >> U(32)) * U(buckets) >> U(32)).astype(np.int32)


def _parts(b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(b, kind="stable")
    cuts = np.flatnonzero(np.diff(b[order], prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(b)]):
        yield int(b[order[lo]]), order[lo:hi]


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _sets_of(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Portions of the batches, and the sets of their texts."""
    for batch in batches:
        texts = tb.encoded(batch.column(text).to_pylist())
        for p in text_portions(texts):
            yield batch.slice(p.start, p.stop - p.start), shingles(texts[p])


def counter(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each shingle, and the number of its counter there: KEY_BITS more bits of its hash."""
    m = tb.mix(h ^ U(0x2545F4914F6CDD1D))
    return ((m >> U(32)) * U(buckets) >> U(32)).astype(np.int64), (m & U((1 << KEY_BITS) - 1)).astype(np.int64)


def slots(key: np.ndarray, size: int) -> np.ndarray:
    """The slot of each counter among the ``size`` of its bucket."""
    return (tb.mix(key.astype(np.uint64)) >> U(32)) % U(size)


class Classes:
    """The class of every shingle: 0, or for frequent ones the logarithm of their count; bytes by bucket and slot."""

    def __init__(self, table: np.ndarray, buckets: int):
        self.table, self.buckets, self.size = table, buckets, len(table) // buckets

    def of(self, s: np.ndarray) -> np.ndarray:
        bucket, key = counter(s, self.buckets)
        return self.table[bucket * self.size + slots(key, self.size).astype(np.int64)]

    def in_order(self, s: np.ndarray) -> np.ndarray:
        """A sorted set in the global order: by class, then by hash."""
        return s[np.argsort(self.of(s), kind="stable")]


def classes_of(counts: np.ndarray, size: int) -> np.ndarray:
    """Classes of a bucket's counters: 0 below the least count with which at most size / FULL counters are told."""
    least = HEAVY
    while least < 2**60 and int((counts >= least).sum()) * FULL > size:
        least *= 2
    return np.where(counts >= least, 1 + np.floor(np.log2(np.maximum(counts, 1) / least)), 0).astype(np.uint8)


def counted(rows: DataFrame, buckets: int) -> tuple[Classes, float, DataFrame]:
    """The classes, the mean number of documents of a shingle, and doc_id, name, size, node and signature of every row, as a table.

    Counters are sent in sorted runs by bucket, without the bits that the bucket tells: a few bytes each. There are
    several times as many counters as shingles at any size, so shared ones only make a few more shingles frequent. The
    sets' names go the same way, a row for each document, dealt out evenly.
    """
    size = max(1, min(MOST_SLOTS, (BUCKET_BYTES // 6 // SHINGLES_A_SLOT) * buckets) // buckets)
    row = "kind int, bucket int, a binary, b binary, c binary, d binary, e binary"
    names = ["kind", "bucket", "a", "b", "c", "d", "e"]

    def counters(held: list[np.ndarray]) -> Iterator[tuple]:
        bucket, key = counter(np.concatenate(held), buckets)
        cell, n = np.unique(bucket << KEY_BITS | key, return_counts=True)
        bucket, key = cell >> KEY_BITS, (cell & ((1 << KEY_BITS) - 1)).astype("<u4")
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for lo, hi in zip(cut, [*cut[1:], len(bucket)]):
            yield 0, int(bucket[lo]), _planes(key[lo:hi]), _planes(n[lo:hi].astype("<u4")), None, None, None

    def emit(held: list[np.ndarray], ids: list, keys: list[tuple[int, int]]) -> pa.RecordBatch:
        out = list(counters(held)) if any(len(s) for s in held) else []
        known = np.array([i is not None for i in ids])
        k1, k2 = (np.array([k[i] for k in keys], "<i8") for i in (0, 1))
        marks = np.array([signature(s) for s in held], f"S{SIGNATURE_BYTES}")
        columns = [np.array([i or 0 for i in ids], "<i8"), k1, k2, np.where(known, 1, -1) * (np.array([len(s) for s in held], "<i8") + 1)]
        # Dealt by id and place, not by set: copies of one text, and empty ones, are spread.
        spread = tb.mix(columns[0].astype(np.uint64) + np.arange(len(ids), dtype=np.uint64) * U(0x9E3779B97F4A7C15))
        for b, part in _parts((spread % U(buckets)).astype(np.int64)):
            out.append((1, b, *(_planes(c[part]) for c in columns), marks[part].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), *[pa.binary()] * 5))], names=names)

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, keys, size = [], [], [], 0
        for batch, sets in _sets_of(batches, 1):
            for i, s in zip(batch.column(0).to_pylist(), sets):
                held.append(s)
                ids.append(i)
                keys.append(set_key(s))
                size += len(s) + 8
            if size > HELD:
                yield emit(held, ids, keys)
                held, ids, keys, size = [], [], [], 0
        if held:
            yield emit(held, ids, keys)

    def merge(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        columns = [table.column(c).to_pylist() for c in ("a", "b", "c", "d", "e")]
        if kind == 1:
            ids, k1, k2, n = (np.concatenate([_unplanes(x, "<i8") for x in c]) for c in columns[:4])
            marks = np.frombuffer(b"".join(columns[4]), "<i8").reshape(len(ids), -1)
            out = {"kind": pa.array(np.ones(len(ids), np.int32)), "bucket": pa.array(np.full(len(ids), bucket, np.int32)), "doc_id": pa.array(ids, mask=n < 0), "k1": pa.array(k1), "k2": pa.array(k2), "n": pa.array(np.abs(n) - 1), "node": pa.array(nodes_of(k1, k2))}
            return pa.table(out | {m: pa.array(marks[:, i]) for i, m in enumerate(MARKS)} | {"told": pa.nulls(len(ids), pa.binary())})
        key = np.concatenate([_unplanes(x, "<u4") for x in columns[0]])
        n = np.concatenate([_unplanes(x, "<u4") for x in columns[1]]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        total = np.add.reduceat(n[order], first)
        kinds = classes_of(total, size)
        told = np.zeros(size, np.uint8)
        np.maximum.at(told, slots(key[kinds > 0], size).astype(np.int64), kinds[kinds > 0])
        out = {"kind": pa.array([0], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "doc_id": pa.array([None], pa.int64()), "k1": pa.array([int(total.sum())]), "k2": pa.array([len(key)]), "n": pa.array([0]), "node": pa.array([0])}
        released()
        return pa.table(out | {m: pa.array([0]) for m in MARKS} | {"told": pa.array([told.tobytes()], pa.binary())})

    bounded_batches(rows.sparkSession)
    both = rows.mapInArrow(count, row).groupBy("kind", "bucket").applyInArrow(merge, "kind int, bucket int, doc_id long, k1 long, k2 long, n long, node long, " + "".join(f"{m} long, " for m in MARKS) + "told binary")
    both = written(both, "counted")
    table, total, distinct = np.zeros((buckets, size), np.uint8), 0, 0
    # At most MOST_SLOTS bytes, whatever the input.
    for r in both.where("kind = 0").select("bucket", "k1", "k2", "told").collect():
        table[r.bucket] = np.frombuffer(r.told, np.uint8)
        total, distinct = total + r.k1, distinct + r.k2
    return Classes(table.ravel(), buckets), total / max(distinct, 1), both.where("kind = 1").select("doc_id", "k1", "k2", "n", "node", *MARKS)


_POST = "bucket int, token binary, node binary, n binary, place binary, age binary"
_POSTED = (("token", "<u8"), ("node", "<i8"), ("n", "<u4"), ("place", "<u4"), ("age", "<u2"))


def postings(rows: DataFrame, classes: Classes, renamed: dict[tuple[int, int], int], small: int, buckets: int, ids: tuple[int, int]) -> DataFrame:
    """Entries of the lists, packed by bucket: of subsets for sets up to ``small``, of prefixes for the others and those that can link with them.

    Equal sets met by one task are sent once. renamed: nodes of sets whose numbers clash. ids: the least and greatest
    doc_id; where a document lies between them, in 16 bits, is its age.
    """
    shared = rows.sparkSession.sparkContext.broadcast((classes, renamed))

    def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        token = np.concatenate([x[0] for x in held])
        node, n, age = (np.repeat([x[i] for x in held], [len(x[0]) for x in held]) for i in (1, 2, 4))
        columns = [x.astype(t) for x, (_, t) in zip((token, node, n, np.concatenate([x[3] for x in held]), age), _POSTED)]
        parts = list(_parts(_bucket(token, buckets)))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in parts], pa.int32())] + [pa.array([_planes(x[i]) for _, i in parts], pa.binary()) for x in columns], names=["bucket", *[c for c, _ in _POSTED]])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (order, other), done, held, size = shared.value, set(), [], 0
        for batch, sets in _sets_of(batches, 1):
            keys = [set_key(s) for s in sets]
            ages = [65_535 if i is None else (i - ids[0]) * 65_535 // max(1, ids[1] - ids[0]) for i in batch.column(0).to_pylist()]
            nodes = nodes_of(*(np.array([k[i] for k in keys], np.int64) for i in (0, 1))).tolist()
            for s, k, node, age in zip(sets, keys, nodes, ages):
                n = len(s)
                if not n or k in done:
                    continue
                # The memory for this is bounded.
                if len(done) > 100_000:
                    done.clear()
                done.add(k)
                node = other.get(k, node) if other else node
                if n <= small:
                    tokens = np.array([_subset(c) for m in subset_sizes(n) for c in combinations(s.tolist(), m)], np.uint64)
                    held.append((tokens, node, n, np.zeros(len(tokens), np.int64), age))
                    size += len(tokens)
                if n > small or n >= need(small + 1):
                    p = prefix(n)
                    held.append((order.in_order(s)[:p], node, n, np.arange(p), age))
                    size += p
            if size > HELD:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)

    return rows.mapInArrow(run, _POST)


def nodes_of(k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """Numbers of sets: 63 bits of their names."""
    return (tb.mix(k1.astype(np.uint64) ^ tb.mix(k2.astype(np.uint64))) >> U(1)).astype(np.int64)


def _subset(tokens: tuple[int, ...]) -> int:
    x = 0x1D8E4E27C47D124F
    for t in tokens:
        x = (x ^ t) * 0x9E3779B97F4A7C15 % 2**64
        x ^= x >> 29
    return x


def possible(n_a: np.ndarray, n_b: np.ndarray, place_a: np.ndarray, place_b: np.ndarray) -> np.ndarray:
    """Whether sets whose first common entry is at these places can link, by their sizes and what follows."""
    low, high = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    rest = 1 + np.minimum(n_a - place_a, n_b - place_b) - 1
    # overlap o links if 100 o >= PERCENT (n_a + n_b - o)
    return (100 * low >= PERCENT * high) & ((100 + PERCENT) * rest >= PERCENT * (n_a + n_b))


def _lists(short_list: int):
    def run(table: pa.Table) -> pa.Table:
        """A bucket's lists: all pairs of short ones, pivot pairs and the entries of long ones."""
        columns = [np.concatenate([_unplanes(x, t) for x in table.column(c).to_pylist()]) for c, t in _POSTED]
        order = np.lexsort((columns[4], columns[1], columns[0]))
        # Copies of a set that several tasks met come several times.
        once = np.ones(len(order), bool)
        once[1:] = (np.diff(columns[0][order]) != 0) | (np.diff(columns[1][order]) != 0)
        token, node, n, place, age = (c[order[once]] for c in columns)
        n, place = n.astype(np.int64), place.astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(starts, len(token)))
        mine, lead = np.repeat(length, length), np.repeat(starts, length)
        short = np.flatnonzero((mine > 1) & (mine <= short_list))
        pairs = []
        for d in range(1, short_list):
            i = short[short + d < len(token)]
            i = i[token[i + d] == token[i]]
            pairs.append((i, i + d))
        long = np.flatnonzero(mine > short_list)
        by_hash, by_age = np.lexsort((node, token)), np.lexsort((node, age, token))
        pairs += [(by_age[lead[long]], long), (by_hash[lead[long]], long)]
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        fine = (node[a] != node[b]) & possible(n[a], n[b], place[a], place[b])
        both = np.unique(np.stack([np.minimum(node[a], node[b])[fine], np.maximum(node[a], node[b])[fine]], 1), axis=0)
        zero = lambda x: np.zeros(x, np.int64)
        k, m = len(both), len(long)
        out = pa.table(
            {
                "a": pa.array(np.concatenate([both[:, 0], node[long]])),
                "b": pa.array(np.concatenate([both[:, 1], zero(m)])),
                "token": pa.array(np.concatenate([zero(k), token[long].astype(np.int64)])),
                "n": pa.array(np.concatenate([zero(k), n[long]])),
                "place": pa.array(np.concatenate([zero(k) - 1, place[long]])),
            }
        )
        released()
        return out

    return run


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures allow a link."""
    n = F.col("x.n") + F.col("y.n")
    most = n - 2 * F.ceil(PERCENT * n / (100 + PERCENT))
    one = pairs.alias("p").join(nodes.select("node", "n", *MARKS).alias("y"), F.col("p.b") == F.col("y.node"))
    two = one.join(nodes.select("node", "n", *MARKS).alias("x"), F.col("p.a") == F.col("x.node"))
    return two.where(apart("x", "y") <= most).select("p.a", "p.b")


def node_sets(rows: DataFrame, wanted: DataFrame, nodes: DataFrame, renamed: dict[tuple[int, int], int]) -> DataFrame:
    """node and its whole set, for the wanted nodes: made again from the texts, as most sets are never needed.

    A filter of bounded size, made from the wanted sets' names, lets few other texts through.
    """
    spark = rows.sparkSession
    named = written(nodes.join(wanted, "node").select("node", "k1", "k2"), "named")
    bits = min(FILTER_MOST, 1 << max(16, (FILTER_EACH * named.count()).bit_length()))
    slot = F.col("k1").bitwiseAND(F.lit(bits - 1))
    words = named.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).collect()
    filter_ = np.zeros(bits >> 6, np.int64)
    for r in words:
        filter_[r.word] = r.bits
    shared = spark.sparkContext.broadcast((filter_.view(np.uint8), renamed))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (mask, other), done = shared.value, set()
        for _, sets in _sets_of(batches, 0):
            out = []
            for s in sets:
                k = set_key(s)
                at = k[0] & (bits - 1)
                if mask[at >> 3] >> (at & 7) & 1 and k not in done:
                    out.append((other[k] if k in other else int(nodes_of(*(np.array([x], np.int64) for x in k))[0]), s.tobytes()))
                    # Copies in one task are sent once; the memory for that is bounded.
                    if len(done) > 100_000:
                        done.clear()
                    done.add(k)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in ((0, pa.int64()), (1, pa.binary()))], names=["node", "members"])

    found = rows.select("text").mapInArrow(run, "node long, members binary").groupBy("node").agg(F.max("members").alias("members"))
    out = written(found.join(named.select("node"), "node", "left_semi"), "members")
    discard(named)
    return out


@frugal
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        links = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(p, q, assume_unique=True))
            links.append(100 * common >= PERCENT * (len(p) + len(q) - common))
        keep = pa.array(links, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    ends = _ends(pairs)
    if ends.count() <= FEW:
        sets = sets.join(F.broadcast(ends), "node", "left_semi")
    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b")
    two = one.join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a").select("a", "b", "x", "y")
    return written(two.mapInArrow(_verify, "a long, b long"), "verified")


def _cells(table: pa.Table) -> pa.Table:
    """Pairs of a cell's left (kind 0) and right (kind 1) members that lie in different components and may link."""
    kind, token, i, j, node, n, place, part, main = (table.column(c).to_numpy() for c in ("kind", "token", "i", "j", "a", "n", "place", "part", "most"))
    marks = np.stack([table.column(m).to_numpy() for m in MARKS], 1).view(np.uint64)
    order = np.lexsort((kind, j, i, token))
    key = np.stack([token[order], i[order], j[order]])
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0).any(0)]))
    found = []
    for lo, hi in zip(cuts, [*cuts[1:], len(order)]):
        mine = order[lo:hi]
        left, right = mine[kind[mine] == 0], mine[kind[mine] == 1]
        if not len(left) or not len(right):
            continue
        x, y = left[:, None], right[None, :]
        good = (part[x] != part[y]) & ((part[y] == main[y]) | (node[x] < node[y]))
        good &= possible(n[x], n[y], place[x], place[y])
        p, q = np.nonzero(good)
        p, q = left[p], right[q]
        differ = np.bitwise_count(marks[p] ^ marks[q]).sum(1)
        good = differ <= most_apart(n[p], n[q])
        if good.any():
            found.append(np.stack([np.minimum(node[p], node[q])[good], np.maximum(node[p], node[q])[good]], 1))
    both = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
    released()
    return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64())})


def between_components(long: DataFrame, parts: DataFrame | None, nodes: DataFrame) -> DataFrame:
    """Pairs of members of one long list that lie in different components (of none: all pairs) and may link."""
    members = long.join(parts, F.col("a") == F.col("node"), "left").drop("node") if parts is not None else long.withColumn("component", F.lit(None).cast("long"))
    members = members.select("token", "a", "n", "place", F.coalesce("component", "a").alias("part"))
    counts = members.groupBy("token", "part").agg(F.count("*").alias("size"))
    mixed = counts.groupBy("token").agg(F.max_by("part", F.struct("size", "part")).alias("most"), F.count("*").alias("parts"), F.sum("size").alias("size"), F.max("size").alias("largest"))
    mixed = mixed.where("parts > 1").withColumn("others", F.col("size") - F.col("largest")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    members = members.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALT)).cast("int")).join(mixed, ["token", "salt"])
    members = members.join(nodes.select(F.col("node").alias("a"), *MARKS), "a")
    blocks = lambda size: F.ceil(F.col(size) / CELL).cast("int")
    block = lambda size, seed: F.pmod(F.xxhash64("a", F.lit(seed)), blocks(size)).cast("int")
    every = lambda size: F.explode(F.sequence(F.lit(0), blocks(size) - 1))
    columns = ["token", "a", "n", "place", "part", "most", *MARKS]
    members = written(members.select(*columns, "size", "others"), "mixed")
    left = members.where("part <> most").select(F.lit(0).alias("kind"), *columns, block("others", 1).alias("i"), every("size").alias("j"))
    right = members.select(F.lit(1).alias("kind"), *columns, block("size", 2).alias("j"), every("others").alias("i"))
    cells = left.unionByName(right)
    n = max(1, members.count() * 2 // CELL_ROWS)
    return cells.groupBy(F.pmod(F.xxhash64("token", "i", "j"), F.lit(n)).alias("cell")).applyInArrow(_cells, "a long, b long").distinct()


def _clashes(nodes: DataFrame) -> dict[tuple[int, int], int]:
    """Other numbers for sets whose numbers are another set's too. Among n sets, about n * n / 2 ** 64 are met."""
    twice = nodes.groupBy("node").agg(F.count("*").alias("_n"), F.sort_array(F.collect_list(F.struct("k1", "k2"))).alias("_all")).where("_n > 1").collect()
    return {(s.k1, s.k2): -1 - i for i, s in enumerate(s for r in twice for s in r["_all"][1:])}


class Join:
    """The steps that both results share."""

    def __init__(self, docs: DataFrame, key: str, text: str, small: int | None):
        bounded_batches(docs.sparkSession)
        self.rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        size, *ids = self.rows.agg(F.sum(F.octet_length("text")), F.min("doc_id"), F.max("doc_id")).first()
        size, ids = size or 0, tuple(i or 0 for i in ids)
        buckets = max(8, -(-size // BUCKET_BYTES))
        classes, mean_list, sets = counted(self.rows, buckets)
        nodes = sets.where("n > 0").groupBy("k1", "k2", "n", "node").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), *[F.any_value(m).alias(m) for m in MARKS])
        nodes = written(nodes, "nodes")
        renamed = _clashes(nodes)
        if renamed:
            table = F.broadcast(docs.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "k1 long, k2 long, other long"))
            nodes, sets = (df.join(table, ["k1", "k2"], "left").withColumn("node", F.coalesce("other", "node")).drop("other") for df in (nodes, sets))
        self.sets, self.nodes, self.renamed = sets, nodes, renamed
        if small is None:
            sizes = {r.n: r["count"] for r in nodes.where(F.col("n") <= MOST_SMALL).groupBy("n").count().collect()}
            small = boundary(sizes, mean_list)
        lists = postings(self.rows, classes, renamed, small, buckets, ids).groupBy("bucket").applyInArrow(_lists(SHORT), "a long, b long, token long, n long, place long")
        lists = written(lists, "lists")
        self.first = written(likely(lists.where("place < 0").select("a", "b").distinct(), nodes), "pairs")
        self.long = lists.where("place >= 0").select("token", "a", "n", "place")
        self.whole = node_sets(self.rows, _ends(self.first), nodes, renamed)
        self.links = verified(self.first, self.whole)

    def later(self, parts: DataFrame | None) -> DataFrame | None:
        """Links that only long lists tell: between components, or all; None if there is nothing to verify."""
        second = written(between_components(self.long, parts, self.nodes).join(self.first, ["a", "b"], "left_anti"), "pairs")
        if second.isEmpty():
            return None
        missing = written(_ends(second).join(self.whole.select("node"), "node", "left_anti"), "missing")
        whole = self.whole if missing.isEmpty() else self.whole.unionByName(node_sets(self.rows, missing, self.nodes, self.renamed))
        return verified(second, whole)


def grouped(docs: DataFrame, key: str = "doc_id", text: str = "text", small: int | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; small: the boundary, by default chosen by cost."""
    join = Join(docs, key, text, small)
    parts = components(join.links)
    more = join.later(parts)
    if more is not None:
        parts = components(join.links.unionByName(more))
    discard(join.whole)
    labelled = join.nodes.join(parts, "node", "left").select("node", "copies", "first_doc", F.coalesce("component", "node").alias("part"))
    least = labelled.groupBy("part").agg(F.min("first_doc").alias("component_id"))
    named = written(labelled.join(least, "part").select("node", "copies", "component_id"), "named")
    # At most HOT_SHARE sets have so many copies: they go to every task, and the join by node has no hot keys.
    total = named.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(named.where(F.col("copies") >= max(1_000, -(-total // HOT_SHARE))).select("node", "component_id"))
    some = join.sets.where("n > 0").select("doc_id", "n", "node")
    empty = join.sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    often = some.join(hot, "node")
    seldom = some.join(hot, "node", "left_anti").join(named.select("node", "component_id"), "node")
    out = often.select("doc_id", "n", "component_id").unionByName(seldom.select("doc_id", "n", "component_id"))
    return out.withColumnRenamed("n", "n_shingles").unionByName(empty)


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", small: int | None = None) -> DataFrame:
    """a and b of every link between two different sets, each set named by its smallest doc_id, a before b.

    All links: their number may grow with the square of a group of near copies, which is the size of the result.
    """
    join = Join(docs, key, text, small)
    more = join.later(None)
    links = (join.links if more is None else join.links.unionByName(more)).distinct()
    names = join.nodes.select("node", "first_doc")
    one = links.join(names.select(F.col("node").alias("a"), F.col("first_doc").alias("x")), "a").join(names.select(F.col("node").alias("b"), F.col("first_doc").alias("y")), "b")
    return one.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS u(i) WHERE len(ws) >= 5
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d),
c AS (SELECT d, min(c) AS c FROM r GROUP BY d)
SELECT documents.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.c AS component_id
FROM documents JOIN c ON c.d = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""
