"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters and digits (points and commas between digits belong to a number). A token becomes a typed
placeholder if it is a number, a unit after a number, or a name (a capitalised token, also at the start of a sentence,
that is none of the common words in OPENERS); all others stay as they are, in lower case. So a token's kind depends on
it and on the number before it only, wherever a question is quoted. Windows of WINDOW tokens are hashed, by their template if it keeps LEAST_LITERALS
tokens or more, else with the tokens themselves, and document windows are joined with benchmark windows by that hash.
As names show by capitals only, a window with a name has a second hash, with names as they are in lower case, so that
copies in small letters or in capitals meet too; the slots of such a match are its numbers and units.
Matches of a document and an item on neighbouring diagonals (each at most SHIFT tokens from the next one, as inserted
and deleted words leave them) make a passage; its slots must be consistent both ways: an item's value, where it comes
again, must have the same counterpart in the document, and no other value of the item may have that counterpart. A passage of a share COVERAGE of the item's windows, with consistent slots,
is a leak; ``changed`` tells that slots differ, so that the question was re-parameterised. Where all matches of a passage
contradict each other, the longest chain of them in the order of both texts is tried, then each diagonal alone, and at last
the windows whose slots are unchanged: a copy in which one value of several alike is replaced is still a copy.

A filter made from all benchmark windows (16 bits for each, 2 ** MOST_BITS at most) goes to every task and keeps nearly
all other windows out of the join; what it lets through wrongly, the join drops. Windows that hold one part in HOT_SHARE
of all matches or more (at most HOT_SHARE of them, so their list goes to every task) are salted by document.

Defined cases: null or empty texts and items have no windows; an item shorter than a window is one window of its own
length; repeated rows and documents that share an id are taken together, documents without an id not at all; extra
columns are ignored; case is folded for ASCII and Latin-1 letters; empty tables give an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import textbatch as tb
from .shared import bounded_batches, frugal, text_portions, written

WINDOW, LEAST_LITERALS, COVERAGE, SHIFT = 8, 4, 0.3, 8
LEAST_BITS, MOST_BITS, SALT, HOT_SHARE = 20, 28, 32, 1_000

# Names of units.
UNITS = """
am cents centimeters cm days dollars euros feet ft g gb gallons grams hours hrs inches kg kilograms kilometers km l
liters lb lbs m mb meters mg miles min minutes ml mm months ms oz percent pm pounds seconds sec tons usd weeks yards
years
""".split()

# Common words that begin sentences and questions: with a capital, they are no names (chosen here).
OPENERS = """
a about after all also an and are as at be because before both but by calculate can choose complete compute consider
could define describe determine did do does during each estimate evaluate every explain express find first for from give
given had has have he her here his how however i if in into is it its let list many more most my name next no not now of
on once one only or other our over prove select she should show simplify since so solve some state such suppose than that
the their them then there these they this those though through thus to two under until use using was we were what when
where whether which while who whom whose why will with within without would write yes yet you your
""".split()

U = np.uint64
NUMBER, UNIT, NAME = 1, 2, 3
_DIGIT, _ALNUM = (np.zeros(256, bool) for _ in range(2))
_DIGIT[48:58] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POINT = np.zeros(256, bool)
_POINT[[*map(ord, ".,")]] = True
_UNITS, _OPENERS = (np.sort(tb.words([" ".join(words).encode()]).hashes()) for words in (UNITS, OPENERS))


def _among(h: np.ndarray, sorted_hashes: np.ndarray) -> np.ndarray:
    return sorted_hashes[np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)] == h


def canonical(texts: list[bytes]) -> tuple[tb.Words, np.ndarray, np.ndarray]:
    """Tokens, their lower-case hashes, and their kinds (0: literal)."""
    data, offsets = tb.joined(texts)
    inside = _ALNUM[data]
    point = np.flatnonzero(_POINT[data])
    point = point[(point > 0) & (point < len(data) - 1)]
    inside[point[_DIGIT[data[point - 1]] & _DIGIT[data[point + 1]]]] = True
    lower = tb.LOWER[data]
    latin = np.flatnonzero(data == 0xC3) + 1
    latin = latin[latin < len(data)]
    capital = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    lower[capital] += 32
    w = tb.runs(lower, offsets, inside)
    h, b, e = w.hashes(), w.begin, w.end
    kinds = np.zeros(len(h), np.int8)
    if not len(h):
        return w, h, kinds
    number = _DIGIT[data[b]]
    kinds[number] = NUMBER
    after = np.zeros(len(h), bool)
    after[1:] = number[:-1]
    starts = w.first[:-1]
    starts = starts[starts < len(h)]
    after[starts] = False
    kinds[after & ~number & _among(h, _UNITS)] = UNIT
    # A name: a capital first, and small letters too (shouting is no name).
    upper_first = (data[b] >= 65) & (data[b] <= 90)
    upper_first |= np.isin(b + 1, capital) & (data[b] == 0xC3)
    small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    kinds[upper_first & (kinds == 0) & (small[e] > small[b]) & ~_among(h, _OPENERS)] = NAME
    return w, h, kinds


def template_windows(w: tb.Words, h: np.ndarray, kinds: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k tokens each, at every token where k follow (across texts too; see tb.within)."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    template = tb.windows(np.where(kinds == 0, h, tb.mix(kinds.astype(np.uint64))), k, 1)
    return np.where(_literals(kinds, k) >= min(LEAST_LITERALS, k), template, tb.windows(h, k)) ^ U(k)


def _literals(kinds: np.ndarray, k: int) -> np.ndarray:
    """How many of the k tokens from each on stay as they are."""
    kept = np.concatenate([[0], np.cumsum(kinds == 0)])
    return kept[k:] - kept[:-k]


def _slots(at: np.ndarray, k: int, h: np.ndarray, kinds: np.ndarray) -> list[list[int]]:
    places = at[:, None] + np.arange(k)[None, :]
    values = np.where(kinds[places] > 0, h[places] | U(1), U(0)).astype(np.int64)
    return [[v for v in row if v] for row in values.tolist()]


def _found(texts: list[bytes], lengths: list[int], bits: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[int]]]]:
    """For each window length, without names and with them: k, text, place in the text, hash, number of the text's tokens, slot values."""
    w, h, kinds = canonical(texts)
    counts = w.counts
    caseless = np.where(kinds == NAME, 0, kinds).astype(kinds.dtype)
    for k in lengths:
        within = tb.within(w.first, k)
        if not len(within):
            continue
        # Windows of few literals are hashed with their tokens, which the caseless hash does as well.
        literals = _literals(kinds, k)
        named = (literals < _literals(caseless, k)) & (literals >= min(LEAST_LITERALS, k))
        for kind, ok in ((caseless, within.copy()), (kinds, within & named)):
            if not ok.any():
                continue
            hashes = template_windows(w, h, kind, k)
            if bits is not None:
                slot = hashes & U(8 * len(bits) - 1)
                ok &= (bits[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & np.uint8(1) == 1
            at = np.flatnonzero(ok)
            owner = np.searchsorted(w.first, at, "right") - 1
            yield k, owner, at - w.first[owner], hashes[at].astype(np.int64), counts[owner], _slots(at, k, h, kind)


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", k: int = WINDOW) -> DataFrame:
    """hash, item_id, ipos, islots, n_windows and k of all windows of all items."""
    bounded_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null")

    def of_texts(texts: list[bytes], ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for length, owner, place, hashes, counts, slots in _found(texts, list(range(1, k + 1)), None):
            # Items of fewer tokens than a window are one window of their own length.
            use = np.flatnonzero((counts >= k) if length == k else (counts == length))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes[use]),
                    pa.array(ids[owner[use]]),
                    pa.array(place[use]),
                    pa.array([slots[i] for i in use], pa.list_(pa.int64())),
                    pa.array(counts[use] - length + 1),
                    pa.array(np.full(len(use), length, np.int32)),
                ],
                names=["hash", "item_id", "ipos", "islots", "n_windows", "k"],
            )

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = tb.encoded(batch.column(1).to_pylist()), batch.column(0).to_numpy()
            for p in text_portions(texts):
                yield from of_texts(texts[p], ids[p])

    return written(rows.mapInArrow(run, "hash long, item_id long, ipos long, islots array<long>, n_windows long, k int"), "benchmark")


#: Place in the document, place in the item, (item's value, document's value) of each slot.
Match = tuple[int, int, list[tuple[int, int]]]


def in_order(matches: list[Match]) -> list[Match]:
    """The longest chain of matches whose places grow in both texts."""
    rows = sorted(matches, key=lambda m: (m[0], -m[1]))
    ends: list[int] = []
    last: list[int] = []
    before = [-1] * len(rows)
    for i, (_, place, _) in enumerate(rows):
        at = bisect_left(ends, place)
        before[i] = last[at - 1] if at else -1
        ends[at : at + 1], last[at : at + 1] = [place], [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(rows[i])
        i = before[i]
    return out[::-1]


def _accepted(matches: Iterable[Match], least: float) -> tuple[int, bool] | None:
    """Windows of the item and whether slots differ, if there are enough and values have one counterpart each, both ways."""
    places, counterpart, back = set(), {}, {}
    for _, place, pairs in matches:
        places.add(place)
        for mine, other in pairs:
            if counterpart.setdefault(mine, other) != other or back.setdefault(other, mine) != mine:
                return None
    return (len(places), any(a != b for a, b in counterpart.items())) if len(places) >= least else None


def _unchanged(matches: Iterable[Match], least: float) -> tuple[int, bool] | None:
    """Windows of the item that are met with their own values; told as changed, since others contradict each other."""
    places = {place for _, place, pairs in matches if all(mine == other for mine, other in pairs)}
    return (len(places), True) if len(places) >= least else None


def passage(matches: list[Match], least: float) -> tuple[int, bool] | None:
    """The same for matches of neighbouring diagonals: all, else the longest chain, else the best diagonal alone, else what is unchanged."""
    found = _accepted(matches, least) or _accepted(in_order(matches), least)
    if found:
        return found
    diagonals = defaultdict(list)
    for m in matches:
        diagonals[m[0] - m[1]].append(m)
    alone = [x for x in (_accepted(d, least) for d in diagonals.values()) if x]
    return min(alone, key=lambda x: (-x[0], x[1])) if alone else _unchanged(matches, least)


def _chained(met: DataFrame, coverage: float) -> DataFrame:
    """doc_id, item_id, coverage and changed of the passages that span diagonals."""
    near = Window.partitionBy("doc_id", "item_id").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(near) > SHIFT
    rows = met.withColumn("far", F.coalesce(far, F.lit(False)).cast("int")).withColumn("chain", F.sum("far").over(near.rangeBetween(Window.unboundedPreceding, 0)))
    match = F.struct((F.col("diagonal") + F.col("ipos")).alias("dpos"), "ipos", "pairs")
    chains = rows.groupBy("doc_id", "item_id", "chain").agg(F.max("n_windows").alias("n_windows"), F.collect_set(match).alias("matches"), F.count_distinct("ipos").alias("n"))
    chains = chains.where(F.col("n") >= coverage * F.col("n_windows")).select("doc_id", "item_id", "n_windows", "matches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, item, n, matches in zip(*(batch.column(i).to_pylist() for i in range(4))):
                found = passage([(m["dpos"], m["ipos"], [(p["islots"], p["dslots"]) for p in m["pairs"]]) for m in matches], coverage * n)
                if found:
                    out.append((doc, item, found[0] / n, found[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["doc_id", "item_id", "coverage", "changed"])

    return chains.mapInArrow(run, "doc_id long, item_id long, coverage double, changed boolean")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage (share of the item's windows) and changed, for each document and item it leaks."""
    spark = docs.sparkSession
    items = benchmark_windows(benchmark)
    lengths = sorted(r.k for r in items.select("k").distinct().collect())
    # At most 2 ** (MOST_BITS - 6) words of 64 bits come back, as columns, however large the benchmark.
    n_bits = min(MOST_BITS, max(LEAST_BITS, (16 * items.count()).bit_length()))
    slot = F.col("hash").bitwiseAND(F.lit((1 << n_bits) - 1))
    words = items.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toArrow()
    filter_ = np.zeros(1 << (n_bits - 6), np.int64)
    filter_[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(filter_.view(np.uint8))
    bounded_batches(spark)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = tb.encoded(batch.column(1).to_pylist()), batch.column(0).to_numpy()
            for p in text_portions(texts):
                for _, owner, place, hashes, _, slots in _found(texts[p], lengths, shared.value):
                    if len(owner):
                        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids[p][owner]), pa.array(place), pa.array(slots, pa.list_(pa.int64()))], names=["hash", "doc_id", "dpos", "dslots"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    found = written(rows.mapInArrow(run, "hash long, doc_id long, dpos long, dslots array<long>"), "found")
    # At most HOT_SHARE keys reach that share, whatever the input.
    hot = found.groupBy("hash").count().where(F.col("count") >= max(10_000, -(-found.count() // HOT_SHARE))).select("hash", F.lit(SALT).alias("salts"))
    hot = F.broadcast(written(hot, "hot"))
    salts = F.coalesce("salts", F.lit(1))
    found = found.join(hot, "hash", "left").withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    spread = items.join(hot, "hash", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    # Of equal hashes only those of the tokens themselves can differ in the number of slots (a unit whose number stands
    # before the window in one text only): their values are the same.
    same = F.when(F.size("islots") == F.size("dslots"), F.col("dslots")).otherwise(F.col("islots"))
    met = found.join(spread, ["hash", "salt"]).select("doc_id", "item_id", (F.col("dpos") - F.col("ipos")).alias("diagonal"), "ipos", "n_windows", F.arrays_zip("islots", same.alias("dslots")).alias("pairs"))
    met = written(met, "met")
    pair = ["doc_id", "item_id"]
    alone = met.groupBy(*pair, "diagonal").agg(F.count_distinct("ipos").alias("n"), F.max("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    for side in ("islots", "dslots"):
        alone = alone.where(F.size(F.array_distinct(F.col(f"pairs.{side}"))) == F.size("pairs"))
    alone = alone.where(F.col("n") >= coverage * F.col("n_windows"))
    alone = alone.withColumn("coverage", F.col("n") / F.col("n_windows")).withColumn("changed", F.exists("pairs", lambda p: p["islots"] != p["dslots"]))
    alone = alone.groupBy(*pair).agg(F.min_by("changed", F.struct(-F.col("coverage"), F.col("changed"))).alias("changed"), F.max("coverage").alias("coverage")).select(*pair, "coverage", "changed")
    # Where all diagonals together have no more windows of the item than the best alone, there is nothing to chain.
    every = met.groupBy(*pair).agg((F.count_distinct("ipos") / F.max("n_windows")).alias("most")).where(F.col("most") >= coverage)
    more = every.join(alone, pair, "left").where("coverage is null or most > coverage").select(*pair)
    passages = alone.unionByName(_chained(met.join(more, pair, "left_semi"), coverage))
    best = passages.groupBy(*pair).agg(F.min(F.struct(-F.col("coverage"), F.col("changed"))).alias("b"), F.max("coverage").alias("coverage"))
    return best.select(*pair, "coverage", F.col("b.changed").alias("changed"))
