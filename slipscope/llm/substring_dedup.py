"""Exact substring deduplication by a log-structured fingerprint index.

An index holds what earlier batches of documents said: their texts, packed into immutable runs of about RUN_BYTES bytes,
and sorted runs of hashes by bucket. A new batch is merge-joined with it, one bucket at a time, and adds runs of its own;
``compact`` merges the runs of each bucket into one. What came in an earlier batch is earlier than what comes in a later
one; within a batch, the smaller document id is, then the smaller start.

1. Every window of WINDOW words has an anchor, the least hash of its groups of GROUP words. Equal windows have equal
   anchors, so only windows whose anchor comes again (in the batch or in the index) can repeat. The index knows each
   anchor; the windows under it are fingerprinted when it first comes again, and only the run that owns it is read then.
2. The windows under such anchors get a 64-bit hash and a 32-bit check from independent functions. Each run is
   compacted to the first place of each window in it, and sorted.
3. Merging all runs of a bucket finds each window's first place; both hashes must agree (verification: 96 bits stand
   for the words). Runs are told in one bit for each of their windows whether it starts earlier elsewhere.
4. Each run marks the words under windows that start earlier, here or elsewhere, and returns what is left.

``deduplicated`` takes one table through an index in batches that are dealt by document id, so that the result is that of
the whole table at once.

Defined cases: a null text has no words; a text shorter than a window keeps all; documents without an id count as later
than all others of their batch; of rows with one id, the smaller start is earlier and equal starts keep both; empty
tables give empty results; extra columns are ignored. A text must fit into a worker's memory (about 30 times its bytes).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import new_path
from . import textbatch as tb
from .shared import bounded_batches, frugal, released

WINDOW, GROUP = 20, 5
RUN_BYTES = 4 << 20
#: Bytes of text whose fingerprints make one bucket, and those that a task takes at a time.
BUCKET_BYTES, TASK_BYTES = 24 << 20, 16 << 20
#: Shares of the documents at whose ids a table is cut into batches: from the third on, the index is compacted first.
CUTS = (0.125, 0.25)
U = np.uint64

_ROW = "kind int, run long, bucket int, n int, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["kind", "run", "bucket", "n", "a", "b", "c", "d", "e"]
#: Of runs: texts, anchors, windows. Told to runs: which of their anchors come again, which anchors to expand, which of
#: their windows start earlier. Of the index: anchors and windows.
TEXT, ANCHORS, REPEATED, EXPAND, WINDOWS, EARLIER, KNOWN = range(7)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in rows], t) for i, t in enumerate(types)], names=_NAMES)


def _table(rows: list[tuple]) -> pa.Table:
    released()
    return pa.Table.from_batches([_batch(rows)])


def _planes(x: np.ndarray) -> bytes:
    """Bytes by significance: those that are mostly zero then compress to nothing."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(data: bytes, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _pack(ids: list[int | None], texts: list[bytes]) -> tuple[bytes, bytes]:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    columns = [np.array(x, "<i8") for x in ([ids[i] or 0 for i in order], [ids[i] is None for i in order], [len(texts[i]) for i in order])]
    blob = b"".join([texts[i] for i in order])
    return b"".join(c.tobytes() for c in columns), zstandard.ZstdCompressor(level=8).compress(blob)


class Run:
    """A run's texts with their words' hashes."""

    def __init__(self, head: bytes, blob: bytes):
        self.ids, self.nameless, lengths = np.frombuffer(head, "<i8").reshape(3, -1)
        data, ends = zstandard.ZstdDecompressor().decompress(blob), np.cumsum(lengths)
        self.words = tb.words([data[e - n : e] for e, n in zip(ends, lengths)])
        self.h = self.words.hashes()
        self.ok = tb.within(self.words.first, WINDOW)

    def groups(self) -> np.ndarray:
        return tb.windows(self.h, GROUP)

    def anchors(self) -> np.ndarray:
        """The anchor of every window. Anchors are minima: mixed again, they fill the buckets evenly."""
        least, width = self.groups(), 1
        while 2 * width <= WINDOW - GROUP + 1:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        rest = WINDOW - GROUP + 1 - width
        return tb.mix(np.minimum(least[: len(least) - rest], least[rest:]) if rest else least)

    def again(self, anchors: np.ndarray) -> np.ndarray:
        """Which of the sorted distinct anchors come twice or more in the run."""
        every = np.sort(tb.mix(self.groups()[tb.within(self.words.first, GROUP)]))
        if len(every) < 2:
            return np.zeros(len(anchors), bool)
        return every[np.minimum(np.searchsorted(every, anchors) + 1, len(every) - 1)] == anchors

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the document has no id, its id, and the start within it."""
        owner = np.searchsorted(self.words.first, at, "right") - 1
        return self.nameless[owner].astype(np.int8), self.ids[owner], (at - self.words.first[owner]).astype("<u4")

    def under(self, anchors: np.ndarray) -> np.ndarray:
        """Windows under the given sorted anchors."""
        if not len(anchors) or not self.ok.any():
            return np.empty(0, np.int64)
        mine = self.anchors()
        return np.flatnonzero(self.ok & (anchors[np.minimum(np.searchsorted(anchors, mine), len(anchors) - 1)] == mine))

    def fingerprints(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and checks of the windows."""
        return tb.windows(self.h, WINDOW)[at], (tb.windows(self.words.hashes(1), WINDOW, 1)[at] >> U(32)).astype("<u4")


def _by_bucket(sorted_hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    b = ((sorted_hashes >> U(32)) * U(buckets) >> U(32)).astype(np.int32)
    cuts = np.flatnonzero(np.diff(b, prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(b)]):
        yield int(b[lo]), slice(int(lo), int(hi))


def _earliest(h: np.ndarray, check: np.ndarray, late: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by window then place; which of its entries are later than their window's first place; where that is."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if same.any():
        touched = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        some = order[touched]
        order[touched] = some[np.lexsort((start[some], doc[some], late[some], check[some], h[some]))]
    hs, cs = h[order], check[order]
    new = np.ones(len(order), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.empty(0, np.int64)
    first = order[lead]
    return order, (late[order] != late[first]) | (doc[order] != doc[first]) | (start[order] != start[first]), lead


def packed(docs: DataFrame, buckets: int, number: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Runs of documents, and the sorted anchors of each run by bucket. number: that of the batch."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    run_bytes = RUN_BYTES

    def emit(run: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        head, blob = _pack(ids, texts)
        yield _batch([(TEXT, run, -1, len(ids), head, blob)])
        r = Run(head, blob)
        mine = np.unique(r.anchors()[r.ok])
        again = r.again(mine)
        for b, part in _by_bucket(mine, buckets):
            yield _batch([(ANCHORS, run, b, part.stop - part.start, mine[part].tobytes(), _bits(again[part]))])

    @frugal
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, ids, texts, size = number << 52 | TaskContext.get().partitionId() << 24, [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), tb.encoded(batch.column(1).to_pylist())):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= run_bytes:
                    yield from emit(run, ids, texts)
                    run, ids, texts, size = run + 1, [], [], 0
        if ids:
            yield from emit(run, ids, texts)

    return rows.mapInArrow(pack, _ROW)


def _of(table: pa.Table, *kinds: int) -> list[dict]:
    return [r for r in table.select(_NAMES).to_pylist() if r["kind"] in kinds]


def _united(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of the index's runs of a bucket, sorted: whether expanded, and the run that owns them (if not)."""
    h = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows] or [np.empty(0, np.uint64)])
    expanded = np.concatenate([_unbits(r["b"], r["n"]) for r in rows] or [np.empty(0, bool)])
    owner = np.concatenate([_unplanes(r["c"], "<i8") for r in rows] or [np.empty(0, np.int64)])
    if not len(h):
        return h, expanded, owner
    order = np.argsort(h, kind="stable")
    h, first = np.unique(h[order], return_index=True)
    return h, np.logical_or.reduceat(expanded[order], first), np.maximum.reduceat(owner[order], first)


def _known_anchors(bucket: int, h: np.ndarray, expanded: np.ndarray, owner: np.ndarray) -> tuple:
    return KNOWN, -1, bucket, len(h), h.tobytes(), _bits(expanded), _planes(np.where(expanded, -1, owner).astype("<i8"))


def _matched(table: pa.Table) -> pa.Table:
    """Merge of a bucket's anchors, of the batch and of the index: what its runs and the index's are told, and a new run of the index."""
    bucket, rows = table.column("bucket")[0].as_py(), _of(table, ANCHORS)
    known, expanded, owner = _united(_of(table, KNOWN))
    if not rows:
        return _table([])
    h = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows])
    again = np.concatenate([_unbits(r["b"], r["n"]) for r in rows])
    runs, n = np.array([r["run"] for r in rows], np.int64), [r["n"] for r in rows]
    who = np.repeat(np.arange(len(rows)), n)
    distinct, back, times = np.unique(h, return_inverse=True, return_counts=True)
    twice = times > 1
    np.logical_or.at(twice, back, again)
    at = np.minimum(np.searchsorted(known, distinct), max(len(known) - 1, 0))
    old = known[at] == distinct if len(known) else np.zeros(len(distinct), bool)
    comes = (twice | old)[back]
    first = np.concatenate([[0], np.cumsum(n)])
    out = [(REPEATED, int(r), bucket, int(hi - lo), _bits(comes[lo:hi])) for r, lo, hi in zip(runs, first, first[1:])]
    fresh = np.zeros(0, np.int64)
    if len(known):
        fresh = np.unique(at[old])
        fresh = fresh[~expanded[fresh]]
        for o in np.unique(owner[fresh]):
            mine = fresh[owner[fresh] == o]
            out.append((EXPAND, int(o), bucket, len(mine), known[mine].tobytes()))
    holder = np.full(len(distinct), -1, np.int64)
    holder[back] = runs[who]
    add = np.concatenate([distinct[~old], known[fresh]]) if len(known) else distinct
    marks = np.concatenate([twice[~old], np.ones(len(fresh), bool)])
    holder = np.concatenate([holder[~old], np.full(len(fresh), -1)])
    order = np.argsort(add)
    out.append(_known_anchors(bucket, add[order], marks[order], holder[order]))
    return _table(out)


def _repeats(r: Run, told: list[dict], buckets: int) -> np.ndarray:
    """The run's anchors that come again, sorted, from one bit for each."""
    flags = {x["bucket"]: x for x in told}
    mine = np.unique(r.anchors()[r.ok])
    return np.concatenate([mine[part][_unbits(flags[b]["a"], flags[b]["n"])] for b, part in _by_bucket(mine, buckets) if b in flags] or [np.empty(0, np.uint64)])


def _sorted_windows(r: Run, anchors: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows under the anchors in the order of their hashes, with hash, check and place, and whether and after which they are later."""
    at = r.under(anchors)
    h, check = r.fingerprints(at) if len(at) else (np.empty(0, np.uint64), np.empty(0, "<u4"))
    place = r.places(at)
    order, later, lead = _earliest(h, check, *place)
    return at[order], h[order], check[order], *(p[order] for p in place), later, lead


def _text(table: pa.Table) -> Run | None:
    rows = table.select(_NAMES).to_pylist()
    return Run(rows[0]["a"], rows[0]["b"]) if rows else None


def _windows_of(buckets: int):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        """A run's windows under repeated anchors, compacted to first places, sorted, by bucket."""
        r, out = _text(texts), []
        if r is not None and told.num_rows and r.ok.any():
            number = told.column("run")[0].as_py()
            expand = _of(told, EXPAND)
            anchors = np.sort(np.concatenate([np.frombuffer(x["a"], np.uint64) for x in expand])) if expand else _repeats(r, _of(told, REPEATED), buckets)
            _, h, check, late, doc, start, later, lead = _sorted_windows(r, anchors)
            # The index needs no places: all of it is earlier than the batch.
            keep = np.unique(lead) if expand else np.flatnonzero(~later)
            h, check, late, doc, start = (x[keep] for x in (h, check, late, doc, start))
            for b, p in _by_bucket(h, buckets):
                place = (None, None, None) if expand else (_planes(doc[p].astype("<i8")), _planes(start[p]), _planes(late[p]))
                out.append((KNOWN if expand else WINDOWS, number, b, p.stop - p.start, h[p].tobytes(), check[p].tobytes(), *place))
        return _table(out)

    return run


def _merged(append: bool):
    def run(table: pa.Table) -> pa.Table:
        """Merge of a bucket's windows: to each run, which of its windows start earlier; and a new run of the index."""
        bucket, rows, known = table.column("bucket")[0].as_py(), _of(table, WINDOWS), _of(table, KNOWN)
        h = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in [*rows, *known]])
        check = np.concatenate([np.frombuffer(r["b"], "<u4") for r in [*rows, *known]])
        n = [r["n"] for r in rows]
        rest = len(h) - sum(n)
        doc, start, late = (np.concatenate([*(_unplanes(r[c], t) for r in rows), np.full(rest, v, t)]) for c, t, v in (("c", "<i8", 0), ("d", "<u4", 0), ("e", "<i1", -1)))
        order, later, lead = _earliest(h, check, late, doc, start)
        lost = np.zeros(len(h), bool)
        lost[order[later]] = True
        first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        out = [(EARLIER, r["run"], bucket, int(hi - lo), _bits(lost[lo:hi])) for r, lo, hi in zip(rows, first, first[1:]) if lost[lo:hi].any()]
        if append:
            # What the index has already (run -1) is not added again; what was expanded just now is.
            have = np.concatenate([np.ones(sum(n), bool), *(np.full(r["n"], r["run"] >= 0) for r in known)])
            old = np.zeros(len(h), bool)
            np.logical_or.at(old, lead, ~have[order])
            heads = np.unique(lead)
            add = order[heads[~old[heads]]]
            out.append((KNOWN, -1, bucket, len(add), h[add].tobytes(), check[add].tobytes()))
        return _table(out)

    return run


def _kept(buckets: int):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        """A run's documents without the words of windows that start earlier."""
        r = _text(texts)
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
        if r is None:
            return schema.empty_table()
        w = r.words
        covered = np.zeros(len(w.begin) + 1, np.int64)
        if r.ok.any() and told.num_rows:
            at, h, _, _, _, _, later, lead = _sorted_windows(r, _repeats(r, _of(told, REPEATED), buckets))
            flags, sent = {x["bucket"]: x for x in _of(told, EARLIER)}, np.flatnonzero(~later)
            lost = np.zeros(len(at), bool)
            for b, p in _by_bucket(h[sent], buckets):
                if b in flags:
                    lost[sent[p]] = _unbits(flags[b]["a"], flags[b]["n"])
            gone = at[later | lost[lead]]
            np.add.at(covered, gone, 1)
            np.add.at(covered, gone + WINDOW, -1)
        out = np.cumsum(covered)[:-1] > 0
        # Kept words with one blank after each; the byte after a word is white space in any case.
        stay, data = ~out, w.data.copy()
        data[w.end[stay]] = 0x20
        edge = np.zeros(len(data) + 2, np.int8)
        np.add.at(edge, w.begin[stay], 1)
        np.add.at(edge, w.end[stay] + 1, -1)
        flat = data[np.cumsum(edge, dtype=np.int8)[: len(data)] > 0].tobytes()
        size = np.concatenate([[0], np.cumsum(np.where(stay, w.end - w.begin + 1, 0))])[w.first]
        kept = [flat[lo : max(lo, hi - 1)].decode() for lo, hi in zip(size, size[1:])]
        removed = np.concatenate([[0], np.cumsum(out)])[w.first]
        columns = [pa.array(r.ids, pa.int64(), mask=r.nameless > 0), pa.array(w.counts, pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(kept, pa.string())]
        released()
        return pa.Table.from_arrays(columns, schema=schema)

    return run


def _compacted_anchors(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        h, expanded, owner = _united(_of(table, KNOWN))
        return _table([_known_anchors(b, h[p], expanded[p], owner[p]) for b, p in _by_bucket(h, buckets)])

    return run


def _compacted_windows(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        rows = _of(table, KNOWN)
        both = np.concatenate([np.rec.fromarrays([np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], "<u4")]) for r in rows])
        both = np.unique(both)
        h, check = both["f0"], both["f1"]
        return _table([(KNOWN, -1, b, p.stop - p.start, h[p].tobytes(), check[p].tobytes()) for b, p in _by_bucket(h, buckets)])

    return run


class Index:
    """An index in a folder. Tables in it are never changed: a batch and a compaction add new ones, and a new list of those that count."""

    def __init__(self, spark: SparkSession, path: str, meta: dict):
        self.spark, self.path, self.meta = spark, path, meta

    @classmethod
    def create(cls, spark: SparkSession, path: str, expected_bytes: int = 0) -> Index:
        """An empty index; expected_bytes: of the texts that will come, which sets the number of buckets (compaction adapts it)."""
        return cls(spark, path, {"version": 0, "batches": 0, "bytes": 0, "buckets": max(8, -(-expected_bytes // BUCKET_BYTES)), "runs": [], "anchors": [], "windows": []})._saved()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        """The index as the last step that came to its end left it."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/list-*/_SUCCESS")
        found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
        last = max(str(f.getPath().getParent().getName()) for f in found)
        return cls(spark, path, json.loads(spark.read.text(f"{path}/{last}").first()[0]))

    def _saved(self) -> Index:
        self.spark.createDataFrame([(json.dumps(self.meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/list-{self.meta['version']:08d}")
        return self

    def _next(self, **changed) -> Index:
        return Index(self.spark, self.path, self.meta | changed | {"version": self.meta["version"] + 1})._saved()

    def _read(self, *names: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], _ROW)
        return self.spark.read.schema(_ROW).parquet(*[f"{self.path}/{n}" for n in names])

    def _write(self, df: DataFrame, name: str) -> str:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return name

    def known(self, which: str) -> DataFrame:
        return self._read(*self.meta[which]).where(F.col("kind") == KNOWN)

    def merge(self, docs: DataFrame, key: str = "doc_id", text: str = "text", append: bool = True) -> tuple[DataFrame, Index]:
        """doc_id, n_words, n_removed and kept of a batch; and the index with it (append: else the same as before)."""
        buckets, number, spark = self.meta["buckets"], self.meta["batches"], self.spark
        size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
        tasks = max(8, -(-(self.meta["bytes"] + size) // TASK_BYTES))
        name = f"step-{self.meta['version']}"
        runs = self._write(packed(docs, buckets, number, key, text), f"{name}-runs")
        texts, anchors = (self._read(runs).where(F.col("kind") == k) for k in (TEXT, ANCHORS))
        deal = lambda df, by: df.repartition(tasks, by)
        matched = self._write(deal(anchors.unionByName(self.known("anchors")), "bucket").groupBy("bucket").applyInArrow(_matched, _ROW), f"{name}-anchors")
        told = self._read(matched)
        repeated, expand = (told.where(F.col("kind") == k) for k in (REPEATED, EXPAND))
        together = lambda t, a, f, schema: deal(t, "run").groupBy("run").cogroup(deal(a, "run").groupBy("run")).applyInArrow(f, schema)
        windows = together(texts, repeated, _windows_of(buckets), _ROW)
        if self.meta["runs"]:
            # Only runs of the index that own an anchor which now comes again are read.
            before = self._read(*self.meta["runs"]).where(F.col("kind") == TEXT).join(expand.select("run").distinct(), "run", "left_semi").select(_NAMES)
            windows = windows.unionByName(together(before, expand, _windows_of(buckets), _ROW)).unionByName(self.known("windows"))
        merged = deal(windows, "bucket").groupBy("bucket").applyInArrow(_merged(append), _ROW)
        after = self
        if append:
            merged_name = self._write(merged, f"{name}-windows")
            merged = self._read(merged_name)
            after = self._next(batches=number + 1, bytes=self.meta["bytes"] + size, runs=[*self.meta["runs"], runs], anchors=[*self.meta["anchors"], matched], windows=[*self.meta["windows"], merged_name])
        answers = repeated.unionByName(merged.where(F.col("kind") == EARLIER))
        kept = together(texts, answers, _kept(buckets), "doc_id long, n_words long, n_removed long, kept string")
        return kept, after

    def compact(self) -> Index:
        """The index with one sorted run for each bucket, in as many buckets as its texts ask for."""
        buckets = max(self.meta["buckets"], -(-self.meta["bytes"] // BUCKET_BYTES))
        name, tasks = f"step-{self.meta['version']}", max(8, -(-self.meta["bytes"] // TASK_BYTES))
        out = {}
        for which, step in (("anchors", _compacted_anchors(buckets)), ("windows", _compacted_windows(buckets))):
            rows = self.known(which).repartition(tasks, "bucket").groupBy("bucket").applyInArrow(step, _ROW)
            out[which] = [self._write(rows, f"{name}-{which}")]
        return self._next(buckets=buckets, **out)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", cuts: tuple[float, ...] = CUTS) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by blanks) of every document.

    The table goes through an index in batches, cut where the given shares of the ids lie.
    """
    spark = docs.sparkSession
    size, ends = docs.agg(F.sum(F.octet_length(F.col(text))), F.percentile_approx(F.col(key).cast("long"), F.array(*[F.lit(c) for c in cuts]))).first()
    index = Index.create(spark, new_path(spark, "index"), size or 0)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    batch, low, out = F.lit(True), None, None
    for i, end in enumerate([*sorted(set(ends or [])), None]):
        batch = F.lit(True) if low is None else F.col("doc_id") >= low
        batch = batch & (F.col("doc_id") < end) if end is not None else batch | F.col("doc_id").isNull()
        if i > 1:
            index = index.compact()
        kept, index = index.merge(rows.where(batch), append=end is not None)
        out, low = kept if out is None else out.unionByName(kept), end
    return out


def digests(docs: DataFrame) -> DataFrame:
    return deduplicated(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, s, array_to_string(ws[s : s + 19], ' ') AS win FROM w, unnest(range(1, greatest(len(ws) - 18, 1))) AS u(s) WHERE len(ws) >= 20),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS r FROM x),
g AS (SELECT DISTINCT doc_id, s + k AS i FROM f, unnest(range(0, 20)) AS u(k) WHERE r > 1),
l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
k AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END AS kept
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
