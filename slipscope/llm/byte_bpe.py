"""Byte-level BPE by overlapping chunks.

Every text is cut into chunks that overlap. Chunks are pre-tokenised in parallel; two neighbours are stitched at the
first pre-token boundary inside their overlap that both found, because the pattern looks only forward: from a common
boundary on, both see the same pre-tokens. The pieces between stitches are then encoded, each on its own. Where an
overlap holds no common boundary (one pre-token longer than the overlap), the neighbours are joined before encoding.
Decoding concatenates the bytes of the ids. Texts no longer than a chunk are one piece and never leave their task; the
chunks of longer ones are written once, dealt out evenly, and join their stitches.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded each for itself;
extra columns are kept if named in ``keep`` (names made here start with ``_bpe``); an empty table gives an empty one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, frugal, portions, written

#: Characters of a chunk and of the part it shares with the next one.
CHUNK, OVERLAP = 32_768, 1_024
#: Characters before a chunk's end whose pre-tokens may depend on what follows.
MARGIN = 8
#: Bytes of a row group of the table of chunks.
ROW_GROUP = 4 << 20


class Vocabulary:
    """Ranks and pattern; builds its encoder and its table of tokens once in each process, also after unpickling."""

    _encoders: dict[int, tiktoken.Encoding] = {}
    _by_id: dict[int, list[bytes]] = {}

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks_file, self.pattern, self.key = ranks_file, pattern, hash((ranks_file, pattern))

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def ranks(self) -> dict[bytes, int]:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks_file.splitlines()) if a}

    def by_id(self) -> list[bytes]:
        if self.key not in self._by_id:
            ranks = self.ranks()
            out = [b""] * (max(ranks.values(), default=-1) + 1)
            for token, i in ranks.items():
                out[i] = token
            self._by_id[self.key] = out
        return self._by_id[self.key]

    def built(self) -> tuple[tiktoken.Encoding, list[bytes]]:
        if self.key not in self._encoders:
            self._encoders[self.key] = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks(), special_tokens={})
        return self._encoders[self.key], self.by_id()


def boundaries(pattern: regex.Pattern, text: str, last: bool) -> list[int]:
    """Ends of pre-tokens where a cut is safe: what precedes is no white space, and what follows can't change them."""
    limit = len(text) if last else len(text) - MARGIN
    return [e for m in pattern.finditer(text) if (e := m.end()) <= limit and not text[e - 1].isspace()]


def _chunks(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, str, bool]]:
    for k, start in enumerate(range(0, len(text), chunk)):
        yield k, start, text[start : start + chunk + overlap], start + chunk >= len(text)


def _ids(encoder: tiktoken.Encoding, text: str) -> bytes:
    return np.asarray(encoder.encode_ordinary(text), dtype="<u4").tobytes()


def _bytes(by_id: list[bytes], ids: bytes) -> bytes:
    return b"".join([by_id[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP, decoded: str | None = None) -> DataFrame:
    """Columns ``keep``, n_tokens long and ids binary (little-endian unsigned 32-bit integers) for every row of df.

    decoded: name of one more column with the bytes of the ids, decoded in the same pass.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    kept = [df[c].alias(f"_bpe_{i}") for i, c in enumerate(keep)]
    names = [f"_bpe_{i}" for i in range(len(keep))]
    carried = "".join(f"{n} {df.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep))
    rows = df.select(*kept, F.coalesce(df[text], F.lit("")).alias("_bpe_text"))
    result = f"{carried}n_tokens long, ids binary" + ", decoded binary" * (decoded is not None)

    def results(head: list[pa.Array], ids: list[bytes], by_id: list[bytes]) -> pa.RecordBatch:
        out = [*head, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
        back = [pa.array([_bytes(by_id, x) for x in ids], pa.binary())] if decoded is not None else []
        return pa.RecordBatch.from_arrays([*out, *back], names=[*names, "n_tokens", "ids", *["decoded"] * len(back)])

    @frugal
    def encode_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, by_id = shared.value.built()
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            for p in portions([len(t) for t in texts]):
                part = batch.slice(p.start, p.stop - p.start)
                yield results(part.columns[: len(names)], [_ids(encoder, t) for t in texts[p]], by_id)

    size = F.char_length("_bpe_text")
    whole = rows.where(size <= chunk).mapInArrow(encode_whole, result)

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i, value in enumerate(batch.column(len(names)).to_pylist()):
                head = [c.slice(i, 1) for c in batch.columns[: len(names)]]
                for k, start, part, last in _chunks(value, chunk, overlap):
                    yield pa.RecordBatch.from_arrays(
                        [*head, pa.array([row], pa.int64()), pa.array([k], pa.int32()), pa.array([start], pa.int64()), pa.array([part]), pa.array([last])],
                        names=[*names, "_bpe_row", "k", "start", "part", "last"],
                    )
                row += 1

    # Written, in row groups that are read apart: rows are named by their place, and these names must not change.
    chunks = rows.where(size > chunk).mapInArrow(cut, f"{carried}_bpe_row long, k int, start long, part string, last boolean")
    chunks = written(chunks, "chunks", **{"parquet.block.size": str(ROW_GROUP)})

    @frugal
    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(shared.value.pattern)
        for batch in batches:
            heads, tails = [], []
            for part, last, start in zip(batch.column("part").to_pylist(), batch.column("last").to_pylist(), batch.column("start").to_pylist()):
                ends = boundaries(pattern, part, last)
                heads.append([start + e for e in ends if e <= overlap])
                tails.append([start + e for e in ends if e >= chunk])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_bpe_row"), batch.column("k"), batch.column("last"), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                names=["_bpe_row", "k", "last", "heads", "tails"],
            )

    # Stitches are found without the texts, which join them afterwards.
    marked = chunks.select("_bpe_row", "k", "start", "part", "last").mapInArrow(pretokenise, "_bpe_row long, k int, last boolean, heads array<long>, tails array<long>")
    order = Window.partitionBy("_bpe_row").orderBy("k")
    common = F.array_intersect("tails", F.lead("heads").over(order))
    stitches = (
        marked.withColumn("cut", F.when(~F.col("last"), F.array_min(common)))
        .withColumn("from", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.lag("cut").over(order)))
        .withColumn("piece", F.sum(F.when(F.col("from").isNull(), 0).otherwise(1)).over(order))
        .withColumn("alone", F.count("*").over(Window.partitionBy("_bpe_row", "piece")) == 1)
        .select("_bpe_row", "k", "from", "cut", "piece", "alone")
    )
    stitched = chunks.join(stitches, ["_bpe_row", "k"])
    one = F.struct("k", "start", "part", "from", "cut")
    some = [F.any_value(n).alias(n) for n in names]
    # A piece joins more chunks than one only where no boundary fell into an overlap.
    single = stitched.where("alone").select("_bpe_row", "piece", *names, F.array(one).alias("parts"))
    several = stitched.where("not alone").groupBy("_bpe_row", "piece").agg(*some, F.collect_list(one).alias("parts"))

    @frugal
    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = shared.value.built()
        for batch in batches:
            out = []
            for parts in batch.column("parts").to_pylist():
                parts.sort(key=lambda p: p["k"])
                first, end = parts[0]["start"], parts[-1]["cut"]
                joined = "".join(p["part"] if p is parts[-1] else p["part"][:chunk] for p in parts)
                out.append(_ids(encoder, joined[(parts[0]["from"] or 0) - first : None if end is None else end - first]))
            yield pa.RecordBatch.from_arrays([*batch.select(["_bpe_row", "piece", *names]).columns, pa.array(out, pa.binary())], names=["_bpe_row", "piece", *names, "piece_ids"])

    pieces = single.unionByName(several).mapInArrow(encode_pieces, f"_bpe_row long, piece long, {carried}piece_ids binary")

    @frugal
    def concatenate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = shared.value.by_id() if decoded is not None else []
        for batch in batches:
            for i in range(batch.num_rows):
                parts = sorted(batch.column(len(names))[i].as_py(), key=lambda p: p["piece"])
                yield results([c.slice(i, 1) for c in batch.columns[: len(names)]], [b"".join(p["piece_ids"] for p in parts)], by_id)

    gathered = pieces.groupBy("_bpe_row").agg(*some, F.collect_list(F.struct("piece", "piece_ids")).alias("all")).select(*names, "all")
    out = whole.unionByName(gathered.mapInArrow(concatenate, result))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "n_tokens", "ids", *([F.col("decoded").alias(decoded)] if decoded is not None else []))


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """df with the bytes of its ids in one more column (in place of one of that name); null ids give null."""
    df = df.drop(to)
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    names = df.columns
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema) + f"`{to}` binary"

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = shared.value.by_id()
        for batch in batches:
            values = batch.column(names.index(ids)).to_pylist()
            for p in portions([len(v or b"") for v in values]):
                out = [None if v is None else _bytes(by_id, v) for v in values[p]]
                yield pa.RecordBatch.from_arrays([*batch.slice(p.start, p.stop - p.start).columns, pa.array(out, pa.binary())], names=[*names, to])

    return df.mapInArrow(run, schema)


def id_list(ids: str | Column) -> Column:
    """The packed ids as array<long>."""
    digits = F.hex(ids)
    n = (F.length(digits) / 8).cast("int")

    def one(i: Column) -> Column:
        at = i * 8 + 1
        little = [F.substr(digits, at + F.lit(2 * b), F.lit(2)) for b in (3, 2, 1, 0)]
        return F.conv(F.concat(*little), 16, 10).cast("long")

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<long>"))


def published_vocabulary() -> Vocabulary:
    """The public 50k byte-level ranks that the queries use; read on the driver and sent to the executors."""
    import public_tokenizers

    return Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def digests(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    out = encode(docs, vocabulary, decoded="decoded")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
