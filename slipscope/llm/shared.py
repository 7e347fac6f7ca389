"""Session helpers: tables in the shared folder, and Arrow batches that stay small when texts are long."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.store import discard, shared_dir
from ..sources.store import staged as written

__all__ = ["bounded_batches", "discard", "documents", "frugal", "portions", "released", "shared_dir", "text_portions", "written"]

#: Bytes of an Arrow batch, for sessions that don't set a bound of their own; and bytes of text worked on at a time.
BATCH_BYTES, PORTION_BYTES = 4 << 20, 1 << 20
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20




def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the session has a bound of its own.

    The value is the same for all operators and only bounds memory: no result depends on how rows are dealt into batches,
    and what runs on a batch takes it in portions.
    """
    given = spark.conf.get(_BATCH_KEY, None)
    if given is None or given.rstrip("bB") == str(_BATCH_DEFAULT):
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


def portions(sizes: list[int], most: int = PORTION_BYTES) -> Iterator[slice]:
    """Runs of rows of about ``most`` bytes (a row at least), so that arrays made of them stay small."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def text_portions(texts: list[bytes], most: int = PORTION_BYTES) -> Iterator[slice]:
    return portions([len(t) for t in texts], most)


def released() -> None:
    """Give memory that nothing uses back to the system: idle workers live on beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frugal(run: Run) -> Run:
    """The function of mapInArrow, its worker's memory given back when a task is done."""

    @wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return inner


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
