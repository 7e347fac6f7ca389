"""Judging and text features over streams.

These operators are row-local expressions without state, so they run over a stream as they are. Normalising and
ranking look at all rows: recompute them over what has arrived, for each batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import judging, surface
from ..sources import store


def responses(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """A stream of response files (JSON Lines)."""
    return spark.readStream.schema(store.RESPONSES).option("maxFilesPerTrigger", files_at_once).json(path)


def judged(stream: DataFrame) -> DataFrame:
    return judging.judge(stream)


def scored(stream: DataFrame) -> DataFrame:
    return surface.features(stream)


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, once for each input file, until what is there has been read."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def recompute(stream: DataFrame, checkpoint: str, ranking: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Calls ranking(batch, number) for each batch, for what must see all rows."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(ranking).trigger(availableNow=True).start()
