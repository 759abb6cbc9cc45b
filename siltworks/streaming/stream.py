"""The same pipelines on streams: stateless steps, replayed from a checkpoint, into a sink that takes a batch once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import Step, lower


def text_stream(spark: SparkSession, path: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(path)


def table_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run(stream: DataFrame, steps: Sequence[Step], out: str, checkpoint: str, text: str = "text") -> StreamingQuery:
    """Runs what is there now and ends. Offsets are committed in the checkpoint and files in the sink's own log, so a run that was cut short
    is replayed from where it was, and no row is written twice."""
    rows = lower(stream, steps, text)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> list[int]:
    """Rows of each batch so far."""
    return [p["numInputRows"] for p in query.recentProgress]
