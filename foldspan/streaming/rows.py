"""Row operators on streams. Whatever works on a row by itself takes a streaming frame unchanged; what needs other rows
(ranks, quantiles, reports) is refused by Spark there and belongs in a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from foldspan.operators.evidence import annotated


def stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 64) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def run(df: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends operator(df) to a Parquet table, each row exactly once over restarts; once drains what is there and ends."""
    writer = operator(df).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_hits(df: DataFrame) -> DataFrame:
    """Matches, score and tier of arriving hits."""
    return annotated(df)
