"""Incremental processing: files are taken once, in batches, and go on after a stop from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(
    spark: SparkSession,
    source: str,
    schema,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    files_per_batch: int = 1,
) -> None:
    """Runs transform over JSON files of source not seen yet and appends Parquet to sink; then ends."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
    query.awaitTermination()


def running_averages(spark: SparkSession, source: str, schema, value: str, name: str) -> None:
    """A memory table `name` of the count and mean of value, updated batch by batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source)
    query = stream.agg(
        F.count(value).alias("n"), F.avg(value).alias("mean")
    ).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
