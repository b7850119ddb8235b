"""The first version of each event in a stream. The batch operator keeps the earliest update instead
of the earliest arrival; a stream cannot wait for an update that may never come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_arrivals(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """One row per key within the watermark; state is dropped once the watermark has passed it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
