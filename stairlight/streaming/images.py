"""Images as they arrive in a folder. Every stage is per image, so a stream needs neither state nor watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import images


def rasters(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of rasters of the PNG files of a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.png").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return images.decode(files)


def run(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Apply a per-image stage to all that has arrived and append the results as Parquet."""
    return stage(stream).writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
