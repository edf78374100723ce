"""Image folders as rasters. PNG and JPEG come through Spark's image source; SVG has no decoder here."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text
from ..operators import kernels as K
from ..schemas import TABLES, DataError
from . import png

KINDS = ("png", "svg", "jpg", "jpeg")


def register(spark: SparkSession, path: str) -> DataFrame:
    """image_id (the file's path) and kind of the files of a folder; raises on any other kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("image_id"), text.extension(F.col("path")).alias("kind"))
    bad = [r["image_id"] for r in files.filter(~F.col("kind").isin(*KINDS)).limit(5).collect()]
    if bad:
        raise DataError(f"image files must be one of {', '.join(KINDS)}: {', '.join(bad)}")
    return files


def _rgb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            values = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.channels)
            values = np.repeat(values, 3, 2) if r.channels == 1 else np.concatenate([values[..., 2::-1], values[..., 3:]], 2)
            out.append((r.image_id, r.height, r.width, png.over_white(values).tobytes()))
        yield pd.DataFrame(out, columns=["image_id", "height", "width", "data"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rasters of all PNG and JPEG files of a folder, transparency over white; raises on a file that does not decode."""
    raw = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(path)
    raw = raw.select(F.col("image.origin").alias("image_id"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    checked = raw.withColumn("height", F.when(F.col("height") > 0, F.col("height")).otherwise(F.raise_error(F.concat(F.lit("not a readable image: "), "image_id")).cast("int")))
    return checked.mapInPandas(_rgb, TABLES["raster"])


def decode(files: DataFrame) -> DataFrame:
    """Rasters of binaryFile rows (path, content), PNG only; also for streams."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rgb = png.decode(bytes(r.content))
                out.append((r.path, rgb.shape[0], rgb.shape[1], rgb.tobytes()))
            yield pd.DataFrame(out, columns=["image_id", "height", "width", "data"])

    return files.select("path", "content").mapInPandas(run, TABLES["raster"])


def encode(rasters: DataFrame) -> DataFrame:
    """image_id and png (bytes)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"image_id": pdf["image_id"], "png": [png.encode(K.to_array(r.data, r.height, r.width)) for r in pdf.itertuples()]})

    return rasters.select("image_id", "height", "width", "data").mapInPandas(run, "image_id string, png binary")
