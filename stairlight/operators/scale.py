"""Pixels to (time, survival): calibration, range, direction, canonical form. All SQL; axes are two rows an image."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, functions as F

from ..schemas import require
from . import validate

TOLERANCE = sys.float_info.epsilon**0.5


def calibration(points: DataFrame, keys: list[str], pixel: str = "pixel", value: str = "value") -> DataFrame:
    """Least squares slope and intercept of value on pixel per key; null where pixels do not differ."""
    # the pixel's variance is tested on its range: a sum of squares can be positive by rounding alone
    varies = F.max(pixel) > F.min(pixel)
    return points.groupBy(*keys).agg(F.when(varies, F.regr_slope(value, pixel)).alias("slope"), F.when(varies, F.regr_intercept(value, pixel)).alias("intercept"), F.count(F.lit(1)).alias("n"))


def assert_calibrated(found: DataFrame) -> None:
    validate.check([(found.filter("n < 2"), "image_id", "an axis needs two calibration points or more: {}"), (found.filter("slope is null"), "image_id", "All pixel coordinates of an axis are identical: {}")])


def direction(points: DataFrame, keys: list[str]) -> DataFrame:
    """max_y (100 or 1) and whether the pooled line rises over the range by more than rounding."""
    rise = F.regr_slope("y", "x") * (F.max("x") - F.min("x"))
    out = points.groupBy(*keys).agg(F.when(F.max("y") > 1.5, 100.0).otherwise(1.0).alias("max_y"), F.coalesce(rise > F.lit(TOLERANCE) * F.greatest(F.lit(1.0), F.max(F.abs("y"))), F.lit(False)).alias("increasing"))
    return out


def scale(path: DataFrame, x_axis: DataFrame, y_axis: DataFrame, legend: DataFrame) -> DataFrame:
    """The scaled table: an origin (0, 1) per series, then its pixels at x >= 0, survival on 0 to 1."""
    require(path, "data_path", ["image_id", "x", "y", "color"])
    require(legend, "legend", ["image_id", "series", "color"])
    validate.check([(validate.unknown(path, legend, ["image_id", "color"]), "color", "the path has colours not in legend: {}")])
    fits = []
    for axis, pixel, short in ((x_axis, "x", "a"), (y_axis, "y", "b")):
        found = calibration(axis, ["image_id"], pixel)
        assert_calibrated(found)
        fits.append(found.select("image_id", F.col("slope").alias(f"{short}_slope"), F.col("intercept").alias(f"{short}_at")))
    named = path.join(legend.select("image_id", "series", "color"), ["image_id", "color"])
    data = named.join(fits[0], "image_id").join(fits[1], "image_id")
    data = data.select("image_id", "series", (F.col("a_slope") * F.col("x") + F.col("a_at")).alias("x"), (F.col("b_slope") * F.col("y") + F.col("b_at")).alias("y"))
    return canonical(data)


def canonical(data: DataFrame) -> DataFrame:
    """Points in data units (image_id, series, x, y) as survival on 0 to 1 from an origin on. Order: series, x, y
    descending."""
    how = direction(data, ["image_id"])
    data = data.join(how, "image_id")
    y = F.col("y") / F.col("max_y")
    data = data.withColumn("y", F.when(F.col("increasing"), 1 - y).otherwise(y))
    origin = data.select("image_id", "series", F.lit(0.0).alias("x"), F.lit(1.0).alias("y"), "max_y", "increasing").distinct()
    return origin.unionByName(data.filter("x >= 0").select(*origin.columns))


def in_order(scaled: DataFrame) -> DataFrame:
    return scaled.orderBy("image_id", "series", "x", F.desc("y"))
