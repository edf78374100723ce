"""Axis calibration ticks: two labelled ticks an axis, resolved to their boxes and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import validate

BOX = ["x", "y", "x1", "x2", "y1", "y2"]


def resolve(ticks: DataFrame, label: DataFrame) -> DataFrame:
    """ticks (image_id, label, value) with the box of their first finding of that label; null where unknown."""
    order = F.struct("y1", "x1", "word") if "word" in label.columns else F.struct("y1", "x1")
    first = label.groupBy("image_id", "label").agg(F.min_by(F.struct(*BOX), order).alias("b"))
    return ticks.join(first, ["image_id", "label"], "left").select("image_id", "label", "value", *[F.col(f"b.{c}").alias(c) for c in BOX])


def misaligned(axis: DataFrame, across: str) -> DataFrame:
    """Pairs of ticks whose centroids do not lie in each other's box; across is `y` for the x axis, else `x`."""
    a, b = axis.alias("a"), axis.alias("b")
    pairs = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.value") < F.col("b.value")))
    inside = lambda p, q: F.col(f"{p}.{across}").between(F.col(f"{q}.{across}1"), F.col(f"{q}.{across}2"))
    return pairs.filter(~(inside("a", "b") & inside("b", "a"))).select(F.col("a.image_id").alias("image_id"), F.col("a.label").alias("first"), F.col("b.label").alias("second"))


def calibrate(spec: DataFrame, label: DataFrame) -> tuple[DataFrame, DataFrame]:
    """x_axis and y_axis of every image, two rows each, by value."""
    ticks, rules = {}, []
    for axis in ("x", "y"):
        names, values = F.col(f"{axis}_label"), F.col(f"{axis}_value")
        zipped = spec.select("image_id", F.inline(F.arrays_zip(names, values)))
        ticks[axis] = zipped.select("image_id", F.col(f"{axis}_label").alias("label"), F.col(f"{axis}_value").cast("double").alias("value"))
        rules += [
            (spec.filter(F.coalesce((F.size(names) != 2) | (F.size(values) != 2), F.lit(True))), "image_id", f"{axis}_label and {axis}_value must both have length exactly 2: {{}}"),
            (ticks[axis].filter("label is null or value is null or isnan(value) or abs(value) = double('inf')"), "image_id", f"{axis}_label or {axis}_value has a missing entry: {{}}"),
            (ticks[axis].groupBy("image_id").agg(F.count_distinct("label").alias("n"), F.count_distinct("value").alias("m")).filter("n < 2 or m < 2"), "image_id", f"the two ticks of the {axis}-axis are one label or one value: {{}}"),
            (validate.unknown(ticks[axis], label, ["image_id", "label"]), "label", "Unknown labels not in OCR data: {}"),
        ]
    found = {axis: resolve(ticks[axis], label) for axis in ("x", "y")}
    rules.append((validate.shared(ticks["x"], ticks["y"], ["image_id", "label"]), "label", "x_label and y_label share labels: {}"))
    for axis, across in (("x", "y"), ("y", "x")):
        bad = misaligned(found[axis], across).withColumn("pair", F.concat_ws(" and ", "first", "second"))
        rules.append((bad, "pair", f"the boxes of the two {axis}-axis ticks are not aligned: {{}}"))
    validate.check(rules)
    return found["x"].orderBy("image_id", "value"), found["y"].orderBy("image_id", "value")


def band(x_axis: DataFrame, y_axis: DataFrame, window: float = 4) -> DataFrame:
    """Per image: y_axis_column and x_axis_row (where the search begins), median tick height and band width."""
    heights = x_axis.unionByName(y_axis).groupBy("image_id").agg(F.median(F.col("y2") - F.col("y1")).alias("median_height"))
    column = y_axis.groupBy("image_id").agg(F.max("x2").alias("y_axis_column"))
    row = x_axis.groupBy("image_id").agg(F.min("y1").alias("x_axis_row"))
    return heights.join(column, "image_id").join(row, "image_id").withColumn("band", F.greatest(F.lit(1), F.ceil(F.lit(float(window)) * F.col("median_height")).cast("int")))
