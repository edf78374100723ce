"""Raster operators on the pixel relation (image_id, x, y, color): 1-based, origin top left, y downward.

Everything is keyed by image and pixel, so many figures spread over the cluster; a figure is under a million pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import colors

POINT = ["image_id", "x", "y"]


def mask(pixels: DataFrame, rectangles: DataFrame, initial: bool = True, background: str | None = None) -> DataFrame:
    """Pixels with those that are masked out turned to the background. rectangles (image_id, ord, x1, x2, y1, y2,
    keep): the last one that covers a pixel decides; else initial. They are few per image and join by image."""
    each = rectangles.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "x1", "x2", "y1", "y2", "keep"))).alias("rects"))
    out = pixels.join(each, "image_id", "left")
    covers = lambda r: F.col("x").between(r["x1"], r["x2"]) & F.col("y").between(r["y1"], r["y2"])
    last = F.aggregate(F.coalesce("rects", F.array().cast(each.schema["rects"].dataType)), F.lit(initial), lambda kept, r: F.when(covers(r), r["keep"]).otherwise(kept))
    out = out.withColumn("_keep", last)
    if background is None:
        out = out.join(colors.most_frequent(pixels), "image_id")
    else:
        out = out.withColumn("background", F.lit(background))
    return out.select(*POINT, F.when(F.col("_keep"), F.col("color")).otherwise(F.col("background")).alias("color"))


def classify(pixels: DataFrame, background: str, series: list[str], garbage: list[str] = ()) -> DataFrame:
    """Every pixel takes the nearest palette colour; garbage becomes background."""
    palette = [background, *series, *garbage]
    if len(set(palette)) != len(palette):
        raise ValueError("series, garbage, and background must all be unique")
    named = colors.nearest(pixels, "color", [(c, c) for c in palette], "nearest")
    return named.select(*POINT, F.when(F.col("nearest").isin(list(garbage)), F.lit(background)).otherwise(F.col("nearest")).alias("color")) if garbage else named.select(*POINT, F.col("nearest").alias("color"))


def foreground(pixels: DataFrame) -> DataFrame:
    """Pixels that are not of the image's most frequent colour (of a two-colour image: the ink)."""
    return pixels.join(colors.most_frequent(pixels), "image_id").filter("color <> background").select(*POINT, "color")


def edges(points: DataFrame) -> DataFrame:
    """4-neighbour pairs of points, each once: to the right and down. Two equality joins on the pixel."""
    a = points.select("image_id", F.col("x").alias("x1"), F.col("y").alias("y1"))
    out = []
    for dx, dy in ((1, 0), (0, 1)):
        b = points.select("image_id", (F.col("x") - dx).alias("x1"), (F.col("y") - dy).alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        out.append(a.join(b, ["image_id", "x1", "y1"]))
    return out[0].unionByName(out[1])


def edge_costs(points: DataFrame, target: str = "target") -> DataFrame:
    """Edges with cost 1 / mean conductance: 1 between target pixels, 1/0.55 to another, 10 between others."""
    value = lambda c: F.when(F.col(c), 1.0).otherwise(0.1)
    a = points.select("image_id", F.col("x").alias("x1"), F.col("y").alias("y1"), value(target).alias("g1"))
    b = points.select("image_id", F.col("x").alias("x2"), F.col("y").alias("y2"), value(target).alias("g2"))
    found = edges(points).join(a, ["image_id", "x1", "y1"]).join(b, ["image_id", "x2", "y2"])
    return found.select("image_id", "x1", "y1", "x2", "y2", (F.lit(1.0) / ((F.col("g1") + F.col("g2")) / 2.0)).alias("cost"))


def runs(points: DataFrame) -> DataFrame:
    """Maximal vertical runs: image_id, x, y1, y2, length."""
    island = F.col("y") - F.row_number().over(Window.partitionBy("image_id", "x").orderBy("y"))
    found = points.select(*POINT).distinct().withColumn("island", island)
    return found.groupBy("image_id", "x", "island").agg(F.min("y").alias("y1"), F.max("y").alias("y2"), F.count(F.lit(1)).alias("length")).drop("island")


def longest_run(points: DataFrame) -> DataFrame:
    return runs(points).groupBy("image_id", "x").agg(F.max("length").alias("length"))


def find_line(points: DataFrame, floors: DataFrame) -> DataFrame:
    """The column with the longest run (the rounded mean of tied ones) and the first and last of all its points; no
    row where the run is under the image's floor. floors: image_id, floor."""
    columns = longest_run(points)
    best = columns.groupBy("image_id").agg(F.max("length").alias("best"))
    tied = columns.join(best, "image_id").filter("length = best").groupBy("image_id").agg(F.rint(F.avg("x")).cast("int").alias("x"), F.max("best").alias("length"))
    tied = tied.join(floors, "image_id").filter("length >= floor").select("image_id", "x", "length")
    return tied.join(points.select(*POINT), ["image_id", "x"]).groupBy("image_id", "x", "length").agg(F.min("y").alias("y1"), F.max("y").alias("y2"))


def transpose(points: DataFrame) -> DataFrame:
    return points.select(*[F.col({"x": "y", "y": "x"}.get(c, c)).alias(c) for c in points.columns])


def spans(labelled: DataFrame) -> DataFrame:
    """Bounding box of each component: pixels, rows and columns spanned, diagonal."""
    box = labelled.groupBy("image_id", "component").agg(F.count(F.lit(1)).alias("pixels"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"))
    box = box.withColumn("rows", F.col("y2") - F.col("y1") + 1).withColumn("cols", F.col("x2") - F.col("x1") + 1)
    return box.withColumn("diagonal", F.sqrt((F.col("rows") * F.col("rows") + F.col("cols") * F.col("cols")).cast("double")))


def long_components(labelled: DataFrame, least: Column) -> DataFrame:
    return labelled.join(spans(labelled).filter(F.col("diagonal") >= least).select("image_id", "component"), ["image_id", "component"], "left_semi")


def oversized(labelled: DataFrame, height: Column, width: Column) -> DataFrame:
    return spans(labelled).filter((F.col("rows") >= height) | (F.col("cols") >= width))


def owning_component(labelled: DataFrame) -> DataFrame:
    """The component with most pixels of each colour; the lowest of equals."""
    n = labelled.groupBy("image_id", "color", "component").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("image_id", "color").agg(F.min_by("component", F.struct(-F.col("n"), F.col("component"))).alias("component"))


def dilate(points: DataFrame, radius: int) -> DataFrame:
    """Square growth by radius, one axis after the other."""
    if radius < 1:
        return points.select(*POINT).distinct()
    around = lambda c: F.explode(F.sequence(F.col(c) - radius, F.col(c) + radius)).alias(c)
    wide = points.select("image_id", around("x"), "y").distinct()
    return wide.select("image_id", "x", around("y")).distinct()


def grayscale(pixels: DataFrame) -> DataFrame:
    level = F.lpad(F.lower(F.hex(colors.luma(F.col("color")))), 2, "0")
    return pixels.select(*POINT, F.concat(F.lit("#"), level, level, level).alias("color"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pixels whose colours differ, or that one side lacks."""
    both = left.alias("l").join(right.alias("r"), POINT, "full")
    return both.filter(~F.col("l.color").eqNullSafe(F.col("r.color"))).select(*POINT, F.col("l.color").alias("color_before"), F.col("r.color").alias("color_after"))


def start_points(targets: DataFrame, foreground: DataFrame, start: DataFrame) -> DataFrame:
    """Where each colour's path begins: its leftmost pixel (the topmost) if that is at start_x or before, else the
    foreground pixel of column start_x nearest in y. start: image_id, start_x."""
    leftmost = targets.groupBy("image_id", "color").agg(F.min_by(F.struct("x", "y"), F.struct("x", "y")).alias("p")).select("image_id", "color", F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    joined = leftmost.join(start, "image_id")
    near = joined.filter("px > start_x").join(foreground.select("image_id", F.col("x").alias("start_x"), F.col("y").alias("fy")), ["image_id", "start_x"])
    near = near.groupBy("image_id", "color", "start_x").agg(F.min_by("fy", F.struct(F.abs(F.col("fy") - F.col("py")), F.col("fy"))).alias("start_y"))
    own = joined.filter("px <= start_x").select("image_id", "color", F.col("px").alias("start_x"), F.col("py").alias("start_y"))
    return own.unionByName(near)


def end_points(targets: DataFrame, starts: DataFrame) -> DataFrame:
    """The rightmost pixel of each colour; of several the farthest in y from the start, then the topmost."""
    right = targets.join(starts.select("image_id", "color", "start_y"), ["image_id", "color"])
    best = F.max_by(F.struct("x", "y"), F.struct(F.col("x"), F.abs(F.col("y") - F.col("start_y")), -F.col("y")))
    return right.groupBy("image_id", "color").agg(best.alias("p")).select("image_id", "color", F.col("p.x").alias("end_x"), F.col("p.y").alias("end_y"))
