"""Painting: curves, censor marks, traces, rulers and label boxes as pixel relations.

Vertices become segments, segments become rectangles, rectangles explode to pixels; where layers meet the first one
wins. Everything stays a relation until raster.from_pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import km, scale

KEY = ["image_id", "series"]


def _shown(surv: Column, max_y: Column, increasing: Column) -> Column:
    return F.when(increasing, max_y - max_y * surv).otherwise(max_y * surv)


def steps(data: DataFrame, how: DataFrame) -> DataFrame:
    """Vertices (image_id, series, ord, x, y) of each curve: from (0, 1) flat and down at every event time, to the
    last time. how: image_id, max_y, increasing."""
    own = Window.partitionBy(*KEY).orderBy("time")
    fitted = km.fit(data).withColumn("before", F.lag("surv", 1, 1.0).over(own)).withColumn("first", F.row_number().over(own) == 1).withColumn("last", F.lead("time").over(own).isNull())
    point = lambda x, s: F.struct(x.cast("double").alias("x"), s.cast("double").alias("s"))
    falls = F.col("n_event") > 0
    each = F.array_compact(F.array(
        F.when(F.col("first"), point(F.lit(0.0), F.lit(1.0))), F.when(falls, point(F.col("time"), F.col("before"))), F.when(falls, point(F.col("time"), F.col("surv"))),
        F.when(F.col("last"), point(F.greatest("time", F.lit(0.0)), F.col("surv"))),
    ))
    rows = fitted.select(*KEY, "time", F.posexplode(each).alias("part", "v"))
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy(*KEY).orderBy("time", "part")))
    rows = rows.join(how.select("image_id", "max_y", "increasing"), "image_id")
    return rows.select(*KEY, "ord", F.col("v.x").alias("x"), _shown(F.col("v.s"), F.col("max_y"), F.col("increasing")).alias("y"))


def censor_marks(data: DataFrame, how: DataFrame) -> DataFrame:
    rows = km.fit(data).filter("n_censor > 0").join(how.select("image_id", "max_y", "increasing"), "image_id")
    return rows.select(*KEY, F.col("time").alias("x"), _shown(F.col("surv"), F.col("max_y"), F.col("increasing")).alias("y"))


def to_pixels(points: DataFrame, x_axis: DataFrame, y_axis: DataFrame) -> DataFrame:
    """Data units to pixels, half to even. Axes: image_id, value and the pixel x or y."""
    for axis, pixel in ((x_axis, "x"), (y_axis, "y")):
        fit = scale.calibration(axis, ["image_id"], "value", pixel).select("image_id", F.col("slope").alias("_s"), F.col("intercept").alias("_i"))
        points = points.join(fit, "image_id").withColumn(pixel, F.rint(F.col("_s") * F.col(pixel) + F.col("_i")).cast("int")).drop("_s", "_i")
    return points


def segments(vertices: DataFrame) -> DataFrame:
    """Each vertex with the next of its series."""
    own = Window.partitionBy(*KEY).orderBy("ord")
    out = vertices.withColumn("x2", F.lead("x").over(own)).withColumn("y2", F.lead("y").over(own)).filter("x2 is not null")
    return out.select(*KEY, "ord", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")


def fill(parts: DataFrame, half_width: Column, width: Column, height: Column) -> DataFrame:
    """Pixels of each segment, clamped to the canvas; level ones lie along x, all others along y at x1."""
    level = F.col("y1") == F.col("y2")
    low = lambda v: F.greatest(F.lit(1), v)
    xs = F.when(level, F.array(low(F.least("x1", "x2")), F.least(width, F.greatest("x1", "x2")))).otherwise(F.array(low(F.col("x1") - half_width), F.least(width, F.col("x1") + half_width)))
    ys = F.when(level, F.array(low(F.col("y1") - half_width), F.least(height, F.col("y1") + half_width))).otherwise(F.array(low(F.least("y1", "y2")), F.least(height, F.greatest("y1", "y2"))))
    box = parts.withColumn("_x", xs).withColumn("_y", ys).filter("_x[0] <= _x[1] and _y[0] <= _y[1]")
    box = box.withColumn("x", F.explode(F.sequence(F.col("_x")[0], F.col("_x")[1])))
    return box.withColumn("y", F.explode(F.sequence(F.col("_y")[0], F.col("_y")[1]))).drop("_x", "_y", "x1", "y1", "x2", "y2")


def painted(points: DataFrame, legend: DataFrame) -> DataFrame:
    """One colour a pixel: that of the topmost layer. legend: image_id, series, color, layer (1 on top)."""
    named = points.join(legend.select(*KEY, "color", "layer"), KEY)
    return named.groupBy("image_id", "x", "y").agg(F.min_by("color", "layer").alias("color"))


def layer_survival(data: DataFrame, how: DataFrame, x_axis: DataFrame, y_axis: DataFrame, legend: DataFrame, censoring: bool = False) -> DataFrame:
    """Pixels of all curves (and censor marks). how: image_id, max_y, increasing, width, height, line_width. With
    marks the curves are one pixel wide."""
    return painted(curves(data, how, x_axis, y_axis, censoring), legend)


def curves(data: DataFrame, how: DataFrame, x_axis: DataFrame, y_axis: DataFrame, censoring: bool = False) -> DataFrame:
    """Each curve's own pixels (image_id, series, x, y), repeated where its segments meet, before layers hide any."""
    lines = segments(to_pixels(steps(data, how), x_axis, y_axis)).join(how, "image_id")
    half = F.lit(0) if censoring else F.greatest(F.lit(0), F.floor(F.col("line_width") / 2).cast("int"))
    out = fill(lines, half, F.col("width"), F.col("height")).select(*KEY, "x", "y")
    if censoring:
        marks = to_pixels(censor_marks(data, how), x_axis, y_axis).join(how, "image_id")
        reach = F.greatest(F.lit(2), F.rint(F.col("height") / 100).cast("int"))
        marks = marks.select(*KEY, "width", "height", F.col("x").alias("x1"), (F.col("y") - reach).alias("y1"), F.col("x").alias("x2"), (F.col("y") + reach).alias("y2"))
        out = out.unionByName(fill(marks, F.lit(0), F.col("width"), F.col("height")).select(*KEY, "x", "y"))
    return out


def layer_trace(scaled: DataFrame, how: DataFrame, x_axis: DataFrame, y_axis: DataFrame, legend: DataFrame) -> DataFrame:
    """Pixels of the scaled traces, without a fit."""
    own = Window.partitionBy(*KEY).orderBy("x", F.desc("y"))
    vertices = scaled.select(*KEY, F.row_number().over(own).alias("ord"), "x", _shown(F.col("y"), F.col("max_y"), F.col("increasing")).alias("y"))
    lines = segments(to_pixels(vertices, x_axis, y_axis)).join(how.select("image_id", "width", "height", "line_width"), "image_id")
    half = F.greatest(F.lit(0), F.floor(F.col("line_width") / 2).cast("int"))
    return painted(fill(lines, half, F.col("width"), F.col("height")).select(*KEY, "x", "y"), legend)


#: A face of 5 x 7 pixels; a row is a number, its highest bit (16) the leftmost pixel.
GLYPHS = {
    "0": (14, 17, 19, 21, 25, 17, 14), "1": (4, 12, 4, 4, 4, 4, 14), "2": (14, 17, 1, 2, 4, 8, 31), "3": (31, 2, 4, 2, 1, 17, 14),
    "4": (2, 6, 10, 18, 31, 2, 2), "5": (31, 16, 30, 1, 1, 17, 14), "6": (6, 8, 16, 30, 17, 17, 14), "7": (31, 1, 2, 4, 8, 8, 8),
    "8": (14, 17, 17, 14, 17, 17, 14), "9": (14, 17, 17, 15, 1, 2, 12), ".": (0, 0, 0, 0, 0, 12, 12), "-": (0, 0, 0, 31, 0, 0, 0),
    "A": (14, 17, 17, 31, 17, 17, 17), "B": (30, 17, 17, 30, 17, 17, 30), "C": (14, 17, 16, 16, 16, 17, 14), "D": (30, 17, 17, 17, 17, 17, 30),
    "E": (31, 16, 16, 30, 16, 16, 31), "F": (31, 16, 16, 30, 16, 16, 16), "G": (14, 17, 16, 23, 17, 17, 15), "H": (17, 17, 17, 31, 17, 17, 17),
    "I": (14, 4, 4, 4, 4, 4, 14), "J": (7, 2, 2, 2, 2, 18, 12), "K": (17, 18, 20, 24, 20, 18, 17), "L": (16, 16, 16, 16, 16, 16, 31),
    "M": (17, 27, 21, 21, 17, 17, 17), "N": (17, 17, 25, 21, 19, 17, 17), "O": (14, 17, 17, 17, 17, 17, 14), "P": (30, 17, 17, 30, 16, 16, 16),
    "Q": (14, 17, 17, 17, 21, 18, 13), "R": (30, 17, 17, 30, 20, 18, 17), "S": (15, 16, 16, 14, 1, 1, 30), "T": (31, 4, 4, 4, 4, 4, 4),
    "U": (17, 17, 17, 17, 17, 17, 14), "V": (17, 17, 17, 17, 17, 10, 4), "W": (17, 17, 17, 21, 21, 21, 10), "X": (17, 17, 10, 4, 10, 17, 17),
    "Y": (17, 17, 17, 10, 4, 4, 4), "Z": (31, 1, 2, 4, 8, 16, 31),
}
#: Cells from one letter to the next, and rows.
STEP, ROWS = 6, 7


def text(words: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Pixels of words centred on (x, y), as large as fits into box_width and box_height, one pixel a cell at least. words:
    image_id, word, x, y, box_width, box_height; letters without a glyph leave a gap."""
    cells = F.length("word") * STEP - 1
    size = F.greatest(F.lit(1), F.least(F.floor(F.col("box_height") / ROWS), F.floor(F.col("box_width") / cells))).cast("int")
    rows = words.filter(F.length("word") > 0).withColumn("_size", size)
    rows = rows.withColumn("_left", F.rint(F.col("x") - F.col("_size") * cells / 2).cast("int")).withColumn("_top", F.rint(F.col("y") - F.col("_size") * ROWS / 2).cast("int"))
    rows = rows.select("image_id", *extra, "_size", "_left", "_top", F.posexplode(F.split(F.upper("word"), "")).alias("_place", "_letter"))
    ink = [(g, r, c) for g, lines in GLYPHS.items() for r, bits in enumerate(lines) for c in range(5) if bits >> (4 - c) & 1]
    found = rows.join(F.broadcast(words.sparkSession.createDataFrame(ink, "_letter string, _row int, _column int")), "_letter")  # a fixed table
    over = F.sequence(F.lit(0), F.col("_size") - 1)
    found = found.withColumn("_dx", F.explode(over)).withColumn("_dy", F.explode(over))
    return found.select("image_id", *extra, (F.col("_left") + F.col("_size") * (F.col("_place") * STEP + F.col("_column")) + F.col("_dx")).cast("int").alias("x"), (F.col("_top") + F.col("_size") * F.col("_row") + F.col("_dy")).cast("int").alias("y"))


def ruler(panels: DataFrame, x_axis: DataFrame, y_axis: DataFrame, sizes: DataFrame, label: DataFrame | None = None) -> DataFrame:
    """Pixels (image_id, x, y) of both axes and their ticks; axes carry the tick's centroid x and y. With the label table,
    also the ticks' words in their boxes."""
    length = (2 * F.greatest("pad_x1", F.abs("pad_y2"))).cast("int")
    sizes = sizes.select("image_id", "width", "height")
    box = panels.join(sizes, "image_id").withColumn("tick", length)
    line = lambda df, x1, y1, x2, y2: df.select("image_id", "width", "height", F.lit("").alias("series"), x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"))
    parts = line(box, F.col("x1"), F.col("y2"), F.col("x2"), F.col("y2")).unionByName(line(box, F.col("x1"), F.col("y1"), F.col("x1"), F.col("y2")))
    at = lambda axis: box.join(axis.select("image_id", F.rint("x").alias("cx"), F.rint("y").alias("cy")), "image_id")
    parts = parts.unionByName(line(at(x_axis), F.col("cx"), F.col("y2"), F.col("cx"), F.col("y2") + F.col("tick")))
    parts = parts.unionByName(line(at(y_axis), F.col("x1") - F.col("tick"), F.col("cy"), F.col("x1"), F.col("cy")))
    out = fill(parts, F.lit(0), F.col("width"), F.col("height")).select("image_id", "x", "y")
    if label is not None:
        named = label.groupBy("image_id", "label").agg(F.min("word").alias("word"))
        ticks = x_axis.select("image_id", "label", "x", "y", "x1", "x2", "y1", "y2").unionByName(y_axis.select("image_id", "label", "x", "y", "x1", "x2", "y1", "y2"))
        words = ticks.join(named, ["image_id", "label"]).withColumn("box_width", F.col("x2") - F.col("x1") + 1).withColumn("box_height", F.col("y2") - F.col("y1") + 1)
        out = out.unionByName(text(words).join(sizes, "image_id").filter("x between 1 and width and y between 1 and height").select("image_id", "x", "y"))
    return out.distinct()


def label_boxes(label: DataFrame) -> DataFrame:
    """Box and badge geometry of every finding; the badge goes to the right where it would leave the canvas."""
    median = label.groupBy("image_id").agg(F.median(F.col("y2") - F.col("y1") + 1).alias("median_height"))
    out = label.join(median, "image_id").withColumn("border", F.greatest(F.lit(2.0), F.col("median_height") * 0.15))
    out = out.withColumn("pad", F.ceil(F.col("border") / 2) + 1)
    out = out.select("image_id", "label", "border", *[(F.col(c) + F.col("pad") * s).cast("double").alias(f"box_{c}") for c, s in (("x1", -1), ("x2", 1), ("y1", -1), ("y2", 1))])
    out = out.withColumn("badge_height", F.col("box_y2") - F.col("box_y1"))
    out = out.withColumn("badge_width", F.col("badge_height") * F.length("label") * 0.7 + 4)
    left = F.col("box_x1") - 2 - F.col("badge_width")
    return out.withColumn("badge_x1", F.when(left < 0, F.col("box_x2") + 2).otherwise(left)).withColumn("badge_x2", F.col("badge_x1") + F.col("badge_width"))


def annotation(label: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pixels (image_id, x, y, color) of every finding's red frame and badge, the badge's letters in white."""
    sizes = sizes.select("image_id", "width", "height")
    boxes = label_boxes(label).join(sizes, "image_id").withColumn("thick", F.rint("border").cast("int"))
    edge = {c: F.rint(f"box_{c}").cast("int") for c in ("x1", "x2", "y1", "y2")}
    badge = [F.rint("badge_x1").cast("int"), F.rint("badge_x2").cast("int")]
    half = [F.floor(F.col("thick") / 2).cast("int"), F.ceil(F.col("thick") / 2).cast("int") - 1]
    rects = [(edge["x1"] - half[0], edge["x2"] + half[1], e - half[0], e + half[1]) for e in (edge["y1"], edge["y2"])]
    rects += [(e - half[0], e + half[1], edge["y1"] - half[0], edge["y2"] + half[1]) for e in (edge["x1"], edge["x2"])]
    rects.append((*badge, edge["y1"], edge["y2"]))
    spans = F.explode(F.array(*[F.struct(*[v.alias(n) for n, v in zip(("xa", "xb", "ya", "yb"), r, strict=True)]) for r in rects]))
    each = boxes.select("image_id", "width", "height", spans.alias("r"))
    each = each.select("image_id", F.greatest(F.lit(1), "r.xa").alias("xa"), F.least("width", "r.xb").alias("xb"), F.greatest(F.lit(1), "r.ya").alias("ya"), F.least("height", "r.yb").alias("yb")).filter("xa <= xb and ya <= yb")
    red = each.withColumn("x", F.explode(F.sequence("xa", "xb"))).withColumn("y", F.explode(F.sequence("ya", "yb"))).select("image_id", "x", "y", F.lit(1).alias("layer"), F.lit("#ff0000").alias("color"))
    words = boxes.select("image_id", F.col("label").alias("word"), ((F.col("badge_x1") + F.col("badge_x2")) / 2).alias("x"), ((F.col("box_y1") + F.col("box_y2")) / 2).alias("y"), (F.col("badge_width") - 4).alias("box_width"), (F.col("badge_height") - 2).alias("box_height"))
    white = text(words).join(sizes, "image_id").filter("x between 1 and width and y between 1 and height").select("image_id", "x", "y", F.lit(0).alias("layer"), F.lit("#ffffff").alias("color"))
    return red.unionByName(white).groupBy("image_id", "x", "y").agg(F.min_by("color", "layer").alias("color"))
