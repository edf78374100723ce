"""Text findings: boxes of numbers in reading order, from any engine that gives words with boxes.

An engine is a function (image_id, enlarged RGB array, mode) -> list of (word, confidence, "x1,y1,x2,y2"). The one built
in, `glyphs`, compares each blob of ink with the templates of render.GLYPHS; another one can be plugged in.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text
from ..schemas import TABLES
from . import kernels
from .render import GLYPHS, ROWS


def reading_order(boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """boxes with row_id and ord (from 1): a new row where the top edge falls by more than half the median height."""
    half = boxes.groupBy(key).agg(F.greatest(F.lit(1.0), F.median(F.col("y2") - F.col("y1") + 1) / 2).alias("_tolerance"))
    own = Window.partitionBy(key).orderBy("y1", "x1")
    out = boxes.join(half, key).withColumn("_new", F.coalesce((F.col("y1") - F.lag("y1").over(own) > F.col("_tolerance")).cast("int"), F.lit(0)))
    out = out.withColumn("row_id", F.sum("_new").over(Window.partitionBy(key).orderBy("y1", "x1").rowsBetween(Window.unboundedPreceding, 0)) + 1)
    out = out.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("row_id", "x1", "y1")))
    return out.drop("_tolerance", "_new")


def overlaps(boxes: DataFrame, cell: int = 256) -> DataFrame:
    """Pairs (a, b), a < b, of boxes of an image that overlap; touching is not overlapping. Boxes meet by grid cell,
    so no image is paired with itself as a whole; a pair is kept in the first cell it shares."""
    tiles = boxes.select("image_id", "box", "x1", "x2", "y1", "y2", F.explode(F.sequence((F.col("x1") / cell).cast("int"), (F.col("x2") / cell).cast("int"))).alias("cx"))
    tiles = tiles.withColumn("cy", F.explode(F.sequence((F.col("y1") / cell).cast("int"), (F.col("y2") / cell).cast("int"))))
    a, b = tiles.alias("a"), tiles.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("image_id", "cx", "cy")]
    meet = (F.col("a.x1") < F.col("b.x2")) & (F.col("a.x2") > F.col("b.x1")) & (F.col("a.y1") < F.col("b.y2")) & (F.col("a.y2") > F.col("b.y1"))
    first = (F.col("a.cx") == (F.greatest("a.x1", "b.x1") / cell).cast("int")) & (F.col("a.cy") == (F.greatest("a.y1", "b.y1") / cell).cast("int"))
    return a.join(b, same[0] & same[1] & same[2]).filter((F.col("a.box") < F.col("b.box")) & meet & first).select(F.col("a.image_id").alias("image_id"), F.col("a.box").alias("a"), F.col("b.box").alias("b"))


def findings(raw: DataFrame, confidence: float = 50, magnify: float = 4) -> DataFrame:
    """Raw words (image_id, mode, ord, word, confidence, bbox) as findings: confident positive numbers, boxes 1-based
    and scaled back, hyphens dropped."""
    x1, y1, x2, y2 = text.box(F.col("bbox"), magnify)
    out = raw.filter(F.col("confidence") >= confidence).select("image_id", "mode", "ord", F.replace("word", F.lit("-"), F.lit("")).alias("word"), "confidence", x1.alias("x1"), x2.alias("x2"), y1.alias("y1"), y2.alias("y2"))
    out = out.filter(text.positive_number(F.col("word")))
    return out.withColumn("x", (F.col("x1") + F.col("x2")) / 2).withColumn("y", (F.col("y1") + F.col("y2")) / 2)


def pool(found: DataFrame) -> DataFrame:
    """Greedy by confidence (ties: earlier mode, then order, then place): a box that overlaps a kept one goes. One group an image,
    of at most some hundred boxes."""
    schema = "image_id string, mode int, ord int, word string, confidence double, x1 int, x2 int, y1 int, y2 int, x double, y double"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "mode", "ord", "x1", "y1", "x2", "y2"], ascending=[False] + [True] * 6, kind="stable").reset_index(drop=True)
        box, kept = pdf[["x1", "x2", "y1", "y2"]].to_numpy(), []
        for i, (x1, x2, y1, y2) in enumerate(box):
            own = box[kept]
            if not len(kept) or not ((x1 < own[:, 1]) & (x2 > own[:, 0]) & (y1 < own[:, 3]) & (y2 > own[:, 2])).any():
                kept.append(i)
        return pdf.iloc[kept][names]

    return found.select(*names).groupBy("image_id").applyInPandas(run, schema)


def labels(raw: DataFrame, confidence: float = 50, magnify: float = 4) -> DataFrame:
    """The label table of every image: pooled findings lettered in reading order."""
    ordered = reading_order(pool(findings(raw, confidence, magnify)).drop("ord"))
    return ordered.select("image_id", text.letters(F.col("ord")).alias("label"), "word", "confidence", "x", "y", "x1", "x2", "y1", "y2")


def detect(rasters: DataFrame, engine: Callable[[str, np.ndarray, int], list[tuple]], magnify: int = 4, modes: tuple[int, ...] = (4, 7, 11)) -> DataFrame:
    """Raw words of all modes: the engine gets (image_id, enlarged RGB array, mode) and gives (word, confidence, bbox)."""
    from .kernels import to_array

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                big = np.kron(to_array(r.data, r.height, r.width), np.ones((magnify, magnify, 1), np.uint8))
                for k, mode in enumerate(modes):
                    rows += [(r.image_id, k, i, w, float(c), b) for i, (w, c, b) in enumerate(engine(r.image_id, big, mode))]
            yield pd.DataFrame(rows, columns=["image_id", "mode", "ord", "word", "confidence", "bbox"])

    return rasters.select("image_id", "height", "width", "data").mapInPandas(run, "image_id string, mode int, ord int, word string, confidence double, bbox string")


def _templates() -> list[tuple[str, np.ndarray]]:
    """Each digit's, point's and minus' ink, without the rows and columns that have none."""
    out = []
    for letter in "0123456789.-":
        cells = np.array([[bits >> (4 - c) & 1 for c in range(5)] for bits in GLYPHS[letter]], bool)
        out.append((letter, cells[np.ix_(cells.any(1), cells.any(0))]))
    return out


def _read(blob: np.ndarray, line: float) -> tuple[str, float]:
    """The template most like a blob of ink, and how many cells agree (0 to 1). line: the height of the line's letters;
    a template's share of it must be the blob's."""
    best = ("", 0.0)
    for letter, cells in _templates():
        (h, w), (rows, columns) = blob.shape, cells.shape
        cell = line / ROWS
        if abs(h - rows * cell) > cell or abs(w - columns * cell) > 1.5 * cell:
            continue
        y, x = (((np.arange(n) + 0.5) * size / n).astype(int) for n, size in ((rows, h), (columns, w)))
        agreement = float((blob[np.ix_(y, x)] == cells).mean())
        if agreement > best[1]:
            best = letter, agreement
    return best


def glyphs(image_id: str, rgb: np.ndarray, mode: int = 0) -> list[tuple[str, float, str]]:
    """Words of digits: blobs side by side, on one line and less than a letter's width apart. The confidence is the mean share of
    a template's cells that agree, in percent. Boxes are 0-based, both ends inside."""
    ink = kernels.foreground(kernels.to_colors(rgb))
    labels = kernels.components(kernels.dilate(ink, 1))  # strokes that touch at corners are one blob
    labels[~ink] = 0
    y, x = np.nonzero(labels)
    kinds, index = np.unique(labels[y, x], return_inverse=True)
    boxes = []
    for k in range(len(kinds)):
        own = index == k
        boxes.append((int(x[own].min()), int(y[own].min()), int(x[own].max()) + 1, int(y[own].max()) + 1, int(kinds[k])))
    boxes.sort()
    words: list[list[tuple]] = []
    for box in boxes:
        for word in words:
            top, bottom = min(b[1] for b in word), max(b[3] for b in word)
            tall = max(bottom - top, box[3] - box[1])
            if 0 <= box[0] - word[-1][2] < 0.6 * tall and min(bottom, box[3]) > max(top, box[1]):
                word.append(box)
                break
        else:
            words.append([box])
    found = []
    for word in words:
        x1, y1, x2, y2 = word[0][0], min(b[1] for b in word), word[-1][2], max(b[3] for b in word)
        read = [_read(labels[b[1] : b[3], b[0] : b[2]] == b[4], y2 - y1) for b in word]
        if all(letter for letter, _ in read):
            found.append(("".join(letter for letter, _ in read), 100 * float(np.mean([a for _, a in read])), f"{x1},{y1},{x2 - 1},{y2 - 1}"))
    return found


def empty(spark) -> DataFrame:
    return spark.createDataFrame([], TABLES["label"])
