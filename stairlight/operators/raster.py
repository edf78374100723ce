"""Raster operators: (image_id, height, width, data) to the same or to relations, one kernel call an image.

An image is a row, so images spread over tasks without an exchange; a batch holds few of them. Only foreground pixels are
ever exploded. Inputs are projected before a kernel, which is an optimiser barrier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..schemas import TABLES
from . import kernels as K

RASTER = ["image_id", "height", "width", "data"]
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _named(codes: np.ndarray) -> pa.Array:
    """Colour names of colour numbers; each distinct colour is named once."""
    kinds, index = np.unique(codes, return_inverse=True)
    return pa.DictionaryArray.from_arrays(pa.array(index.ravel(), pa.int32()), pa.array([K.name(int(k)) for k in kinds], pa.string())).cast(pa.string())


def _points(row, colors: np.ndarray, where: np.ndarray) -> list:
    """Columns image_id, x, y, color of the marked pixels."""
    y, x = np.nonzero(where)
    return [[row.image_id] * len(x), x + 1, y + 1, _named(colors[y, x])]


def _map(rasters: DataFrame, extra: list[str], run: Callable, schema: str) -> DataFrame:
    """run(row, colour array) -> result columns, for every image."""
    fields = [c.split() for c in schema.split(", ")]
    names, kinds = [f[0].strip("`") for f in fields], [_KINDS[f[1]] for f in fields]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                row = SimpleNamespace(**{n: part.column(k)[i].as_py() for k, n in enumerate(part.schema.names)})
                found = run(row, K.to_colors(K.to_array(row.data, row.height, row.width)))
                if found is not None:
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(found, kinds, strict=True)], names)

    return rasters.select(*RASTER, *extra).mapInArrow(batches, schema)


def _to_raster(rasters: DataFrame, extra: list[str], change: Callable) -> DataFrame:
    return _map(rasters, extra, lambda row, colors: [[row.image_id], *([n] for n in colors.shape), [K.to_bytes(change(row, colors))]], TABLES["raster"])


def pixels(rasters: DataFrame, foreground_only: bool = False) -> DataFrame:
    """The pixel relation; foreground_only leaves out the most frequent colour."""
    return _map(rasters, [], lambda row, colors: _points(row, colors, colors != K.background(colors) if foreground_only else np.ones(colors.shape, bool)), TABLES["pixel"])


def _painted(rows: DataFrame, points: DataFrame) -> DataFrame:
    """rows: image_id, height, width, data (null: one colour) and background."""
    grouped = points.groupBy("image_id").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys"), F.collect_list("color").alias("codes"))
    rows = rows.select("image_id", "height", "width", "background", "data").join(grouped, "image_id", "left")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                image, height, width, ground, data = (part.column(c)[i].as_py() for c in range(5))
                colors = np.full((height, width), K.parse(ground)) if data is None else K.to_colors(K.to_array(data, height, width))
                if part.column(5)[i].is_valid:
                    x, y = (part.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (5, 6))
                    code = part.column(7)[i].values.dictionary_encode()
                    value = np.array([K.parse(c) for c in code.dictionary.to_pylist()])[code.indices.to_numpy(zero_copy_only=False)]
                    inside = (x >= 1) & (x <= width) & (y >= 1) & (y <= height)
                    colors[y[inside] - 1, x[inside] - 1] = value[inside]
                yield pa.RecordBatch.from_arrays([pa.array([image]), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([K.to_bytes(colors)], pa.binary())], RASTER)

    return rows.mapInArrow(batches, TABLES["raster"])


def from_pixels(points: DataFrame, sizes: DataFrame, background: str | None = None) -> DataFrame:
    """Rasters of given sizes (image_id, height, width and, unless one is given for all, background) with the points
    painted. Points outside are left out."""
    sizes = sizes if background is None else sizes.withColumn("background", F.lit(background))
    return _painted(sizes.withColumn("data", F.lit(None).cast("binary")), points)


def paint(rasters: DataFrame, points: DataFrame) -> DataFrame:
    """rasters with the points painted over them."""
    return _painted(rasters.withColumn("background", F.lit("#ffffff")), points)


def quantize(rasters: DataFrame, n_colors: int = 256) -> DataFrame:
    return _to_raster(rasters, [], lambda _, colors: K.quantize(colors, n_colors))


def grayscale(rasters: DataFrame) -> DataFrame:
    def run(_, colors):
        level = np.rint(0.2126 * (colors >> 16) + 0.7152 * (colors >> 8 & 255) + 0.0722 * (colors & 255)).astype(np.int64)
        return level << 16 | level << 8 | level

    return _to_raster(rasters, [], run)


def mask(rasters: DataFrame, rectangles: DataFrame, initial: bool = True, background: str | None = None) -> DataFrame:
    """rectangles (image_id, ord, x1, x2, y1, y2, keep): the last that covers a pixel decides."""
    each = rectangles.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("ord", "x1", "x2", "y1", "y2", "keep"))).alias("rects"))

    def run(row, colors):
        kept = np.full(colors.shape, initial)
        for r in row.rects if row.rects is not None else ():
            kept[max(r["y1"], 1) - 1 : max(r["y2"], 0), max(r["x1"], 1) - 1 : max(r["x2"], 0)] = r["keep"]
        return np.where(kept, colors, K.background(colors) if background is None else K.parse(background))

    return _to_raster(rasters.join(each, "image_id", "left"), ["rects"], run)


def classify(rasters: DataFrame, palettes: DataFrame) -> DataFrame:
    """palettes (image_id, background, series, garbage): each pixel the nearest colour, garbage the background."""
    def run(row, colors):
        garbage = [] if row.garbage is None else list(row.garbage)
        palette = [row.background, *row.series, *garbage]
        if len(set(palette)) != len(palette):
            raise ValueError("series, garbage, and background must all be unique")
        codes = np.array([K.parse(c) for c in palette])
        kinds, index = np.unique(colors, return_inverse=True)
        near = K.nearest(kinds, codes)
        near[near > len(row.series)] = 0
        return codes[near][index].reshape(colors.shape)

    return _to_raster(rasters.join(palettes, "image_id"), ["background", "series", "garbage"], run)


def clean(rasters: DataFrame, panels: DataFrame, span_threshold: float = 0.3) -> DataFrame:
    """Components shorter than a share of the panel's diagonal turn to background, in the original colours."""
    def run(row, colors):
        ink = K.foreground(colors)
        least = span_threshold * np.hypot(row.x2 - row.x1 + 1, row.y2 - row.y1 + 1)
        rest = colors[~ink]
        ground = K.background(rest) if rest.size else 0
        return np.where(ink & ~K.keep_long(ink, least), ground, colors)

    return _to_raster(rasters.join(panels, "image_id"), ["x1", "x2", "y1", "y2"], run)


def clean_for_text(rasters: DataFrame, span_threshold: float = 0.15, dilate: int = 2) -> DataFrame:
    """Components as high or wide as a share of the image go, with what is `dilate` pixels around them; and so does
    all that is not ink. Unchanged without ink."""
    def run(_, colors):
        ink = K.foreground(colors)
        if not ink.any():
            return colors
        labels = K.components(ink)
        big = [k for k, (r, c, _) in K.component_spans(labels).items() if r >= span_threshold * colors.shape[0] or c >= span_threshold * colors.shape[1]]
        erase = np.isin(labels, big) & ink
        erase = K.dilate(erase, dilate) if dilate >= 1 else erase
        return np.where(ink & ~erase, colors, K.background(colors[~ink]))

    return _to_raster(rasters, [], run)


def components(rasters: DataFrame) -> DataFrame:
    """image_id, x, y, color, component of all ink pixels."""
    def run(row, colors):
        labels = K.components(K.foreground(colors))
        return [*_points(row, colors, labels > 0), labels[labels > 0]]

    return _map(rasters, [], run, "image_id string, x int, y int, color string, component long")


def panels(rasters: DataFrame, bands: DataFrame) -> DataFrame:
    """The panel table from tick bands (image_id, y_axis_column, x_axis_row, band, median_height)."""
    def run(row, colors):
        p = K.panel(colors, int(row.y_axis_column), int(row.x_axis_row), int(row.band), float(row.median_height))
        return [[row.image_id], *([p[c.split()[0]]] for c in TABLES["panel"].split(", ")[1:])]

    return _map(rasters.join(bands, "image_id"), ["y_axis_column", "x_axis_row", "band", "median_height"], run, TABLES["panel"])


def paths(rasters: DataFrame) -> DataFrame:
    """The path table: traced pixels of every curve."""
    def run(row, colors):
        found, width = K.paths(colors)
        parts = [(np.nonzero(own), color) for color, own in found.items()]
        y, x = (np.concatenate([np.zeros(0, int), *(p[i] for p, _ in parts)]) for i in (0, 1))
        codes = np.concatenate([np.zeros(0, int), *(np.full(len(p[0]), color) for p, color in parts)])
        height, wide = colors.shape
        return [[row.image_id] * len(x), x + 1, y + 1, _named(codes), *([v] * len(x) for v in (width, wide, height))]

    return _map(rasters, [], run, TABLES["path"])


def line_widths(rasters: DataFrame) -> DataFrame:
    return _map(rasters, [], lambda row, colors: [[row.image_id], [K.line_width(colors, K.background(colors))]], "image_id string, line_width int")
