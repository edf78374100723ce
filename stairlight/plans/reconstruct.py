"""The whole way from rasters and judgment inputs to patients and their statistics, for all images at once.

Stages are DataFrame to DataFrame; a stage's table is written where a later action reads it again (`keep`), so kernels run
once and a lost executor costs one partition."""

from __future__ import annotations

import math
import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import colors
from ..operators import calibrate, cox, guyot, km, ocr, pixels, raster, render, scale, tables, validate
from ..schemas import TABLES, DataError
from ..sources import images, sinks


def legend_of(spec: DataFrame) -> DataFrame:
    """The legend in the caller's order; raises on wrong colours, lengths or reference."""
    rows = spec.select("image_id", "reference", F.posexplode(F.arrays_zip("series", "series_names")).alias("ord", "v"))
    rows = rows.select("image_id", (F.col("ord") + 1).cast("int").alias("ord"), F.col("v.series_names").alias("series"), F.col("v.series").alias("color"), (F.col("v.series_names") == F.col("reference")).alias("reference"))
    every = rows.select("image_id", "color").unionByName(spec.select("image_id", F.col("background").alias("color"))).unionByName(spec.select("image_id", F.explode_outer("garbage").alias("color")).filter("color is not null"))
    validate.check([
        (spec.filter(F.coalesce(F.size("series") != F.size("series_names"), F.lit(True)) | (F.size("series") < 1)), "image_id", "series and series_names must be lists of the same length, at least 1: {}"),
        (rows.filter("series is null or series = ''"), "image_id", "series_names has an empty name in: {}"),
        (every.filter(F.coalesce(~colors.valid(F.col("color")), F.lit(True))), "color", "background, series, and garbage must be valid hex colors: {}"),
        (validate.repeated(rows, ["image_id", "series"]), "series", "series_names repeats: {}"),
        (validate.repeated(every.select("image_id", colors.rgb(F.col("color")).alias("color")), ["image_id", "color"]), "color", "series, garbage, and background must all be unique: {}"),
        (rows.groupBy("image_id").agg(F.max(F.coalesce("reference", F.lit(False))).alias("r")).filter("not r"), "image_id", "reference must be one of series_names: {}"),
    ])
    return rows.withColumn("color", colors.rgb(F.col("color")))


def _number(name: str, values: float | list[float], low: float, high: float, open_ended: bool = False) -> None:
    """Every value is a number from low to high (open_ended: between them)."""
    for v in values if isinstance(values, (list, tuple)) else [values]:
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not math.isfinite(v) or not (low < v < high if open_ended else low <= v <= high):
            raise DataError(f"{name} must be {'between' if open_ended else 'from'} {low} {'and' if open_ended else 'to'} {high}, not {v!r}")


def _one_of(name: str, value: str, known: tuple[str, ...]) -> None:
    if value not in known:
        raise DataError(f"{name} must be one of {', '.join(known)}, not {value!r}")


def distill(rasters: DataFrame, label: DataFrame, spec: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> dict[str, DataFrame]:
    """Calibrate, find the panel, mask to it, classify colours, clean, count."""
    legend = keep(legend_of(spec), "legend")
    x_axis, y_axis = (keep(a, n) for a, n in zip(calibrate.calibrate(spec, label), ("x_axis", "y_axis"), strict=True))
    panel = keep(raster.panels(rasters, calibrate.band(x_axis, y_axis)), "panel")
    inside = panel.select("image_id", F.lit(1).alias("ord"), *[(F.col(c) + F.col(f"pad_{c}")).alias(c) for c in ("x1", "x2", "y1", "y2")], F.lit(True).alias("keep"))
    masked = raster.mask(rasters, inside, initial=False)
    garbage = F.coalesce("garbage", F.array().cast("array<string>"))
    classified = raster.classify(masked, spec.select("image_id", "background", "series", garbage.alias("garbage")))
    clean = keep(raster.clean(classified, panel), "clean")
    found = raster.pixels(clean, foreground_only=True).groupBy("image_id", "color").agg(F.count(F.lit(1)).alias("n"))
    counts = legend.join(found, ["image_id", "color"], "left").select("image_id", "ord", "series", F.coalesce("n", F.lit(0)).alias("n"))
    return {"legend": legend, "x_axis": x_axis, "y_axis": y_axis, "panel": panel, "clean": clean, "counts": counts}


def data(clean: DataFrame, legend: DataFrame, x_axis: DataFrame, y_axis: DataFrame, spec: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> dict[str, DataFrame | None]:
    """Numbers at risk and events first, so that a wrong number fails before the path search; then path, scale,
    patients."""
    risk = keep(validate.risk_table(spec, legend), "risk")
    events = validate.events_table(spec, legend)
    path = keep(raster.paths(clean), "path")
    if path.isEmpty():
        raise DataError("No Kaplan-Meier curves detected.")
    scaled = keep(scale.scale(path, x_axis, y_axis, legend), "scaled")
    survival = keep(guyot.survival(scaled, risk, events), "survival")
    return {"risk": risk, "events": events, "path": path, "scaled": scaled, "survival": survival}


class Engine:
    """Rasters, findings and inputs in; tables out. Stages must run in order, each once until a new reconstruct(), and are
    kept as written tables."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not (root or shared):
            if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = f"file://{tempfile.mkdtemp(prefix='stairlight-')}"
        self.spark, self.root, self.tables = spark, root or f"{shared.rstrip('/')}/engine-{uuid.uuid4().hex}", {}

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def _need(self, name: str) -> DataFrame:
        if self.tables.get(name) is None:
            raise DataError(f"there is no {name} yet: run the stage that makes it first")
        return self.tables[name]

    def _once(self, name: str) -> None:
        if name in self.tables:
            raise DataError(f"{name} is there already: a stage runs once")

    def quantize(self, rasters: DataFrame, n_colors: int = 256) -> DataFrame:
        self._once("quantized")
        _number("n_colors", n_colors, 2, 1 << 24)
        source = self._keep(rasters.select(*raster.RASTER), "source")
        self.tables = {"source": source, "quantized": self._keep(raster.quantize(source, n_colors), "quantized")}
        return self.tables["quantized"]

    def label(self, engine: Callable | None = None, findings: DataFrame | None = None, **options) -> DataFrame:
        """From an OCR engine, or from findings made elsewhere."""
        source = self._need("quantized")
        self._once("label")
        _number("confidence", options.get("confidence", 50), 0, 100)
        if findings is None:
            text_only = raster.clean_for_text(raster.grayscale(source))
            findings = ocr.labels(ocr.detect(text_only, engine), **options) if engine else ocr.empty(self.spark)
        self.tables["label"] = self._keep(findings, "label")
        return self.tables["label"]

    def annotated(self) -> DataFrame:
        """The source with every finding framed and lettered."""
        source = self._need("source")
        return raster.paint(source, render.annotation(self._need("label"), source))

    def distill(self, spec: DataFrame) -> dict[str, DataFrame]:
        source, label = self._need("quantized"), self._need("label")
        self._once("clean")
        spec = self._keep(spec, "spec")
        found = distill(source, label, spec, self._keep)
        self.tables |= found | {"spec": spec}
        return found

    def digitize(self) -> dict[str, DataFrame | None]:
        t = [self._need(n) for n in ("clean", "legend", "x_axis", "y_axis", "spec")]
        self._once("survival")
        found = data(*t, self._keep)
        self.tables |= found
        return found

    def reconstruct(self, rasters: DataFrame, spec: DataFrame, engine: Callable | None = None, findings: DataFrame | None = None, timeout: float | None = 600) -> DataFrame:
        """All stages from the beginning; after `timeout` seconds the running jobs are cancelled and TimeoutError is raised."""
        if timeout is not None:
            _number("timeout", timeout, 0, 1e9, True)
        self.tables, context, group, late = {}, self.spark.sparkContext, f"reconstruct-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            late.set()
            context.cancelJobGroup(group)

        def stage(f: Callable, *arguments) -> None:
            if late.is_set():
                raise TimeoutError(f"not done after {timeout} seconds")
            f(*arguments)

        clock = threading.Timer(timeout or 0, stop)
        before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
        context.setJobGroup(group, "reconstruct", True)
        try:
            if timeout is not None:
                clock.start()
            for step in ((self.quantize, rasters), (self.label, engine, findings), (self.distill, spec), (self.digitize,)):
                stage(*step)
        except Exception as error:
            if late.is_set() and not isinstance(error, TimeoutError):
                raise TimeoutError(f"not done after {timeout} seconds") from error
            raise
        finally:
            clock.cancel()
            for k, v in before.items():
                context.setLocalProperty(k, v)
        return self.tables["survival"]

    def data(self) -> DataFrame:
        """The patients."""
        return self._need("survival")

    def legend(self, friendly: bool = True) -> DataFrame:
        """Friendly: the colour's name beside its code."""
        legend = self._need("legend")
        return colors.nearest(legend, "color", [(n, colors.hex_of(v)) for n, v in colors.NAMED.items()], "color_name") if friendly else legend

    def risk_table(self, mode: str = "transposed") -> DataFrame | None:
        return tables.table(self.tables.get("risk"), mode)

    def events_table(self) -> DataFrame | None:
        return self.tables.get("events")

    def counts(self) -> DataFrame:
        return km.counts(self._need("survival"), self._need("legend"))

    def quantiles(self, probabilities: list[float], type: str = "survival", confidence: float = 0.95) -> DataFrame:
        _one_of("type", type, ("survival", "incidence"))
        _number("probabilities", probabilities, 0, 1)
        _number("confidence", confidence, 0, 1, True)
        find = {"survival": km.quantiles, "incidence": km.incidence_quantiles}[type]
        return find(self._need("survival"), probabilities, confidence)

    def probabilities(self, times: list[float], confidence: float = 0.95) -> DataFrame:
        _number("times", times, 0, 1e300)
        _number("confidence", confidence, 0, 1, True)
        return km.probabilities(self._need("survival"), times, confidence)

    def hazard_ratios(self, reference: str | None = None, confidence: float = 0.95) -> DataFrame:
        legend = self._need("legend")
        _number("confidence", confidence, 0, 1, True)
        if reference is not None:
            _one_of("reference", reference, tuple(r["series"] for r in legend.select("series").distinct().collect()))
            legend = legend.withColumn("reference", F.col("series") == reference)
        return cox.hazard_ratios(self._need("survival"), legend, confidence)

    def rendered(self, what: str = "survival", front: int = 1) -> DataFrame:
        """Rasters of the reconstruction (survival, censoring or trace) on the figure's background, legend row `front` on
        top and the others beneath it in order."""
        _one_of("what", what, ("survival", "censoring", "trace"))
        legend = self._need("legend")
        validate.check([(legend.groupBy("image_id").agg(F.max("ord").alias("n")).filter(~F.lit(front).between(1, F.col("n"))), "image_id", f"front {front} is no row of the legend of: {{}}")])
        legend = legend.withColumn("layer", F.when(F.col("ord") == front, 0).otherwise(F.col("ord")))
        scaled, path = self._need("scaled"), self._need("path")
        how = path.groupBy("image_id").agg(*[F.max(c).alias(c) for c in ("line_width", "width", "height")]).join(scaled.groupBy("image_id").agg(F.max("max_y").alias("max_y"), F.max("increasing").alias("increasing")), "image_id")
        axes = self._need("x_axis"), self._need("y_axis")
        if what == "trace":
            points = render.layer_trace(scaled, how, *axes, legend)
        else:
            points = render.layer_survival(self._need("survival"), how, *axes, legend, censoring=what == "censoring")
        return raster.from_pixels(points, how.select("image_id", "height", "width").join(self._background(), "image_id"))

    def _background(self) -> DataFrame:
        return self._need("spec").select("image_id", colors.rgb(F.col("background")).alias("background"))

    def impression(self, what: str = "survival", front: int = 1) -> DataFrame:
        """The rendered reconstruction under its ruler: axes, ticks and their words, black or white by contrast."""
        layered = self.rendered(what, front)
        sizes = self._need("source").select("image_id", "height", "width")
        lines = render.ruler(self._need("panel"), self._need("x_axis"), self._need("y_axis"), sizes, self._need("label"))
        shade = self._background().select("image_id", colors.ruler(F.col("background")).alias("color"))
        return raster.paint(layered, lines.join(shade, "image_id"))

    def compare(self, front: int = 1, what: str = "survival") -> DataFrame:
        """Pixels that differ between the source and the impression."""
        return pixels.difference(raster.pixels(self._need("source")), raster.pixels(self.impression(what, front)))

    def preview(self) -> DataFrame:
        """The reconstruction with its ruler, as rasters."""
        return self.impression()

    def export(self, output: str, times: list[float] | None = None, probabilities: list[float] = (0.25, 0.5, 0.75), type: str = "survival", confidence: float = 0.95, what: str = "survival") -> list[str]:
        """CSV tables under data/ and, for each legend row, a page under compare/ with this row in front; probabilities only
        when times are given. What was in the folder goes first."""
        legend = self.legend()
        made = {
            "risk_table": self.risk_table("long"), "events_table": self.events_table(), "data": self.data(), "counts": self.counts(),
            "quantiles": self.quantiles(list(probabilities), type, confidence), "probabilities": self.probabilities(times, confidence) if times else None,
            "hazard_ratios": self.hazard_ratios(confidence=confidence),
        }
        sinks.remove(output, self.spark)
        done = sinks.write_csv(made, output)
        fronts = range(1, self._need("legend").agg(F.max("ord")).first()[0] + 1)
        after = None
        for front in fronts:  # as many as a legend has rows
            has = self._need("legend").filter(F.col("ord") == front).select("image_id")
            own = images.encode(self._fronted(what, front, has)).select("image_id", F.lit(front).alias("front"), F.base64("png").alias("b"))
            after = own if after is None else after.unionByName(own)
        sinks.write_pages(sinks.compare_pages(self._need("source"), after, legend), output)
        return done

    def _fronted(self, what: str, front: int, images_: DataFrame) -> DataFrame:
        """The impressions of the images whose legend has this row."""
        part = Engine(self.spark, self.root)
        part.tables = {k: v.join(images_, "image_id", "left_semi") for k, v in self.tables.items() if v is not None}
        return part.impression(what, front)


def empty_label(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TABLES["label"])
