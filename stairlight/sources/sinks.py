"""Results as CSV tables, PNG files and comparison pages."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, functions as F

from ..functions import text
from .images import encode


def _checked(output: str) -> str:
    """A folder that may be overwritten: not empty, a root, a home or a parent."""
    path = output.split("://", 1)[-1]
    parts = PurePosixPath(path).parts
    if not output.strip() or ".." in parts or len([p for p in parts if p != "/"]) < 2:
        raise ValueError(f"refusing to overwrite {output!r}")
    return output.rstrip("/")


def write_csv(tables: dict[str, DataFrame | None], output: str, partitioned: bool = False) -> list[str]:
    """One folder a table, header, no row names; absent tables are left out. partitioned keeps a folder an image."""
    done, output = [], _checked(output)
    for name, df in tables.items():
        if df is None:
            continue
        writer = (df if partitioned else df.coalesce(1)).write.mode("overwrite").option("header", True)
        (writer.partitionBy("image_id") if partitioned and "image_id" in df.columns else writer).csv(f"{output}/data/{name}")
        done.append(name)
    return done


def compare_pages(before: DataFrame, after: DataFrame, legend: DataFrame) -> DataFrame:
    """image_id, name and html: a self-contained page per legend row (with color_name) with the source and the raster that has
    this row in front, named <series>_<colour name>. after: image_id, front (the row's ord) and a raster."""
    png = lambda df, to: encode(df).withColumn(to, F.base64("png"))
    name = F.concat(text.slug(F.col("series")), F.lit("_"), text.slug(F.col("color_name")), F.lit(".html"))
    rows = legend.select("image_id", F.col("ord").alias("front"), "series", name.alias("name")).join(png(before, "a").select("image_id", "a"), "image_id").join(after.select("image_id", "front", "b"), ["image_id", "front"])
    image = lambda c: F.concat(F.lit('<img style="position:absolute" src="data:image/png;base64,'), F.replace(F.col(c), F.lit("\r\n"), F.lit("")), F.lit('">'))
    page = F.concat(F.lit("<!DOCTYPE html><html><body><h1>"), "series", F.lit("</h1><label>opacity <input type=range max=1 step=.01 oninput=\"document.querySelectorAll('img')[1].style.opacity=this.value\"></label><div style=\"position:relative\">"), image("a"), image("b"), F.lit("</div></body></html>"))
    return rows.select("image_id", "name", page.alias("html"))


def remove(output: str, spark) -> None:
    """Take away what an earlier export left in a folder that may be overwritten."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_checked(output))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_pages(pages: DataFrame, output: str) -> None:
    """Pages as a partitioned text table under compare/, a folder an image and page."""
    pages.write.mode("overwrite").partitionBy("image_id", "name").text(f"{_checked(output)}/compare")
