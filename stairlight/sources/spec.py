"""Judgment inputs (ticks, colours, names, numbers at risk) as a table, one row an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import TABLES

#: The scripted inputs of the sample figure (ticks L and M, B and C; two arms; at risk every 6 months).
SAMPLE = {
    "x_label": ["L", "M"], "x_value": [30.0, 36.0], "y_label": ["B", "C"], "y_value": [75.0, 50.0],
    "background": "#FFFFFF", "garbage": [], "series": ["#E8743B", "#1B1B3A"], "series_names": ["Treatment", "Placebo"], "reference": "Placebo",
    "risk_patients": [350, 298, 247, 202, 168, 145, 134, 350, 295, 247, 202, 167, 145, 126],
    "risk_series": ["Treatment"] * 7 + ["Placebo"] * 7, "risk_x": [0.0, 6.0, 12.0, 18.0, 24.0, 30.0, 36.0] * 2,
    "events_total": None, "events_series": None,
}


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TABLES["spec"]).json(path)


def rows(spark: SparkSession, specs: dict[str, dict]) -> DataFrame:
    """specs: image_id -> inputs; what is absent is null."""
    names = [c.split()[0] for c in TABLES["spec"].split(", ")]
    return spark.createDataFrame([tuple({"image_id": k, **v}.get(n) for n in names) for k, v in specs.items()], TABLES["spec"])
