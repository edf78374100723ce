"""Fixed table schemas; names are checked eagerly, data rules by one aggregate each (see operators.validate)."""

from __future__ import annotations

from pyspark.sql import DataFrame

IMAGE = "image_id string"
TABLES = {
    "raster": f"{IMAGE}, height int, width int, data binary",
    "pixel": f"{IMAGE}, x int, y int, color string",
    "label": f"{IMAGE}, label string, word string, confidence double, x double, y double, x1 int, x2 int, y1 int, y2 int",
    "axis": f"{IMAGE}, label string, value double, x double, y double, x1 int, x2 int, y1 int, y2 int",
    "panel": f"{IMAGE}, x1 int, x2 int, y1 int, y2 int, pad_x1 int, pad_x2 int, pad_y1 int, pad_y2 int",
    "legend": f"{IMAGE}, ord int, series string, color string, reference boolean",
    "path": f"{IMAGE}, x int, y int, color string, line_width int, width int, height int",
    "risk": f"{IMAGE}, ord int, patients int, series string, x double",
    "events": f"{IMAGE}, ord int, series string, events int",
    "scaled": f"{IMAGE}, series string, x double, y double, max_y double, increasing boolean",
    "survival": f"{IMAGE}, ord int, series string, time double, status int",
    "hazard_ratios": f"{IMAGE}, series string, estimate double, lower double, upper double, p_value double",
    "spec": f"{IMAGE}, x_label array<string>, x_value array<double>, y_label array<string>, y_value array<double>, background string, garbage array<string>, series array<string>, series_names array<string>, reference string, risk_patients array<int>, risk_series array<string>, risk_x array<double>, events_total array<int>, events_series array<string>",
}


class DataError(ValueError):
    """A rule about the data does not hold."""


def require(df: DataFrame, name: str, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise DataError(f"{name} must have columns {', '.join(columns)}; missing: {', '.join(missing)}")
