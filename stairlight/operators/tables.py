"""Risk table shapes. Column lists are taken from an ordered list, never inferred by a second job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def time_name(x: float) -> str:
    """15 significant digits at most, without a trailing point: 0, 6, 0.5."""
    return f"{x:.15g}"


def wide(risk: DataFrame, series: list[str]) -> DataFrame:
    """A row per image and time, a column per series in the given order; null where there is no entry."""
    return risk.groupBy("image_id", "x").pivot("series", series).agg(F.first("patients"))


def transposed(risk: DataFrame, times: list[float]) -> DataFrame:
    """A row per image and series, a column per time, ascending."""
    named = {t: time_name(t) for t in sorted(set(times))}
    out = risk.groupBy("image_id", "series").pivot("x", list(named)).agg(F.first("patients"))
    return out.toDF("image_id", "series", *named.values())


def ordered_series(risk: DataFrame) -> list[str]:
    """Series in order of first appearance (smallest ord): one row per distinct series reaches the driver."""
    return [r["series"] for r in risk.groupBy("series").agg(F.min("ord").alias("o")).orderBy("o", "series").collect()]


def table(risk: DataFrame | None, mode: str = "transposed") -> DataFrame | None:
    """The risk table as transposed, wide or long; None before there is one."""
    if mode not in ("transposed", "wide", "long"):
        raise ValueError("mode must be transposed, wide or long")
    if risk is None or mode == "long":
        return risk
    if mode == "wide":
        return wide(risk, ordered_series(risk))
    return transposed(risk, [r["x"] for r in risk.select("x").distinct().collect()])
