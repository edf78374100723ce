"""Cox proportional hazards on series indicators, with Efron's ties.

At an event time the likelihood needs only the patients at risk and the events of each series, which one aggregate
and one window give. The Newton steps then run on that small table, one group an image."""

from __future__ import annotations

import math
import warnings
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..schemas import TABLES, DataError

KEY = ["image_id", "series"]


def risk_sets(data: DataFrame) -> DataFrame:
    """image_id, time, series, n_risk, n_event for every event time of the image and every series of it."""
    at = data.groupBy(*KEY, "time").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status") == 1).cast("int")).alias("n_event"))
    times = at.filter("n_event > 0").select("image_id", "time").distinct()
    grid = times.join(data.select(*KEY).distinct(), "image_id")
    both = at.select(*KEY, "time", "n", "n_event").unionByName(grid.select(*KEY, "time", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_event")))
    both = both.groupBy(*KEY, "time").agg(F.sum("n").alias("n"), F.sum("n_event").alias("n_event"))
    later = Window.partitionBy(*KEY).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("n_risk", F.sum("n").over(later))
    return both.join(times, ["image_id", "time"], "left_semi").select("image_id", "time", "series", "n_risk", "n_event")


def score_at_zero(data: DataFrame) -> DataFrame:
    """Events and expected events of each series when all hazards are equal: the score at zero is their difference."""
    own = Window.partitionBy("image_id", "time")
    sets = risk_sets(data).withColumn("n", F.sum("n_risk").over(own)).withColumn("d", F.sum("n_event").over(own))
    return sets.groupBy(*KEY).agg(F.sum("n_event").alias("observed"), F.sum(F.col("d") * F.col("n_risk") / F.col("n")).alias("expected"))


def newton(at_risk: np.ndarray, events: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray, bool]:
    """Coefficients of the series after the first and their covariance; arrays are (times, series)."""
    k = at_risk.shape[1] - 1
    # times with the same numbers at risk and of events have the same terms: each term once, with its weight
    kinds, weight = np.unique(np.concatenate([at_risk, events], 1), axis=0, return_counts=True)
    at, own = kinds[:, : k + 1], kinds[:, k + 1 :]
    d = own.sum(1).astype(int)
    row = np.repeat(np.arange(len(d)), d)
    share = np.arange(len(row)) - np.repeat(np.cumsum(d) - d, d)
    share, times = share / np.maximum(d[row], 1), weight[row][:, None]
    beta, information = np.zeros(k), np.eye(k)
    for _ in range(steps):
        risk = np.exp(np.concatenate([[0.0], np.clip(beta, -30, 30)]))
        hazard = (at[row] - share[:, None] * own[row]) * risk
        p = (hazard / hazard.sum(1, keepdims=True))[:, 1:]
        expected = (p * times).sum(0)
        score = events[:, 1:].sum(0) - expected
        information = np.diag(expected) - (p * times).T @ p
        step = np.linalg.pinv(information) @ score
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max(initial=0) < 1e-10:
            return beta, np.linalg.pinv(information), True
    return beta, np.linalg.pinv(information), False


def hazard_ratios(data: DataFrame, legend: DataFrame, confidence: float = 0.95) -> DataFrame:
    """exp(coefficient), its limits and Wald p-value of each series against the legend's reference."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    named = risk_sets(data).join(legend.select("image_id", "series", "reference", "ord"), KEY)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf[["series", "reference", "ord"]].drop_duplicates().sort_values(["reference", "ord"], ascending=[False, True])
        series = order["series"].tolist()
        if len(series) < 2 or not order["reference"].iloc[0]:
            raise DataError("hazard ratios need a reference series and at least one other")
        wide = {c: pdf.pivot(index="time", columns="series", values=c)[series].fillna(0).to_numpy() for c in ("n_risk", "n_event")}
        beta, cov, done = newton(wide["n_risk"].astype(float), wide["n_event"].astype(int))
        if not done:
            warnings.warn("hazard ratio did not converge; an arm may have no events", stacklevel=1)
        se = np.sqrt(np.maximum(np.diag(cov), 0))
        p = [math.erfc(abs(b / s) / math.sqrt(2)) if s > 0 else float("nan") for b, s in zip(beta, se, strict=True)]
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "series": series[1:], "estimate": np.exp(beta), "lower": np.exp(beta - z * se), "upper": np.exp(beta + z * se), "p_value": p})

    return named.groupBy("image_id").applyInPandas(run, TABLES["hazard_ratios"])
