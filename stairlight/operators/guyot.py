"""Individual patient data from a curve and numbers at risk, by the published Guyot inversion.

One group a series of a figure (a curve has at most a few thousand points), so a task holds little whatever the
number of figures. Choices that the paper leaves open: counts are rounded half to even, an interval's censorings are
adjusted at most 200 times, and censorings lie in the middle between two points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..schemas import TABLES
from . import validate


def prepare(time: np.ndarray, surv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points from (0, 1) on, survival never rising and within 0 to 1, the lowest one at each time."""
    order = np.lexsort((-surv, time))
    t, s = time[order], np.minimum.accumulate(np.clip(surv[order], 0, 1))
    last = np.append(t[1:] != t[:-1], True)
    t, s = t[last], s[last]
    if not len(t) or t[0] > 0:
        t, s = np.insert(t, 0, 0.0), np.insert(s, 0, 1.0)
    return t, s


def _censored(t: np.ndarray, begin: float, end: float, n: int) -> np.ndarray:
    """n censorings evenly over an interval, counted at the point they follow."""
    at = begin + (np.arange(n) + 1) * (end - begin) / (n + 1)
    return np.bincount(np.maximum(np.searchsorted(t, at, "right") - 1, 0), minlength=len(t)) if n else np.zeros(len(t), int)


def _walk(s: np.ndarray, censored: np.ndarray, n: int, last: float) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Events and censorings at each point, patients left and the estimate reached."""
    d, c = np.zeros(len(s), int), np.zeros(len(s), int)
    for k in range(len(s)):
        if n > 0 and last > 0:
            d[k] = min(n, max(0, round(n * (1 - s[k] / last))))
            last *= 1 - d[k] / n
        c[k] = min(int(censored[k]), n - d[k])
        n -= d[k] + c[k]
    return d, c, n, last


def invert(time: np.ndarray, surv: np.ndarray, risk_x: np.ndarray, risk_n: np.ndarray, total: int | None = None) -> pd.DataFrame:
    """time and status of as many patients as the first number at risk."""
    t, s = prepare(np.asarray(time, float), np.asarray(surv, float))
    keep = np.asarray(risk_x, float) <= t[-1]
    order = np.argsort(np.asarray(risk_x, float)[keep], kind="stable")
    risk_x, risk_n = np.asarray(risk_x, float)[keep][order], np.asarray(risk_n, int)[keep][order]
    if not len(risk_x):
        return pd.DataFrame({"time": [], "status": []})
    edges = np.append(np.searchsorted(t, risk_x), len(t))
    edges[0] = 0
    n, last = int(risk_n[0]), 1.0
    events, censored = np.zeros(len(t), int), np.zeros(len(t), int)
    for i in range(len(risk_x)):
        part = slice(edges[i], edges[i + 1])
        own, points = t[part], s[part]
        final = i == len(risk_x) - 1
        end = t[-1] if final else risk_x[i + 1]
        goal = None if final else int(risk_n[i + 1])
        if not len(own):
            continue
        if not final:
            guess = round(n * (s[min(edges[i + 1], len(s) - 1)] / max(last, 1e-12)) - goal)
        elif total is None:
            span = risk_x[i] - risk_x[0]
            guess = min(n, round(censored.sum() / span * (end - risk_x[i]))) if span > 0 else 0
        else:
            guess = 0
        guess, best = max(0, guess), None
        for _ in range(200):
            d, c, left, reached = _walk(points, _censored(own, risk_x[i], end, guess), n, last)
            if not final:
                gap = left - goal
            elif total is not None:
                gap = int(events.sum() + d.sum()) - total  # more censoring, fewer events
            else:
                gap = 0
            if best is None or abs(gap) < best[0]:
                best = (abs(gap), d, c, left, reached)
            if gap == 0 or guess + gap < 0 and guess == 0:
                break
            guess = min(n, max(0, guess + gap))
        _, d, c, n, last = best
        events[part], censored[part] = d, c
    until = np.append(t[1:], t[-1])
    return pd.DataFrame({
        "time": np.concatenate([np.repeat(t, events), np.repeat((t + until) / 2, censored), np.full(n, t[-1])]),
        "status": np.concatenate([np.ones(events.sum(), int), np.zeros(censored.sum() + n, int)]),
    })


def survival(scaled: DataFrame, risk: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """One row a patient. Series come in the risk table's order (ord). A missing total is none, not zero."""
    validate.assert_survival(scaled, risk, events)
    curves = scaled.groupBy("image_id", "series").agg(F.collect_list(F.struct("x", "y")).alias("curve"))
    at_risk = risk.groupBy("image_id", "series").agg(F.min("ord").alias("ord"), F.collect_list(F.struct("x", "patients")).alias("risk"))
    rows = curves.join(at_risk, ["image_id", "series"])
    if events is None:
        rows = rows.withColumn("total", F.lit(None).cast("int"))
    else:
        rows = rows.join(events.select("image_id", "series", F.col("events").alias("total")), ["image_id", "series"], "left")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                x, y = (np.array([p[k] for p in r.curve], float) for k in ("x", "y"))
                found = invert(x, y, np.array([p["x"] for p in r.risk]), np.array([p["patients"] for p in r.risk]), None if pd.isna(r.total) else int(r.total))
                # a series at a time: a batch's may be all patients there are
                yield found.assign(image_id=r.image_id, ord=r.ord, series=r.series)[["image_id", "ord", "series", "time", "status"]]

    return rows.select("image_id", "ord", "series", "curve", "risk", "total").mapInPandas(run, TABLES["survival"])
