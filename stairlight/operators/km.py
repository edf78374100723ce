"""Kaplan-Meier relations over individual patient data (image_id, series, time, status).

One aggregate per (image, series, time), then windows over that key: rows per group are the distinct times, however
many patients share them. All windows use one partitioning, so the fit costs one exchange after the aggregate.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, functions as F

KEY = ["image_id", "series"]
#: Survival is taken to equal a probability within this distance.
SAME = 1.5e-8


def fit(data: DataFrame) -> DataFrame:
    """image_id, series, time, n_risk, n_event, n_censor, surv and Greenwood's sum. Events precede censorings."""
    at = data.groupBy(*KEY, "time").agg(F.sum(F.when(F.col("status") == 1, 1).otherwise(0)).alias("n_event"), F.sum(F.when(F.col("status") == 1, 0).otherwise(1)).alias("n_censor"))
    later = Window.partitionBy(*KEY).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*KEY).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumn("n_risk", F.sum(F.col("n_event") + F.col("n_censor")).over(later))
    n, d = F.col("n_risk").cast("double"), F.col("n_event").cast("double")
    at = at.withColumn("surv", F.product(1.0 - d / n).over(before))
    return at.withColumn("greenwood", F.sum(F.when(n > d, d / (n * (n - d))).otherwise(F.lit(0.0))).over(before))


def with_limits(km: DataFrame, confidence: float = 0.95) -> DataFrame:
    """lower and upper on the log scale: null where survival is zero, the upper one at most 1."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    width = z * F.sqrt("greenwood")
    alive = F.col("surv") > 0
    return km.withColumn("lower", F.when(alive, F.col("surv") * F.exp(-width))).withColumn("upper", F.when(alive, F.least(F.lit(1.0), F.col("surv") * F.exp(width))))


def _first_time(curve: Column, p: Column, midpoint: bool) -> tuple[Column, Column]:
    """Aggregates: the first time at which the curve is at or under p, and the end of the flat stretch on p."""
    reach = F.min(F.when(curve <= p + SAME, F.col("time")))
    beyond = F.min(F.when(curve < p - SAME, F.col("time")))
    on = F.max(F.when(F.abs(curve - p) <= SAME, F.lit(1)).otherwise(0))
    return F.when((on == 1) & F.lit(midpoint) & beyond.isNotNull(), (reach + beyond) / 2).otherwise(reach), on


def quantiles(data: DataFrame, probabilities: list[float], confidence: float = 0.95, midpoint: bool = True) -> DataFrame:
    """Time at which survival reaches each probability (null: never), with the times of the confidence curves. Where
    the curve is level on a probability, the middle of the level stretch. Rows are to be read survival descending."""
    wanted = sorted(set(probabilities), reverse=True)
    asked = F.broadcast(data.sparkSession.createDataFrame([(float(p),) for p in wanted], "survival double"))
    km = with_limits(fit(data), confidence).crossJoin(asked)
    p = F.col("survival")
    out = km.groupBy(*KEY, "survival").agg(*[_first_time(F.col(c), p, midpoint)[0].alias(name) for c, name in (("surv", "time"), ("lower", "time_lower"), ("upper", "time_upper"))])
    return out.select(*KEY, "survival", (1 - F.col("survival")).alias("incidence"), "time", "time_lower", "time_upper")


def incidence_quantiles(data: DataFrame, probabilities: list[float], confidence: float = 0.95) -> DataFrame:
    return quantiles(data, [1 - p for p in probabilities], confidence)


def probabilities(data: DataFrame, times: list[float], confidence: float = 0.95) -> DataFrame:
    """Survival at each time (the last known value; 1 before the first) and its complement. An incidence's lower
    limit is the complement of survival's lower one."""
    asked = F.broadcast(data.sparkSession.createDataFrame([(float(t),) for t in sorted(set(times))], "at double"))
    km = with_limits(fit(data), confidence).crossJoin(asked)
    known = F.col("time") <= F.col("at")
    last = km.groupBy(*KEY, "at").agg(F.max_by(F.struct("surv", "lower", "upper"), F.when(known, F.col("time"))).alias("v"), F.max(known).alias("any"))
    value = lambda c: F.when(F.col("any"), F.col(f"v.{c}")).otherwise(F.lit(1.0))
    out = last.select(*KEY, F.col("at").alias("time"), value("surv").alias("survival"), value("lower").alias("survival_lower"), value("upper").alias("survival_upper"))
    for c in ("", "_lower", "_upper"):
        out = out.withColumn(f"incidence{c}", 1 - F.col(f"survival{c}"))
    return out


def counts(data: DataFrame, legend: DataFrame) -> DataFrame:
    """Patients and events of each legend series (0 if absent) and a `total` row of them, in legend order."""
    found = data.groupBy(*KEY).agg(F.count(F.lit(1)).alias("patients"), F.sum(F.when(F.col("status") == 1, 1).otherwise(0)).alias("events"))
    each = legend.select("image_id", "ord", "series").join(found, KEY, "left").fillna(0, ["patients", "events"])
    rolled = each.rollup("image_id", "series").agg(F.max("ord").alias("ord"), F.sum("patients").alias("patients"), F.sum("events").alias("events")).filter("image_id is not null")
    return rolled.select("image_id", F.when(F.col("series").isNull(), F.col("ord") + 1).otherwise(F.col("ord")).alias("ord"), F.coalesce("series", F.lit("total")).alias("series"), "patients", "events")


def numbers_at_risk(data: DataFrame, times: list[float]) -> DataFrame:
    """Patients whose time is at or after each given time."""
    counts = [F.sum((F.col("time") >= t).cast("int")).alias(f"_{i}") for i, t in enumerate(times)]
    wide = data.groupBy(*KEY).agg(*counts)
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("x"), F.col(f"_{i}").alias("patients")) for i, t in enumerate(times)])
    return wide.select(*KEY, F.inline(pairs))


def example_times(data: DataFrame) -> DataFrame:
    """The 50 and 75 % sample quantiles of time, one decimal."""
    return data.groupBy("image_id").agg(*[F.round(F.percentile("time", q), 1).alias(f"q{int(100 * q)}") for q in (0.5, 0.75)])
