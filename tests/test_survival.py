"""Kaplan-Meier, Cox, reconstruction, scaling, tables and validation on small literal cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stairlight.operators import cox, guyot, km, scale, tables, validate
from stairlight.schemas import DataError
from stairlight.sources import spec as specs

IPD = [("Placebo", t, s) for t, s in zip([1, 2, 3, 4, 5], [1, 1, 1, 0, 1])] + [("Drug", t, s) for t, s in zip([2, 4, 6, 8, 10], [1, 1, 0, 1, 1])]


@pytest.fixture(scope="module")
def ipd(spark):
    return spark.createDataFrame([("a", s, float(t), e) for s, t, e in IPD], "image_id string, series string, time double, status int")


@pytest.fixture(scope="module")
def legend(spark):
    return spark.createDataFrame([("a", 1, "Placebo", "#dc3030", True), ("a", 2, "Drug", "#3030a0", False)], "image_id string, ord int, series string, color string, reference boolean")


def test_quantiles_literal(ipd):
    rows = {(r["series"], r["survival"]): r["time"] for r in km.quantiles(ipd, [0.75, 0.5, 0.25]).collect()}
    assert [rows["Placebo", p] for p in (0.75, 0.5, 0.25)] == [2, 3, 5]
    assert [rows["Drug", p] for p in (0.75, 0.5, 0.25)] == [4, 8, 10]


def test_quantile_on_a_level_stretch_is_its_middle(spark):
    data = spark.createDataFrame([("a", "s", float(t), 1) for t in (1, 2, 3, 4)], "image_id string, series string, time double, status int")
    assert km.quantiles(data, [0.5]).first()["time"] == 2.5
    assert km.quantiles(data, [0.5], midpoint=False).first()["time"] == 2.0


def test_unreached_quantile_is_null(spark):
    data = spark.createDataFrame([("a", "s", 1.0, 0), ("a", "s", 2.0, 0)], "image_id string, series string, time double, status int")
    assert km.quantiles(data, [0.5]).first()["time"] is None


def test_probabilities_extend_and_complement(ipd):
    rows = {(r["series"], r["time"]): r for r in km.probabilities(ipd, [0.5, 3, 99]).collect()}
    assert rows["Placebo", 0.5]["survival"] == 1.0
    assert rows["Drug", 99]["survival"] == pytest.approx(0.0)
    r = rows["Placebo", 3]
    assert r["survival"] == pytest.approx(0.4) and r["incidence"] == pytest.approx(0.6)
    assert r["incidence_lower"] == pytest.approx(1 - r["survival_lower"])


def test_log_limits(spark):
    rows = [("a", "s", 3.0, 1)] * 33 + [("a", "s", 9.0, 0)] * 317
    data = spark.createDataFrame(rows, "image_id string, series string, time double, status int")
    r = km.probabilities(data, [3.0]).first()
    assert (round(r["survival_lower"], 3), round(r["survival_upper"], 3)) == (0.876, 0.937)


def test_counts(ipd, legend):
    rows = {r["series"]: (r["patients"], r["events"]) for r in km.counts(ipd, legend).collect()}
    assert rows == {"Placebo": (5, 4), "Drug": (5, 4), "total": (10, 8)}


def test_counts_of_an_absent_series(ipd, legend, spark):
    more = legend.unionByName(spark.createDataFrame([("a", 3, "None", "#000000", False)], legend.schema))
    rows = {r["series"]: r["patients"] for r in km.counts(ipd, more).collect()}
    assert rows["None"] == 0 and rows["total"] == 10


def brute_loglik(beta, data):
    """Efron's partial log likelihood, patient by patient."""
    total = 0.0
    for t in sorted({t for _, t, e in data if e}):
        risk = [s for s, u, _ in data if u >= t]
        dead = [s for s, u, e in data if u == t and e]
        w = lambda s: math.exp(beta if s == "Drug" else 0.0)
        a, b = sum(map(w, risk)), sum(map(w, dead))
        total += sum(math.log(w(s)) for s in dead) - sum(math.log(a - k / len(dead) * b) for k in range(len(dead)))
    return total


def test_hazard_ratio_maximises_the_likelihood(ipd, legend):
    r = cox.hazard_ratios(ipd, legend).first()
    beta = math.log(r["estimate"])
    best = max(np.linspace(-4, 4, 4001), key=lambda b: brute_loglik(b, IPD))
    assert r["series"] == "Drug" and beta == pytest.approx(best, abs=3e-3)
    assert r["lower"] < r["estimate"] < r["upper"] and 0 < r["p_value"] <= 1


def test_hazard_ratio_inverts_with_the_reference(ipd, legend):
    other = legend.withColumn("reference", F.col("series") == "Drug")
    a, b = cox.hazard_ratios(ipd, legend).first(), cox.hazard_ratios(ipd, other).first()
    assert a["estimate"] == pytest.approx(1 / b["estimate"]) and a["p_value"] == pytest.approx(b["p_value"])


def test_hazard_ratio_needs_a_comparator(ipd, legend):
    with pytest.raises(Exception, match="at least one other"):
        cox.hazard_ratios(ipd.filter("series = 'Placebo'"), legend).collect()


X = [float(x) for x in range(11)]
CURVES = {"Placebo": [1 - 0.05 * x for x in range(11)], "Drug": [1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2]}
AT_RISK = {"Placebo": [100, 80, 60], "Drug": [100, 70, 40]}


def scaled_and_risk(spark, curves=CURVES, risk=AT_RISK):
    scaled = spark.createDataFrame([("a", s, x, float(y)) for s, c in curves.items() for x, y in zip(X, c)], "image_id string, series string, x double, y double")
    rows = [("a", i + 1, n, s, t) for i, s in enumerate(risk) for n, t in zip(risk[s], [0.0, 4.0, 8.0])]
    return scaled, spark.createDataFrame(rows, "image_id string, ord int, patients int, series string, x double")


def test_guyot_counts_and_status(spark):
    out = guyot.survival(*scaled_and_risk(spark)).toPandas()
    assert out.groupby("series").size().to_dict() == {"Placebo": 100, "Drug": 100}
    assert set(out["status"]) <= {0, 1} and (out["time"] >= 0).all()


def test_guyot_curve_is_recovered(spark):
    scaled, risk = scaled_and_risk(spark)
    found = km.probabilities(guyot.survival(scaled, risk), X)
    both = found.join(scaled.select("series", F.col("x").alias("time"), "y"), ["series", "time"])
    assert both.agg(F.max(F.abs(F.col("survival") - F.col("y")))).first()[0] < 0.02


def test_guyot_uses_total_events(spark):
    curve = {"s": [1, 0.97, 0.94, 0.92, 0.9, 0.89, 0.88, 0.86, 0.85, 0.84, 0.83]}
    scaled, risk = scaled_and_risk(spark, curve, {"s": [100, 50, 30]})
    events = spark.createDataFrame([("a", "s", 11)], "image_id string, series string, events int")
    free, bound = (guyot.survival(scaled, risk, e).toPandas() for e in (None, events))
    assert len(free) == len(bound) == 100
    assert abs(bound["status"].sum() - 11) <= abs(free["status"].sum() - 11)


def test_guyot_single_risk_entry(spark):
    scaled, risk = scaled_and_risk(spark)
    out = guyot.survival(scaled, risk.filter("x = 0")).toPandas()
    assert out.groupby("series").size().to_dict() == {"Placebo": 100, "Drug": 100}


@pytest.mark.parametrize(("change", "message"), [
    (lambda s, r, e: (s.filter("series = 'Drug'"), r, e), "not in trace: Placebo"),
    (lambda s, r, e: (s, r.withColumn("patients", F.when(F.col("x") == 8, 500).otherwise(F.col("patients"))), e), "non-increasing"),
    (lambda s, r, e: (s, r.withColumn("patients", F.col("patients") - 90), e), "negative"),
    (lambda s, r, e: (s, r, e.withColumn("events", F.lit(101))), "exceed"),
    (lambda s, r, e: (s, r, e.withColumn("events", F.lit(-1))), "negative"),
    (lambda s, r, e: (s, r, e.withColumn("series", F.lit("Other"))), "no risk table entries: Other"),
    (lambda s, r, e: (s.drop("y"), r, e), "missing: y"),
])
def test_survival_rules(spark, change, message):
    events = spark.createDataFrame([("a", "Drug", 30)], "image_id string, series string, events int")
    scaled, risk = scaled_and_risk(spark)
    validate.assert_survival(scaled, risk, events)
    with pytest.raises(DataError, match=message):
        validate.assert_survival(*change(scaled, risk, events))


def test_risk_from_spec_in_legend_order(spark, legend):
    spec = specs.rows(spark, {"a": {"risk_patients": [5, 9, 7, 4], "risk_series": ["Drug", "Placebo", "Placebo", "Drug"], "risk_x": [6.0, 6.0, 0.0, 9.0]}})
    rows = validate.risk_table(spec, legend).orderBy("ord", "x").collect()
    assert [(r["series"], r["x"], r["patients"]) for r in rows] == [("Placebo", 0.0, 7), ("Placebo", 6.0, 9), ("Drug", 6.0, 5), ("Drug", 9.0, 4)]
    with pytest.raises(DataError, match="Missing: Drug"):
        validate.risk_table(specs.rows(spark, {"a": {"risk_patients": [5], "risk_series": ["Placebo"], "risk_x": [0.0]}}), legend)
    with pytest.raises(DataError, match="Invalid series names: X"):
        validate.risk_table(specs.rows(spark, {"a": {"risk_patients": [5], "risk_series": ["X"], "risk_x": [0.0]}}), legend)


def test_events_from_spec(spark, legend):
    assert validate.events_table(specs.rows(spark, {"a": {"events_total": [], "events_series": []}}), legend) is None
    rows = validate.events_table(specs.rows(spark, {"a": {"events_total": [3, 4], "events_series": ["Drug", "Placebo"]}}), legend).orderBy("ord").collect()
    assert [(r["series"], r["events"]) for r in rows] == [("Placebo", 4), ("Drug", 3)]
    for bad, message in (({"events_total": [3], "events_series": []}, "together"), ({"events_total": [3, 4], "events_series": ["Drug", "Drug"]}, "repeated: Drug")):
        with pytest.raises(DataError, match=message):
            validate.events_table(specs.rows(spark, {"a": bad}), legend)


def test_risk_tables(spark):
    risk = spark.createDataFrame([("a", 1, "Placebo", 0.0, 100), ("a", 1, "Placebo", 6.0, 80), ("a", 2, "Drug", 0.0, 95)], "image_id string, ord int, series string, x double, patients int")
    wide = {r["x"]: (r["Placebo"], r["Drug"]) for r in tables.table(risk, "wide").collect()}
    assert wide == {0.0: (100, 95), 6.0: (80, None)}
    across = tables.table(risk)
    assert across.columns == ["image_id", "series", "0", "6"]
    assert {r["series"]: (r["0"], r["6"]) for r in across.collect()} == {"Placebo": (100, 80), "Drug": (95, None)}
    assert tables.table(None) is None and tables.time_name(0.5) == "0.5"


def test_calibration(spark):
    points = spark.createDataFrame([("a", p, v) for p, v in zip([2.0, 4.0, 6.0, 8.0], [0.0, 5.0, 10.0, 15.0])], "image_id string, pixel double, value double")
    r = scale.calibration(points, ["image_id"]).first()
    assert (r["slope"], r["intercept"]) == pytest.approx((2.5, -5))
    with pytest.raises(DataError, match="identical"):
        scale.assert_calibrated(scale.calibration(points.withColumn("pixel", F.lit(1.0)), ["image_id"]))


def test_scale_canonical_form(spark):
    rows = [("a", "s", float(x), 10.0 * x) for x in range(-1, 9)]
    out = scale.in_order(scale.canonical(spark.createDataFrame(rows, "image_id string, series string, x double, y double"))).collect()
    assert (out[0]["x"], out[0]["y"], out[0]["max_y"], out[0]["increasing"]) == (0.0, 1.0, 100.0, True)
    assert len(out) == 10 and out[-1]["y"] == pytest.approx(0.2)


def test_scale_end_to_end(spark, legend):
    path = spark.createDataFrame([("a", 10 * i, 10 + 10 * i, "#dc3030") for i in range(1, 10)], "image_id string, x int, y int, color string")
    axis = lambda rows, c: spark.createDataFrame([("a", v, float(p)) for v, p in rows], f"image_id string, value double, {c} double")
    args = path, axis([(0.0, 0), (10.0, 100)], "x"), axis([(0.0, 100), (1.0, 0)], "y")
    out = scale.in_order(scale.scale(*args, legend)).collect()
    assert [r["x"] for r in out] == [0.0, *range(1, 10)] and out[1]["y"] == pytest.approx(0.8)
    with pytest.raises(DataError, match="not in legend: #dc3030"):
        scale.scale(*args, legend.filter("series = 'Drug'"))
