"""Data rules. Each violations_* function returns the rows that break a rule; assert_* raise on the first.

The rules run before any raster work, so a wrong number fails early."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..schemas import DataError, require


Rule = tuple[DataFrame, str, str]


def check(rules: list[Rule]) -> None:
    """Rules are (rows that break it, the column that names an offender, message). All are looked at in one job; the
    first that is broken is raised, with at most 20 offenders."""
    named = [bad.select(F.lit(i).alias("rule"), F.col(column).cast("string").alias("who")).distinct().orderBy("who").limit(20) for i, (bad, column, _) in enumerate(rules)]
    every = named[0]
    for more in named[1:]:
        every = every.unionByName(more)
    found = every.collect()
    if found:
        first = min(r["rule"] for r in found)
        raise DataError(rules[first][2].format(", ".join(sorted(str(r["who"]) for r in found if r["rule"] == first))))


def unknown(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys right does not have."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def shared(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of left whose keys right has too."""
    return left.join(right.select(*keys).distinct(), keys, "left_semi")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def rising(risk: DataFrame) -> DataFrame:
    """Entries with more patients at risk than the entry before (ties allowed)."""
    before = F.lag("patients").over(Window.partitionBy("image_id", "series").orderBy("x"))
    return risk.withColumn("before", before).filter("patients > before")


def excess_events(risk: DataFrame, events: DataFrame) -> DataFrame:
    """Totals above the patients at risk, for series whose table begins at time 0."""
    first = risk.groupBy("image_id", "series").agg(F.max("patients").alias("randomized"), F.min("x").alias("start"))
    return events.join(first, ["image_id", "series"]).filter("start = 0 and events > randomized")


def assert_survival(scaled: DataFrame, risk: DataFrame, events: DataFrame | None = None) -> None:
    require(scaled, "scaled", ["image_id", "series", "x", "y"])
    require(risk, "risk_table", ["image_id", "series", "x", "patients"])
    rules = [(risk.filter("patients is null or patients < 0"), "series", "Patients at risk must not be negative: {}"), (unknown(risk, scaled, ["image_id", "series"]), "series", "Risk table contains series not in trace: {}")]
    if events is not None:
        require(events, "events_table", ["image_id", "series", "events"])
        rules += [
            (events.filter("events is null or events < 0"), "series", "Total events must not be missing or negative: {}"),
            (unknown(events, risk, ["image_id", "series"]), "series", "Total events reported for series with no risk table entries: {}"),
            (excess_events(risk, events), "series", "Total events exceed the number of patients at risk at time 0: {}"),
        ]
    check([*rules, (rising(risk), "series", "Numbers at risk must be non-increasing over time: {}")])


def risk_table(spec: DataFrame, legend: DataFrame) -> DataFrame:
    """Risk entries of each image's spec in legend order, then by time; repeated entries are an error."""
    lengths = [F.coalesce(F.size(c), F.lit(0)) for c in ("risk_patients", "risk_series", "risk_x")]
    rows = spec.select("image_id", F.inline(F.arrays_zip("risk_patients", "risk_series", "risk_x")))
    rows = rows.select("image_id", F.col("risk_patients").cast("int").alias("patients"), F.col("risk_series").alias("series"), F.col("risk_x").cast("double").alias("x"))
    check([
        (spec.filter((lengths[0] != lengths[1]) | (lengths[0] != lengths[2]) | (lengths[0] < 1)), "image_id", "the lists of risk_patients, risk_series and risk_x differ in length or are empty in: {}"),
        (rows.filter("series is null or series = ''"), "image_id", "risk_series has an empty name in: {}"),
        (unknown(rows, legend, ["image_id", "series"]), "series", "Invalid series names: {}"),
        (unknown(legend, rows, ["image_id", "series"]), "series", "Risk table must have entries for every series. Missing: {}"),
        (rows.filter("patients is null or patients < 0"), "series", "risk_patients has a missing or negative number for: {}"),
        (rows.filter("x is null or isnan(x)"), "series", "risk_x has a missing time for: {}"),
        (repeated(rows, ["image_id", "series", "x"]), "series", "risk entries repeat a time for: {}"),
    ])
    return rows.join(legend.select("image_id", "series", "ord"), ["image_id", "series"]).select("image_id", "ord", "patients", "series", "x").orderBy("image_id", "ord", "x")


def events_table(spec: DataFrame, legend: DataFrame) -> DataFrame | None:
    """Total events in legend order; None when no image reports any (a count of zero length is none)."""
    total, names = (F.coalesce(F.size(c), F.lit(0)) for c in ("events_total", "events_series"))
    total, names = F.greatest(total, F.lit(0)), F.greatest(names, F.lit(0))
    given = spec.filter((total > 0) | (names > 0))
    if given.isEmpty():
        return None
    rows = given.select("image_id", F.inline(F.arrays_zip("events_total", "events_series")))
    rows = rows.select("image_id", F.col("events_series").alias("series"), F.col("events_total").cast("int").alias("events"))
    check([
        (given.filter((total == 0) | (names == 0)), "image_id", "events_total and events_series must come together: {}"),
        (given.filter(total != names), "image_id", "events_total and events_series differ in length in: {}"),
        (rows.filter("series is null or series = ''"), "image_id", "events_series has an empty name in: {}"),
        (unknown(rows, legend, ["image_id", "series"]), "series", "Invalid series names: {}"),
        (repeated(rows, ["image_id", "series"]), "series", "Total events must have at most one entry per series, but these are repeated: {}"),
    ])
    return rows.join(legend.select("image_id", "series", "ord"), ["image_id", "series"]).select("image_id", "ord", "series", "events").orderBy("image_id", "ord")
