"""The driver's queries: every operator on the driver's tables, with the same result as DuckDB SQL.

`events` stands in for patients (series = event_type, time = value), `embeddings` for pixel matrices (50 vectors are the
rows of an image of 64 columns), `lineitem` for text boxes, `part` for colours and names. Every query reads its whole
table. Doubles are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import colors, text
from ..operators import calibrate, cox, guyot, km, ocr, pixels, raster, render, scale, tables, validate
from ..sources import spec as specs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Z = 1.959963984540054
RISK_TIMES = [0.0, 50.0, 100.0, 150.0, 200.0]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- patients -------------------------------------------------------------------------------------------------

IPD = """ipd AS (SELECT 'fig' || (user_id % 4) AS image_id, event_type AS series, value AS time,
  CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS status FROM events)"""
KM = (
    IPD
    + """, tab AS (SELECT image_id, series, time, sum(status) AS n_event, sum(1 - status) AS n_censor FROM ipd GROUP BY ALL),
risk AS (SELECT *, sum(n_event + n_censor) OVER (PARTITION BY image_id, series ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n_risk FROM tab),
km AS (SELECT image_id, series, time, n_event::BIGINT AS n_event, n_censor::BIGINT AS n_censor, n_risk::BIGINT AS n_risk,
  CASE WHEN min(n_risk - n_event) OVER w = 0 THEN 0.0::DOUBLE ELSE exp(sum(CASE WHEN n_risk > n_event THEN ln(1 - n_event::DOUBLE / n_risk) ELSE 0 END) OVER w) END AS surv,
  sum(CASE WHEN n_risk > n_event THEN n_event::DOUBLE / (n_risk::DOUBLE * (n_risk - n_event)) ELSE 0 END) OVER w AS greenwood
  FROM risk WINDOW w AS (PARTITION BY image_id, series ORDER BY time ROWS UNBOUNDED PRECEDING))"""
)
LIMITS = (
    KM
    + f""", lim AS (SELECT *, CASE WHEN surv > 0 THEN surv * exp(-{Z}::DOUBLE * sqrt(greenwood)) END AS lower,
  CASE WHEN surv > 0 THEN least(1.0::DOUBLE, surv * exp({Z}::DOUBLE * sqrt(greenwood))) END AS upper FROM km)"""
)


def ipd(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    return e.select(F.concat(F.lit("fig"), F.col("user_id") % 4).alias("image_id"), F.col("event_type").alias("series"), F.col("value").alias("time"), F.when(F.col("event_id") % 3 != 0, 1).otherwise(0).alias("status"))


def legend(spark: SparkSession, d: str) -> DataFrame:
    """Per figure the five series and one that does not occur; `click` is the reference."""
    rows = [(i + 1, s, c, s == "click") for i, (s, c) in enumerate([("view", "#dc3030"), ("click", "#3030a0"), ("error", "#30a030"), ("purchase", "#a0a030"), ("signup", "#30a0a0"), ("none", "#101010")])]
    named = spark.createDataFrame(rows, "ord int, series string, color string, reference boolean")
    return ipd(spark, d).select("image_id").distinct().crossJoin(F.broadcast(named))


LEGEND = """legend AS (SELECT * FROM (SELECT DISTINCT image_id FROM ipd) CROSS JOIN
  (VALUES (1, 'view'), (2, 'click'), (3, 'error'), (4, 'purchase'), (5, 'signup'), (6, 'none')) v(ord, series))"""


@query(f"WITH {KM} SELECT image_id, series, time, n_event, n_censor, n_risk, round(surv, 6) AS surv, round(greenwood, 6) AS greenwood FROM km")
def km_table(spark, d):
    return rounded(km.fit(ipd(spark, d)))


@query(f"WITH {LIMITS} SELECT image_id, series, time, round(surv, 6) AS surv, round(lower, 6) AS lower, round(upper, 6) AS upper FROM lim")
def km_ci(spark, d):
    return rounded(km.with_limits(km.fit(ipd(spark, d))).select("image_id", "series", "time", "surv", "lower", "upper"))


def _quantile_sql(ps: str, incidence: bool = False) -> str:
    one = lambda c, name: f"""CASE WHEN max(CASE WHEN abs({c} - p) <= 1.5e-8 THEN 1 ELSE 0 END) = 1 AND min(CASE WHEN {c} < p - 1.5e-8 THEN time END) IS NOT NULL
  THEN (min(CASE WHEN {c} <= p + 1.5e-8 THEN time END) + min(CASE WHEN {c} < p - 1.5e-8 THEN time END)) / 2
  ELSE min(CASE WHEN {c} <= p + 1.5e-8 THEN time END) END AS {name}"""  # noqa: E731
    p = "1 - q" if incidence else "q"
    return f"""WITH {LIMITS}, ps AS (SELECT ({p})::DOUBLE AS p FROM (VALUES {ps}) v(q)), qs AS (SELECT image_id, series, p, {one("surv", "t")}, {one("lower", "tl")}, {one("upper", "tu")} FROM lim CROSS JOIN ps GROUP BY image_id, series, p)
SELECT image_id, series, round(p, 6) AS survival, round(1 - p, 6) AS incidence, round(t, 6) AS time, round(tl, 6) AS time_lower, round(tu, 6) AS time_upper FROM qs"""


@query(_quantile_sql("(0.9), (0.75), (0.5), (0.25)"))
def km_quantiles(spark, d):
    return rounded(km.quantiles(ipd(spark, d), [0.25, 0.5, 0.75, 0.9]))


@query(_quantile_sql("(0.1), (0.4)", True))
def km_quantiles_incidence(spark, d):
    return rounded(km.incidence_quantiles(ipd(spark, d), [0.1, 0.4]))


@query(
    f"""WITH {LIMITS}, ts AS (SELECT t::DOUBLE AS t FROM (VALUES (0.001), (3), (22), (100), (1000)) v(t)),
last AS (SELECT image_id, series, t, max(CASE WHEN time <= t THEN time END) AS lt FROM lim CROSS JOIN ts GROUP BY ALL),
p AS (SELECT l.image_id, l.series, t, CASE WHEN lt IS NULL THEN 1 ELSE surv END AS s, CASE WHEN lt IS NULL THEN 1 ELSE lower END AS lo, CASE WHEN lt IS NULL THEN 1 ELSE upper END AS up
  FROM last l LEFT JOIN lim k ON l.image_id = k.image_id AND l.series = k.series AND l.lt = k.time)
SELECT image_id, series, round(t, 6) AS time, round(s, 6) AS survival, round(lo, 6) AS survival_lower, round(up, 6) AS survival_upper, round(1 - s, 6) AS incidence, round(1 - lo, 6) AS incidence_lower, round(1 - up, 6) AS incidence_upper FROM p"""
)
def km_probabilities(spark, d):
    return rounded(km.probabilities(ipd(spark, d), [0.001, 3, 22, 100, 1000]))


@query(
    f"""WITH {IPD}, {LEGEND}, each AS (SELECT l.image_id, l.ord, l.series, count(i.time) AS patients, coalesce(sum(i.status), 0) AS events FROM legend l LEFT JOIN ipd i ON l.image_id = i.image_id AND l.series = i.series GROUP BY ALL)
SELECT image_id, ord::INT AS ord, series, patients::BIGINT AS patients, events::BIGINT AS events FROM each
UNION ALL SELECT image_id, (max(ord) + 1)::INT, 'total', sum(patients)::BIGINT, sum(events)::BIGINT FROM each GROUP BY image_id"""
)
def ipd_counts_total(spark, d):
    return km.counts(ipd(spark, d), legend(spark, d))


@query(f"WITH {IPD} SELECT image_id, round(quantile_cont(time, 0.5), 1) AS q50, round(quantile_cont(time, 0.75), 1) AS q75 FROM ipd GROUP BY image_id")
def example_times(spark, d):
    return km.example_times(ipd(spark, d))


def risk_of(spark: SparkSession, d: str) -> DataFrame:
    return km.numbers_at_risk(ipd(spark, d), RISK_TIMES).select("image_id", "series", "x", F.col("patients").cast("int").alias("patients"))


RISK = IPD + ", risk AS (SELECT image_id, series, t::DOUBLE AS x, count(CASE WHEN time >= t THEN 1 END)::INT AS patients FROM ipd CROSS JOIN (VALUES (0), (50), (100), (150), (200)) v(t) GROUP BY ALL)"


@query(f"WITH {RISK} SELECT * FROM risk")
def risk_long(spark, d):
    return risk_of(spark, d)


@query(f"WITH {RISK} SELECT image_id, x, " + ", ".join(f"max(CASE WHEN series = '{s}' THEN patients END) AS {s}" for s in ("view", "click", "error", "purchase", "signup")) + " FROM risk GROUP BY image_id, x")
def risk_wide(spark, d):
    return tables.wide(risk_of(spark, d), ["view", "click", "error", "purchase", "signup"])


@query(f"WITH {RISK} SELECT image_id, series, " + ", ".join(f'max(CASE WHEN x = {t} THEN patients END) AS "{t}"' for t in (0, 50, 100, 150, 200)) + " FROM risk GROUP BY image_id, series")
def risk_transposed(spark, d):
    return tables.transposed(risk_of(spark, d), RISK_TIMES)


@query(
    f"""WITH {RISK}, bad AS (SELECT image_id, series, x, CASE WHEN x = 150 AND series = 'view' THEN patients + 10000 ELSE patients END AS patients FROM risk),
b AS (SELECT *, lag(patients) OVER (PARTITION BY image_id, series ORDER BY x) AS before FROM bad) SELECT image_id, series, x, patients::INT AS patients, before::INT AS before FROM b WHERE patients > before"""
)
def risk_validate(spark, d):
    wrong = F.when((F.col("x") == 150) & (F.col("series") == "view"), F.col("patients") + 10000).otherwise(F.col("patients"))
    return validate.rising(risk_of(spark, d).withColumn("patients", wrong)).select("image_id", "series", "x", "patients", "before")


@query(
    f"""WITH {RISK}, ev AS (SELECT image_id, series, (sum(status) * CASE WHEN series = 'click' THEN 5 ELSE 1 END)::BIGINT AS events FROM ipd GROUP BY image_id, series),
f AS (SELECT image_id, series, max(patients) AS randomized, min(x) AS start FROM risk GROUP BY ALL)
SELECT ev.image_id, ev.series, events, randomized, start FROM ev JOIN f ON ev.image_id = f.image_id AND ev.series = f.series WHERE start = 0 AND events > randomized"""
)
def events_validate(spark, d):
    totals = ipd(spark, d).groupBy("image_id", "series").agg((F.sum("status") * F.max(F.when(F.col("series") == "click", 5).otherwise(1))).alias("events"))
    return validate.excess_events(risk_of(spark, d), totals)


@query(f"WITH {IPD}, {LEGEND} SELECT l.image_id, l.series FROM legend l WHERE NOT EXISTS (SELECT 1 FROM ipd i WHERE i.image_id = l.image_id AND i.series = l.series)")
def unknown_series(spark, d):
    return validate.unknown(legend(spark, d).select("image_id", "series"), ipd(spark, d), ["image_id", "series"])


@query(f"WITH {IPD}, {LEGEND} SELECT l.image_id, l.series FROM legend l WHERE EXISTS (SELECT 1 FROM ipd i WHERE i.image_id = l.image_id AND i.series = l.series)")
def shared_series(spark, d):
    return validate.shared(legend(spark, d).select("image_id", "series"), ipd(spark, d), ["image_id", "series"])


@query(f"WITH {IPD} SELECT image_id, series, time, count(*) AS n FROM ipd GROUP BY ALL HAVING count(*) > 1")
def repeated_times(spark, d):
    return validate.repeated(ipd(spark, d), ["image_id", "series", "time"])


COX = (
    IPD
    + """, tab AS (SELECT image_id, series, time, count(*) AS n, sum(status) AS d FROM ipd GROUP BY ALL), ts AS (SELECT DISTINCT image_id, time FROM tab WHERE d > 0),
grid AS (SELECT ts.image_id, ts.time, s.series FROM ts JOIN (SELECT DISTINCT image_id, series FROM ipd) s ON ts.image_id = s.image_id),
full_grid AS (SELECT image_id, series, time, sum(n) AS n, sum(d) AS d FROM (SELECT image_id, series, time, n, d FROM tab UNION ALL SELECT image_id, series, time, 0, 0 FROM grid) GROUP BY ALL),
atr AS (SELECT *, sum(n) OVER (PARTITION BY image_id, series ORDER BY time DESC ROWS UNBOUNDED PRECEDING) AS n_risk FROM full_grid),
sets AS (SELECT atr.image_id, atr.time, atr.series, n_risk::BIGINT AS n_risk, d::BIGINT AS n_event FROM atr JOIN ts ON atr.image_id = ts.image_id AND atr.time = ts.time)"""
)


@query(f"WITH {COX} SELECT * FROM sets")
def cox_risk_sets(spark, d):
    return cox.risk_sets(ipd(spark, d))


@query(f"WITH {COX}, tot AS (SELECT image_id, time, sum(n_risk) AS n, sum(n_event) AS d FROM sets GROUP BY ALL) SELECT s.image_id, s.series, sum(n_event)::BIGINT AS observed, round(sum(d * n_risk::DOUBLE / n), 6) AS expected FROM sets s JOIN tot t ON s.image_id = t.image_id AND s.time = t.time GROUP BY s.image_id, s.series")
def cox_score(spark, d):
    return rounded(cox.score_at_zero(ipd(spark, d)))


@query()
def hazard_ratios(spark, d):
    return cox.hazard_ratios(ipd(spark, d), legend(spark, d))


ARMS = """ipd AS (SELECT 'fig' || (user_id % 4) AS image_id, CASE WHEN event_type IN ('view', 'error', 'signup') THEN 'a' ELSE 'b' END AS series, value AS time, CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS status FROM events)"""
NEWTON = f"""WITH RECURSIVE {COX.replace(IPD, ARMS)}, w AS (SELECT image_id, time, max(CASE WHEN series = 'a' THEN n_risk END)::DOUBLE AS n0, max(CASE WHEN series = 'b' THEN n_risk END)::DOUBLE AS n1, max(CASE WHEN series = 'a' THEN n_event END)::DOUBLE AS d0, max(CASE WHEN series = 'b' THEN n_event END)::DOUBLE AS d1 FROM sets GROUP BY ALL),
terms AS (SELECT image_id, n0 - l / (d0 + d1) * d0 AS a, n1 - l / (d0 + d1) * d1 AS b FROM (SELECT *, unnest(range(0, (d0 + d1)::BIGINT)) AS l FROM w)), seen AS (SELECT image_id, sum(d1) AS d FROM w GROUP BY image_id),
go AS (SELECT image_id, 0 AS k, 0.0::DOUBLE AS beta FROM seen
  UNION ALL SELECT g.image_id, g.k + 1, g.beta + (any_value(d) - sum(b * exp(beta) / (a + b * exp(beta)))) / sum(b * exp(beta) / (a + b * exp(beta)) * (1 - b * exp(beta) / (a + b * exp(beta)))) FROM go g JOIN terms t ON g.image_id = t.image_id JOIN seen s ON s.image_id = g.image_id WHERE g.k < 12 GROUP BY g.image_id, g.k, g.beta),
fin AS (SELECT g.image_id, beta, 1 / sqrt(sum(b * exp(beta) / (a + b * exp(beta)) * (1 - b * exp(beta) / (a + b * exp(beta))))) AS se FROM go g JOIN terms t ON g.image_id = t.image_id WHERE k = 12 GROUP BY g.image_id, beta)
SELECT image_id, 'b' AS series, round(exp(beta), 6) AS estimate, round(exp(beta - {Z}::DOUBLE * se), 6) AS lower, round(exp(beta + {Z}::DOUBLE * se), 6) AS upper FROM fin"""


@query(NEWTON)
def hazard_ratio_arms(spark, d):
    """All patients in two arms; the SQL takes twelve Newton steps."""
    arms = ipd(spark, d).withColumn("series", F.when(F.col("series").isin("view", "error", "signup"), "a").otherwise("b"))
    named = arms.select("image_id").distinct().crossJoin(F.broadcast(spark.createDataFrame([(1, "a", "#dc3030", True), (2, "b", "#3030a0", False)], "ord int, series string, color string, reference boolean")))
    return rounded(cox.hazard_ratios(arms, named).drop("p_value"))


@query(f"WITH {RISK}, {LEGEND} SELECT r.image_id, l.ord::INT AS ord, patients::INT AS patients, r.series, x FROM risk r JOIN legend l ON r.image_id = l.image_id AND r.series = l.series")
def risk_rows(spark, d):
    """The risk table of a spec whose lists are in no order."""
    lists = risk_of(spark, d).groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("series", "x").alias("h"), "series", "x", "patients"))).alias("r"))
    inputs = lists.select("image_id", F.col("r.patients").alias("risk_patients"), F.col("r.series").alias("risk_series"), F.col("r.x").alias("risk_x"))
    return validate.risk_table(inputs, legend(spark, d).filter("series <> 'none'"))


def scaled_of(spark: SparkSession, d: str) -> DataFrame:
    fitted = km.fit(ipd(spark, d))
    start = ipd(spark, d).select("image_id", "series", F.lit(0.0).alias("x"), F.lit(1.0).alias("y")).distinct()
    return start.unionByName(fitted.select("image_id", "series", F.col("time").alias("x"), F.col("surv").alias("y")))


@query()
def guyot_ipd(spark, d):
    """Patients rebuilt from the fitted curve and the numbers at risk."""
    risk = risk_of(spark, d).withColumn("ord", F.lit(1))
    return guyot.survival(scaled_of(spark, d), risk)


@query(f"WITH {RISK} SELECT image_id, series, max(patients)::BIGINT AS patients FROM risk GROUP BY image_id, series")
def guyot_counts(spark, d):
    """As many patients are rebuilt as are at risk first."""
    return guyot_ipd(spark, d).groupBy("image_id", "series").agg(F.count(F.lit(1)).alias("patients"))


# --- scaling --------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag AS image_id, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, count(*) AS n FROM lineitem GROUP BY 1")
def scale_fit(spark, d):
    points = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("image_id"), F.col("l_quantity").alias("pixel"), F.col("l_extendedprice").alias("value"))
    found = scale.calibration(points, ["image_id"])
    return found.select("image_id", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), "n")


CURVE = "SELECT l_returnflag AS image_id, l_linestatus AS series, l_quantity - 5 AS x, CASE WHEN l_returnflag = 'R' THEN 100 * l_tax ELSE l_tax + l_quantity / 100 END AS y FROM lineitem"
HOW = f"""pts AS ({CURVE}), how AS (SELECT image_id, CASE WHEN max(y) > 1.5 THEN 100.0::DOUBLE ELSE 1.0::DOUBLE END AS max_y,
  coalesce(regr_slope(y, x) * (max(x) - min(x)) > 1.4901161193847656e-8 * greatest(1.0, max(abs(y))), false) AS increasing FROM pts GROUP BY image_id)"""


def curve_points(spark: SparkSession, d: str) -> DataFrame:
    y = F.when(F.col("l_returnflag") == "R", 100 * F.col("l_tax")).otherwise(F.col("l_tax") + F.col("l_quantity") / 100)
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("image_id"), F.col("l_linestatus").alias("series"), (F.col("l_quantity") - 5).alias("x"), y.alias("y"))


@query(f"WITH {HOW} SELECT * FROM how")
def scale_direction(spark, d):
    return scale.direction(curve_points(spark, d), ["image_id"])


@query(
    f"""WITH {HOW}, s AS (SELECT p.image_id, series, x, CASE WHEN increasing THEN 1 - y / max_y ELSE y / max_y END AS y, max_y, increasing FROM pts p JOIN how h ON p.image_id = h.image_id)
SELECT image_id, series, x, round(y, 6) AS y, max_y, increasing FROM s WHERE x >= 0 UNION ALL SELECT DISTINCT image_id, series, 0.0::DOUBLE, 1.0::DOUBLE, max_y, increasing FROM s"""
)
def scale_curve(spark, d):
    return rounded(scale.canonical(curve_points(spark, d)))


# --- colours and text -----------------------------------------------------------------------------------------

HEX = "'#' || lower(lpad(to_hex((p_partkey * 7919 + 12345) % 16777216), 6, '0'))"
CH = lambda i: f"(((p_partkey * 7919 + 12345) % 16777216) >> {16 - 8 * i}) & 255"


def part_colors(spark: SparkSession, d: str) -> DataFrame:
    code = F.lpad(F.hex((F.col("p_partkey") * 7919 + 12345) % 16777216), 6, "0")
    return read(spark, d, "part").select("p_partkey", F.concat(F.lit("#"), code).alias("color"))


@query(f"SELECT p_partkey, {HEX} AS rgb, {HEX} || 'ff' AS rgba, round((({CH(0)}) + ({CH(1)}) + ({CH(2)})) / 3.0::DOUBLE, 6) AS brightness, CASE WHEN 255 - (({CH(0)}) + ({CH(1)}) + ({CH(2)})) / 3.0::DOUBLE > (({CH(0)}) + ({CH(1)}) + ({CH(2)})) / 3.0::DOUBLE THEN '#ffffff' ELSE '#000000' END AS ruler FROM part")
def color_format(spark, d):
    c = F.col("color")
    return part_colors(spark, d).select("p_partkey", colors.rgb(c).alias("rgb"), colors.rgba(c).alias("rgba"), F.round(colors.brightness(c), 6).alias("brightness"), colors.ruler(c).alias("ruler"))


@query("SELECT p_partkey, regexp_full_match('#' || p_name, '#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})') AS name_valid, regexp_full_match('#' || lpad(to_hex(p_partkey), 6, '0'), '#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})') AS hex_valid FROM part")
def color_valid(spark, d):
    p = read(spark, d, "part")
    return p.select("p_partkey", colors.valid(F.concat(F.lit("#"), "p_name")).alias("name_valid"), colors.valid(F.concat(F.lit("#"), F.lpad(F.hex("p_partkey"), 6, "0"))).alias("hex_valid"))


PALETTE = ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(colors.NAMED.items()))


@query(f"""WITH c AS (SELECT p_partkey, {CH(0)} AS r, {CH(1)} AS g, {CH(2)} AS b FROM part), pal(ord, name, pr, pg, pb) AS (VALUES {PALETTE}),
n AS (SELECT p_partkey, name, row_number() OVER (PARTITION BY p_partkey ORDER BY (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), ord) AS k FROM c CROSS JOIN pal) SELECT p_partkey, name FROM n WHERE k = 1""")
def color_nearest(spark, d):
    named = [(n, colors.hex_of(v)) for n, v in colors.NAMED.items()]
    return colors.nearest(part_colors(spark, d), "color", named, "name").select("p_partkey", "name")


def _gray(r: str, g: str, b: str) -> str:
    return f"round_even(0.2126::DOUBLE * ({r}) + 0.7152::DOUBLE * ({g}) + 0.0722::DOUBLE * ({b}), 0)::INT"


@query(f"SELECT p_partkey, {_gray(CH(0), CH(1), CH(2))} AS gray FROM part")
def color_luma(spark, d):
    return part_colors(spark, d).select("p_partkey", colors.luma(F.col("color")).alias("gray"))


@query(f"SELECT p_partkey, (round_even((p_size / 50.0::DOUBLE) * ({CH(0)}) + (1 - p_size / 50.0::DOUBLE) * 255, 0))::INT AS red FROM part WHERE p_size <= 50")
def flatten_alpha(spark, d):
    p = part_colors(spark, d).join(read(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").filter("p_size <= 50")
    return p.select("p_partkey", colors.flatten(colors.channel(F.col("color"), 0), F.col("p_size") / 50.0).alias("red"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || '  ' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slug(spark, d):
    return read(spark, d, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit("  "), "p_type", F.lit("!"))).alias("slug"))


@query("WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[0-9]*\\.?[0-9]+') GROUP BY word")
def numeric_word(spark, d):
    words = read(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return words.filter(text.positive_number(F.col("word"))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT url, lower(regexp_extract(url, '\\.([^./]+)$', 1)) AS extension FROM pages")
def file_extension(spark, d):
    return read(spark, d, "pages").select("url", text.extension(F.col("url")).alias("extension"))


@query("SELECT l_orderkey, l_linenumber, round_even((l_partkey + 1) / 4.0::DOUBLE, 0)::INT AS x1, round_even((l_suppkey + 1) / 4.0::DOUBLE, 0)::INT AS y1, round_even((l_partkey + l_linenumber + 1) / 4.0::DOUBLE, 0)::INT AS x2, round_even((l_suppkey + l_linenumber + 1) / 4.0::DOUBLE, 0)::INT AS y2 FROM lineitem")
def bbox_parse(spark, d):
    box = F.concat_ws(",", F.col("l_partkey"), F.col("l_suppkey"), F.col("l_partkey") + F.col("l_linenumber"), F.col("l_suppkey") + F.col("l_linenumber"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("box"))
    return rows.select("l_orderkey", "l_linenumber", *[c.alias(n) for c, n in zip(text.box(F.col("box"), 4), ("x1", "y1", "x2", "y2"), strict=True)])


A = f"'{text.ALPHABET}'"


@query(f"""WITH n AS (SELECT p_partkey, p_partkey + 1 AS n FROM part), d AS (SELECT *, (n - 1) // 25 AS a, (n - 1) % 25 AS l1 FROM n), e AS (SELECT *, (a - 1) // 25 AS b, (a - 1) % 25 AS l2 FROM d), f AS (SELECT *, (b - 1) // 25 AS c, (b - 1) % 25 AS l3 FROM e)
SELECT p_partkey, (CASE WHEN b > 0 AND c > 0 THEN substr({A}, (c - 1) % 25 + 1, 1) ELSE '' END) || (CASE WHEN a > 0 AND b > 0 THEN substr({A}, l3 + 1, 1) ELSE '' END) || (CASE WHEN a > 0 THEN substr({A}, l2 + 1, 1) ELSE '' END) || substr({A}, l1 + 1, 1) AS label FROM f""")
def letters(spark, d):
    return read(spark, d, "part").select("p_partkey", text.letters(F.col("p_partkey") + 1).alias("label"))


# --- boxes ----------------------------------------------------------------------------------------------------

BOXES = """boxes AS (SELECT 's' || l_suppkey AS image_id, l_orderkey * 8 + l_linenumber AS box, x1::INT AS x1, (x1 + 10 + l_quantity)::INT AS x2, y1::INT AS y1, (y1 + 8 + l_linenumber)::INT AS y2
  FROM (SELECT *, 1 + (l_orderkey * 37 + l_linenumber * 101) % 4000 AS x1, 1 + (l_partkey * 53 + l_orderkey) % 3000 AS y1 FROM lineitem))"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "lineitem").withColumn("x1", (1 + (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101) % 4000).cast("int")).withColumn("y1", (1 + (F.col("l_partkey") * 53 + F.col("l_orderkey")) % 3000).cast("int"))
    return l.select(F.concat(F.lit("s"), "l_suppkey").alias("image_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("box"), "x1", (F.col("x1") + 10 + F.col("l_quantity")).cast("int").alias("x2"), "y1", (F.col("y1") + 8 + F.col("l_linenumber")).cast("int").alias("y2"))


@query(f"WITH {BOXES} SELECT a.image_id, a.box AS a, b.box AS b FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box < b.box AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1")
def overlap_pairs(spark, d):
    return ocr.overlaps(boxes(spark, d))


@query(
    f"""WITH {BOXES}, t AS (SELECT image_id, greatest(1.0, median(y2 - y1 + 1) / 2) AS tol FROM boxes GROUP BY image_id),
f AS (SELECT b.*, CASE WHEN y1 - lag(y1) OVER (PARTITION BY b.image_id ORDER BY y1, x1) > tol THEN 1 ELSE 0 END AS new FROM boxes b JOIN t ON b.image_id = t.image_id),
r AS (SELECT *, sum(new) OVER (PARTITION BY image_id ORDER BY y1, x1 ROWS UNBOUNDED PRECEDING) + 1 AS row_id FROM f)
SELECT image_id, x1, y1, row_id::BIGINT AS row_id, row_number() OVER (PARTITION BY image_id ORDER BY row_id, x1, y1)::INT AS ord FROM r"""
)
def reading_order(spark, d):
    return ocr.reading_order(boxes(spark, d)).select("image_id", "x1", "y1", "row_id", "ord")


def findings_of(spark: SparkSession, d: str) -> DataFrame:
    l = boxes(spark, d)
    return l.select("image_id", (F.col("box") % 3).cast("int").alias("mode"), (F.col("box") % 1000003).cast("int").alias("ord"), (F.col("box") % 97).cast("string").alias("word"), (F.lit(40.0) + F.col("box") % 61).alias("confidence"), "x1", "x2", "y1", "y2", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))


# greedy in rounds: a finding stays when all overlapping ones before it are known to go, and goes when one of them stays; the
# rounds are more than the longest chain of overlaps
_ROUNDS = ", ".join(
    f"""keep{r} AS MATERIALIZED (SELECT image_id, k FROM n WHERE NOT EXISTS (SELECT 1 FROM e LEFT JOIN gone{r - 1} g ON g.image_id = e.image_id AND g.k = e.a WHERE e.image_id = n.image_id AND e.b = n.k AND g.k IS NULL)),
gone{r} AS MATERIALIZED (SELECT DISTINCT e.image_id, e.b AS k FROM e JOIN keep{r} s ON s.image_id = e.image_id AND s.k = e.a)"""
    for r in range(1, 13)
)
POOL = f"""WITH {BOXES}, f AS (SELECT image_id, (box % 3)::INT AS mode, (box % 1000003)::INT AS ord, (box % 97)::VARCHAR AS word, (40.0::DOUBLE + box % 61) AS confidence, x1, x2, y1, y2, (x1 + x2) / 2.0::DOUBLE AS x, (y1 + y2) / 2.0::DOUBLE AS y FROM boxes),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, mode, ord, x1, y1, x2, y2) AS k FROM f),
e AS MATERIALIZED (SELECT a.image_id, a.k AS a, b.k AS b FROM n a JOIN n b ON a.image_id = b.image_id AND a.k < b.k AND a.x1 < b.x2 AND a.x2 > b.x1 AND a.y1 < b.y2 AND a.y2 > b.y1),
gone0 AS (SELECT image_id, k FROM n WHERE false), {_ROUNDS}
SELECT n.image_id, mode, ord, word, confidence, x1, x2, y1, y2, x, y FROM n JOIN keep12 s ON n.image_id = s.image_id AND n.k = s.k"""


@query(
    """WITH raw AS (SELECT 's' || l_suppkey AS image_id, (l_linenumber % 3)::INT AS mode, l_orderkey::INT AS ord, CASE WHEN l_linenumber % 3 = 0 THEN '-' || (l_partkey % 100) ELSE (l_partkey % 1000) || CASE WHEN l_orderkey % 5 = 0 THEN 'x' ELSE '' END END AS word, (l_partkey % 100)::DOUBLE AS confidence,
  round_even((l_partkey + 1) / 4.0::DOUBLE, 0)::INT AS x1, round_even((l_partkey + l_linenumber + 1) / 4.0::DOUBLE, 0)::INT AS x2, round_even((l_suppkey + 1) / 4.0::DOUBLE, 0)::INT AS y1, round_even((l_suppkey + l_linenumber + 1) / 4.0::DOUBLE, 0)::INT AS y2 FROM lineitem)
SELECT image_id, mode, ord, replace(word, '-', '') AS word, confidence, x1, x2, y1, y2, (x1 + x2) / 2.0::DOUBLE AS x, (y1 + y2) / 2.0::DOUBLE AS y FROM raw WHERE confidence >= 60 AND regexp_full_match(replace(word, '-', ''), '[0-9]*\\.?[0-9]+')"""
)
def findings(spark, d):
    """Raw words as findings: confident numbers without hyphens, boxes scaled back, with centroids."""
    l = read(spark, d, "lineitem")
    word = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("-"), F.col("l_partkey") % 100)).otherwise(F.concat(F.col("l_partkey") % 1000, F.when(F.col("l_orderkey") % 5 == 0, "x").otherwise("")))
    box = F.concat_ws(",", F.col("l_partkey"), F.col("l_suppkey"), F.col("l_partkey") + F.col("l_linenumber"), F.col("l_suppkey") + F.col("l_linenumber"))
    raw = l.select(F.concat(F.lit("s"), "l_suppkey").alias("image_id"), (F.col("l_linenumber") % 3).cast("int").alias("mode"), F.col("l_orderkey").cast("int").alias("ord"), word.alias("word"), (F.col("l_partkey") % 100).cast("double").alias("confidence"), box.alias("bbox"))
    return ocr.findings(raw, confidence=60)


@query(POOL)
def pool_findings(spark, d):
    """Greedy: a finding goes when a kept one before it overlaps it."""
    return ocr.pool(findings_of(spark, d))


@query(
    f"""WITH {BOXES}, m AS (SELECT image_id, greatest(2.0::DOUBLE, median(y2 - y1 + 1) * 0.15::DOUBLE) AS border FROM boxes GROUP BY image_id),
g AS (SELECT b.image_id, 'A' || (box % 7) AS label, border, x1 - (ceil(border / 2) + 1) AS bx1, x2 + ceil(border / 2) + 1 AS bx2, y1 - (ceil(border / 2) + 1) AS by1, y2 + ceil(border / 2) + 1 AS by2 FROM boxes b JOIN m ON b.image_id = m.image_id),
h AS (SELECT *, by2 - by1 AS hh, (by2 - by1) * 2 * 0.7::DOUBLE + 4 AS ww FROM g)
SELECT image_id, label, round(border, 6) AS border, bx1::DOUBLE AS box_x1, bx2::DOUBLE AS box_x2, by1::DOUBLE AS box_y1, by2::DOUBLE AS box_y2, hh::DOUBLE AS badge_height, round(ww, 6) AS badge_width,
  round(CASE WHEN bx1 - 2 - ww < 0 THEN bx2 + 2 ELSE bx1 - 2 - ww END, 6) AS badge_x1, round(CASE WHEN bx1 - 2 - ww < 0 THEN bx2 + 2 ELSE bx1 - 2 - ww END + ww, 6) AS badge_x2 FROM h"""
)
def label_boxes(spark, d):
    return rounded(render.label_boxes(boxes(spark, d).withColumn("label", F.concat(F.lit("A"), F.col("box") % 7))))


TICKS = """tick AS (SELECT 's' || s_suppkey AS image_id, 'T' || k AS label, (s_suppkey % 50 + k * 10)::DOUBLE AS value, k AS k FROM supplier CROSS JOIN (VALUES (0), (1)) v(k)),
lab AS (SELECT 's' || s_suppkey AS image_id, 'T' || k AS label, (s_nationkey * 3 + k * 40)::INT AS x1, (s_nationkey * 3 + k * 40 + 10)::INT AS x2, (100 + (s_suppkey * k) % 9)::INT AS y1, (110 + (s_suppkey * k) % 9)::INT AS y2 FROM supplier CROSS JOIN (VALUES (0), (1), (2)) v(k)),
axis AS (SELECT t.image_id, t.label, value, (x1 + x2) / 2.0::DOUBLE AS x, (y1 + y2) / 2.0::DOUBLE AS y, x1, x2, y1, y2 FROM tick t LEFT JOIN lab l ON t.image_id = l.image_id AND t.label = l.label)"""


def tick_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = read(spark, d, "supplier")
    named = s.select(F.concat(F.lit("s"), "s_suppkey").alias("image_id"), "s_suppkey", "s_nationkey")
    ticks = named.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select("image_id", F.concat(F.lit("T"), "k").alias("label"), (F.col("s_suppkey") % 50 + F.col("k") * 10).cast("double").alias("value"))
    label = named.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("x1", (F.col("s_nationkey") * 3 + F.col("k") * 40).cast("int")).withColumn("y1", (100 + (F.col("s_suppkey") * F.col("k")) % 9).cast("int"))
    label = label.select("image_id", F.concat(F.lit("T"), "k").alias("label"), ((F.col("x1") * 2 + 10) / 2).alias("x"), ((F.col("y1") * 2 + 10) / 2).alias("y"), "x1", (F.col("x1") + 10).alias("x2"), "y1", (F.col("y1") + 10).alias("y2"))
    return ticks, label


@query(f"WITH {TICKS} SELECT * FROM axis")
def axis_resolve(spark, d):
    return calibrate.resolve(*tick_tables(spark, d))


@query(f"WITH {TICKS} SELECT a.image_id, a.label AS first, b.label AS second FROM axis a JOIN axis b ON a.image_id = b.image_id AND a.value < b.value WHERE NOT (a.y BETWEEN b.y1 AND b.y2 AND b.y BETWEEN a.y1 AND a.y2)")
def axis_misaligned(spark, d):
    return calibrate.misaligned(calibrate.resolve(*tick_tables(spark, d)), "y")


@query(f"WITH {TICKS} SELECT image_id, median(y2 - y1)::DOUBLE AS median_height, max(x2)::INT AS y_axis_column, min(y1)::INT AS x_axis_row, greatest(1, ceil(4 * median(y2 - y1)))::INT AS band FROM axis GROUP BY image_id")
def panel_band(spark, d):
    axis = calibrate.resolve(*tick_tables(spark, d))
    return calibrate.band(axis, axis)


# --- pixels ---------------------------------------------------------------------------------------------------

PIX = """pix AS (SELECT 'img' || (vec_id // 50) AS image_id, i::INT AS x, (vec_id % 50 + 1)::INT AS y, CASE WHEN embedding[i]::DOUBLE > 0.1::DOUBLE THEN '#dc3030' WHEN embedding[i]::DOUBLE < -0.1::DOUBLE THEN '#3030a0' ELSE '#ffffff' END AS color
  FROM embeddings CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS i))"""
FG = PIX + ", n AS (SELECT image_id, color, count(*) AS n FROM pix GROUP BY ALL), bg AS (SELECT image_id, color AS background FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, color) AS k FROM n) WHERE k = 1), fg AS (SELECT p.image_id, x, y, color FROM pix p JOIN bg ON p.image_id = bg.image_id WHERE color <> background)"


def pixel_table(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").select(F.concat(F.lit("img"), F.expr("vec_id div 50")).alias("image_id"), (F.col("vec_id") % 50 + 1).cast("int").alias("y"), F.posexplode("embedding").alias("i", "v"))
    v = F.col("v").cast("double")
    return e.select("image_id", (F.col("i") + 1).cast("int").alias("x"), "y", F.when(v > 0.1, "#dc3030").when(v < -0.1, "#3030a0").otherwise("#ffffff").alias("color"))


@query(f"WITH {PIX}, n AS (SELECT image_id, color, count(*) AS n FROM pix GROUP BY ALL), w(ord, color) AS (VALUES (0, '#3030a0'), (1, '#dc3030'), (2, '#123456')) SELECT i.image_id, w.ord::INT AS ord, w.color, coalesce(n.n, 0)::BIGINT AS n FROM (SELECT DISTINCT image_id FROM pix) i CROSS JOIN w LEFT JOIN n ON n.image_id = i.image_id AND n.color = w.color")
def color_count(spark, d):
    return colors.counts(pixel_table(spark, d), ["#3030A0", "#dc3030", "#123456"])


@query(f"WITH {FG} SELECT * FROM bg")
def background_color(spark, d):
    return colors.most_frequent(pixel_table(spark, d))


@query(f"WITH {FG} SELECT * FROM fg")
def foreground_pixels(spark, d):
    return pixels.foreground(pixel_table(spark, d))


@query(f"WITH {FG} SELECT p.image_id, x, y, CASE WHEN x BETWEEN 30 AND 40 AND y BETWEEN 5 AND 45 THEN background WHEN x BETWEEN 10 AND 50 AND y BETWEEN 10 AND 40 THEN color ELSE background END AS color FROM pix p JOIN bg ON p.image_id = bg.image_id")
def pixel_mask(spark, d):
    rects = spark.createDataFrame([(1, 10, 50, 10, 40, True), (2, 30, 40, 5, 45, False)], "ord int, x1 int, x2 int, y1 int, y2 int, keep boolean")
    p = pixel_table(spark, d)
    return pixels.mask(p, p.select("image_id").distinct().crossJoin(F.broadcast(rects)), initial=False)


@query(f"""WITH {PIX}, c AS (SELECT *, ('0x' || substr(color, 2, 2))::INT AS r, ('0x' || substr(color, 4, 2))::INT AS g, ('0x' || substr(color, 6, 2))::INT AS b FROM pix), pal(ord, name, pr, pg, pb) AS (VALUES (0, '#ffffff', 255, 255, 255), (1, '#ff0000', 255, 0, 0), (2, '#000080', 0, 0, 128)),
k AS (SELECT color, name, row_number() OVER (PARTITION BY color ORDER BY (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb), ord) AS k FROM (SELECT DISTINCT color, r, g, b FROM c) CROSS JOIN pal)
SELECT image_id, x, y, CASE WHEN name = '#000080' THEN '#ffffff' ELSE name END AS color FROM c JOIN k ON c.color = k.color WHERE k = 1""")
def classify_pixels(spark, d):
    return pixels.classify(pixel_table(spark, d), "#ffffff", ["#ff0000"], ["#000080"])


@query(f"WITH {FG} SELECT a.image_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM fg a JOIN fg b ON a.image_id = b.image_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))")
def pixel_edges(spark, d):
    return pixels.edges(pixels.foreground(pixel_table(spark, d)))


@query(f"WITH {FG}, g AS (SELECT *, CASE WHEN color = '#dc3030' THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS g FROM fg) SELECT a.image_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, round(1 / ((a.g + b.g) / 2), 6) AS cost FROM g a JOIN g b ON a.image_id = b.image_id AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))")
def edge_costs(spark, d):
    return rounded(pixels.edge_costs(pixels.foreground(pixel_table(spark, d)).withColumn("target", F.col("color") == "#dc3030")))


RUNS = FG + ", isl AS (SELECT *, y - row_number() OVER (PARTITION BY image_id, x ORDER BY y) AS island FROM fg), runs AS (SELECT image_id, x, min(y) AS y1, max(y) AS y2, count(*) AS length FROM isl GROUP BY image_id, x, island)"


@query(f"WITH {RUNS} SELECT image_id, x, y1, y2, length FROM runs")
def runs(spark, d):
    return pixels.runs(pixels.foreground(pixel_table(spark, d)))


@query(f"WITH {RUNS} SELECT image_id, x, max(length) AS length FROM runs GROUP BY image_id, x")
def max_run(spark, d):
    return pixels.longest_run(pixels.foreground(pixel_table(spark, d)))


@query(
    f"""WITH {RUNS}, m AS (SELECT image_id, x, max(length) AS l FROM runs GROUP BY ALL), best AS (SELECT image_id, max(l) AS l FROM m GROUP BY ALL),
c AS (SELECT m.image_id, round_even(avg(x), 0)::INT AS x, max(m.l) AS length FROM m JOIN best b ON m.image_id = b.image_id AND m.l = b.l GROUP BY m.image_id)
SELECT c.image_id, c.x, c.length, min(y)::INT AS y1, max(y)::INT AS y2 FROM c JOIN fg ON fg.image_id = c.image_id AND fg.x = c.x WHERE c.length >= 3 GROUP BY ALL"""
)
def find_line(spark, d):
    points = pixels.foreground(pixel_table(spark, d))
    return pixels.find_line(points, points.select("image_id", F.lit(3).alias("floor")).distinct())


@query(f"WITH {FG} SELECT image_id, y AS x, x AS y FROM fg")
def transpose_pixels(spark, d):
    return pixels.transpose(pixels.foreground(pixel_table(spark, d)).drop("color")).select("image_id", "x", "y")


# components come from a kernel; in SQL each ink pixel passes its number on to its neighbours until none is new. Of the
# images' three colours white is the most frequent one and the others are nearer to each other, so they are the ink.
def labelled(spark: SparkSession, d: str) -> DataFrame:
    return raster.components(rasters_of(spark, d))


LAB = FG + """, ink AS (SELECT image_id, x, y, color, ((x - 1) * 50 + y)::BIGINT AS own FROM fg),
nb AS (SELECT a.image_id, a.own AS u, b.own AS v FROM ink a JOIN ink b ON a.image_id = b.image_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1),
reach AS (SELECT image_id, own, own AS c FROM ink UNION SELECT r.image_id, nb.v, r.c FROM reach r JOIN nb ON nb.image_id = r.image_id AND nb.u = r.own AND r.c < nb.v),
low AS (SELECT image_id, own, min(c) AS component FROM reach GROUP BY ALL), lab AS (SELECT ink.image_id, x, y, color, component FROM ink JOIN low ON ink.image_id = low.image_id AND ink.own = low.own)"""


@query(f"WITH RECURSIVE {LAB} SELECT image_id, component, count(*) AS pixels, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2, (max(y) - min(y) + 1)::INT AS rows, (max(x) - min(x) + 1)::INT AS cols, round(sqrt(((max(y) - min(y) + 1) * (max(y) - min(y) + 1) + (max(x) - min(x) + 1) * (max(x) - min(x) + 1))::DOUBLE), 6) AS diagonal FROM lab GROUP BY ALL")
def component_bbox(spark, d):
    return rounded(pixels.spans(labelled(spark, d)))


@query(f"WITH RECURSIVE {LAB}, s AS (SELECT image_id, component FROM lab GROUP BY ALL HAVING sqrt(((max(y) - min(y) + 1) * (max(y) - min(y) + 1) + (max(x) - min(x) + 1) * (max(x) - min(x) + 1))::DOUBLE) >= 4) SELECT lab.image_id, lab.component, x, y, color FROM lab JOIN s ON lab.image_id = s.image_id AND lab.component = s.component")
def span_filter(spark, d):
    return pixels.long_components(labelled(spark, d), F.lit(4.0))


@query(f"WITH RECURSIVE {LAB} SELECT image_id, component FROM lab GROUP BY ALL HAVING max(y) - min(y) + 1 >= 5 OR max(x) - min(x) + 1 >= 7")
def oversized_components(spark, d):
    return pixels.oversized(labelled(spark, d), F.lit(5), F.lit(7)).select("image_id", "component")


@query(f"WITH RECURSIVE {LAB}, per AS (SELECT image_id, color, component, count(*) AS n FROM lab GROUP BY ALL) SELECT image_id, color, component FROM (SELECT *, row_number() OVER (PARTITION BY image_id, color ORDER BY n DESC, component) AS k FROM per) WHERE k = 1")
def owning_component(spark, d):
    return pixels.owning_component(labelled(spark, d))


@query(f"WITH {FG} SELECT DISTINCT image_id, (x + dx)::INT AS x, (y + dy)::INT AS y FROM (SELECT * FROM fg WHERE color = '#dc3030') CROSS JOIN (SELECT unnest(generate_series(-1, 1)) AS dx) CROSS JOIN (SELECT unnest(generate_series(-1, 1)) AS dy)")
def dilate(spark, d):
    return pixels.dilate(pixels.foreground(pixel_table(spark, d)).filter("color = '#dc3030'"), 1)


@query(f"WITH {PIX} SELECT image_id, x, y, color AS color_before, CASE WHEN y > 2 THEN '#000000' END AS color_after FROM pix WHERE y <= 2 OR (x > 32 AND color = '#dc3030')")
def pixel_difference(spark, d):
    p = pixel_table(spark, d)
    changed = p.filter("y > 2").withColumn("color", F.when((F.col("x") > 32) & (F.col("color") == "#dc3030"), "#000000").otherwise(F.col("color")))
    return pixels.difference(p, changed)


PATHS = FG + """, lm AS (SELECT image_id, color, min(x) AS px FROM fg WHERE x > 3 GROUP BY ALL), lmy AS (SELECT lm.*, (SELECT min(y) FROM fg WHERE fg.image_id = lm.image_id AND fg.color = lm.color AND fg.x = lm.px) AS py FROM lm),
st AS (SELECT image_id, color, px AS start_x, py AS start_y FROM lmy WHERE px <= 3 UNION ALL SELECT image_id, color, 3, fy FROM (SELECT l.image_id, l.color, f.y AS fy, row_number() OVER (PARTITION BY l.image_id, l.color ORDER BY abs(f.y - py), f.y) AS k FROM lmy l JOIN fg f ON f.image_id = l.image_id AND f.x = 3 WHERE px > 3) WHERE k = 1)"""


def path_starts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fg = pixels.foreground(pixel_table(spark, d))
    return fg, pixels.start_points(fg.filter("x > 3"), fg, fg.select("image_id", F.lit(3).alias("start_x")).distinct())


@query(f"WITH {PATHS} SELECT image_id, color, start_x::INT AS start_x, start_y::INT AS start_y FROM st")
def endpoints_start(spark, d):
    return path_starts(spark, d)[1]


@query(f"WITH {PATHS}, e AS (SELECT f.image_id, f.color, f.x, f.y, row_number() OVER (PARTITION BY f.image_id, f.color ORDER BY f.x DESC, abs(f.y - start_y) DESC, f.y) AS k FROM fg f JOIN st ON f.image_id = st.image_id AND f.color = st.color) SELECT image_id, color, x::INT AS end_x, y::INT AS end_y FROM e WHERE k = 1")
def endpoints_end(spark, d):
    return pixels.end_points(*path_starts(spark, d))


# --- rendering ------------------------------------------------------------------------------------------------


def how_of(spark: SparkSession, d: str) -> DataFrame:
    named = ipd(spark, d).select("image_id").distinct()
    return named.select("image_id", F.lit(100.0).alias("max_y"), (F.col("image_id") == "fig1").alias("increasing"), F.lit(120).alias("width"), F.lit(80).alias("height"), F.lit(3).alias("line_width"))


SHOWN = lambda s: f"CASE WHEN image_id = 'fig1' THEN 100 - 100 * ({s}) ELSE 100 * ({s}) END"
STEPS = KM + f""", j AS (SELECT *, lag(surv, 1, 1.0::DOUBLE) OVER (PARTITION BY image_id, series ORDER BY time) AS before FROM km),
v AS (SELECT image_id, series, time AS pos, 0 AS part, time AS x, before AS s FROM j WHERE n_event > 0 UNION ALL SELECT image_id, series, time, 1, time, surv FROM j WHERE n_event > 0
  UNION ALL SELECT DISTINCT image_id, series, -1e308::DOUBLE, 0, 0.0::DOUBLE, 1.0::DOUBLE FROM km UNION ALL SELECT image_id, series, 1e308::DOUBLE, 0, greatest(max(time), 0), min(surv) FROM km GROUP BY image_id, series),
steps AS (SELECT image_id, series, row_number() OVER (PARTITION BY image_id, series ORDER BY pos, part) AS ord, x, {SHOWN("s")} AS y FROM v)"""


@query(f"WITH {STEPS} SELECT image_id, series, ord::INT AS ord, round(x, 6) AS x, round(y, 6) AS y FROM steps")
def layer_steps(spark, d):
    return rounded(render.steps(ipd(spark, d), how_of(spark, d)))


@query(f"WITH {KM} SELECT image_id, series, round(time, 6) AS x, round({SHOWN('surv')}, 6) AS y FROM km WHERE n_censor > 0")
def censor_marks(spark, d):
    return rounded(render.censor_marks(ipd(spark, d), how_of(spark, d)))


SEG = """seg AS (SELECT 'o' || (l_suppkey % 7) AS image_id, 'l' || l_linenumber AS series, l_orderkey AS ord, (l_orderkey % 120 - 5)::INT AS x1, (l_partkey % 90 - 5)::INT AS y1, (l_orderkey % 120 + l_linenumber - 5)::INT AS x2, (CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 90 - 5 ELSE l_partkey % 90 + 1 END)::INT AS y2 FROM lineitem),
box AS (SELECT *, CASE WHEN y1 = y2 THEN greatest(1, least(x1, x2)) ELSE greatest(1, x1 - 1) END AS xa, CASE WHEN y1 = y2 THEN least(120, greatest(x1, x2)) ELSE least(120, x1 + 1) END AS xb,
  CASE WHEN y1 = y2 THEN greatest(1, y1 - 1) ELSE greatest(1, least(y1, y2)) END AS ya, CASE WHEN y1 = y2 THEN least(80, y1 + 1) ELSE least(80, greatest(y1, y2)) END AS yb FROM seg)"""


@query(f"WITH {SEG}, p AS (SELECT image_id, series, xa + i AS x, ya + j AS y FROM box CROSS JOIN (SELECT unnest(generate_series(0, 12)) AS i) CROSS JOIN (SELECT unnest(generate_series(0, 12)) AS j) WHERE xa + i <= xb AND ya + j <= yb) SELECT image_id, series, x::INT AS x, y::INT AS y, count(*) AS n FROM p GROUP BY ALL")
def segment_fill(spark, d):
    n, odd = F.col("l_linenumber"), F.col("l_linenumber") % 2 == 0
    l = read(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_suppkey") % 7).alias("image_id"), F.concat(F.lit("l"), n).alias("series"), (F.col("l_orderkey") % 120 - 5).cast("int").alias("x1"), (F.col("l_partkey") % 90 - 5).cast("int").alias("y1"), (F.col("l_orderkey") % 120 + n - 5).cast("int").alias("x2"), F.when(odd, F.col("l_partkey") % 90 - 5).otherwise(F.col("l_partkey") % 90 + 1).cast("int").alias("y2"))
    return render.fill(l, F.lit(1), F.lit(120), F.lit(80)).groupBy("image_id", "series", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def _axes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Ticks 0 and 500 (time) at columns 5 and 115, 0 and 100 (survival) at rows 75 and 5."""
    named = ipd(spark, d).select("image_id").distinct()
    make = lambda rows, c: named.crossJoin(F.broadcast(spark.createDataFrame(rows, f"value double, {c} double")))
    return make([(0.0, 5.0), (500.0, 115.0)], "x"), make([(0.0, 75.0), (100.0, 5.0)], "y")


PAINT = """, px AS (SELECT image_id, series, ord, round_even(0.22::DOUBLE * x + 5, 0)::INT AS x, round_even(-0.7::DOUBLE * y + 75, 0)::INT AS y FROM steps),
sg AS (SELECT image_id, series, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM px WINDOW w AS (PARTITION BY image_id, series ORDER BY ord)),
bx AS (SELECT image_id, series, CASE WHEN y1 = y2 THEN greatest(1, least(x1, x2)) ELSE greatest(1, x1 - 1) END AS xa, CASE WHEN y1 = y2 THEN least(120, greatest(x1, x2)) ELSE least(120, x1 + 1) END AS xb,
  CASE WHEN y1 = y2 THEN greatest(1, y1 - 1) ELSE greatest(1, least(y1, y2)) END AS ya, CASE WHEN y1 = y2 THEN least(80, y1 + 1) ELSE least(80, greatest(y1, y2)) END AS yb FROM sg WHERE x2 IS NOT NULL),
pp AS (SELECT DISTINCT image_id, series, i AS x, j AS y FROM bx JOIN (SELECT unnest(generate_series(1, 120)) AS i) ON i BETWEEN xa AND xb JOIN (SELECT unnest(generate_series(1, 80)) AS j) ON j BETWEEN ya AND yb),
lay(layer, series, color) AS (VALUES (1, 'view', '#dc3030'), (2, 'click', '#3030a0'), (3, 'error', '#30a030'), (4, 'purchase', '#a0a030'), (5, 'signup', '#30a0a0'))"""
SHOWN_PIXELS = " SELECT image_id, x::INT AS x, y::INT AS y, min_by(color, layer) AS color FROM pp JOIN lay ON pp.series = lay.series GROUP BY image_id, x, y"
THIN = PAINT.replace("greatest(1, x1 - 1)", "greatest(1, x1)").replace("least(120, x1 + 1)", "least(120, x1)").replace("greatest(1, y1 - 1)", "greatest(1, y1)").replace("least(80, y1 + 1)", "least(80, y1)")
MARKS = f"""mk AS (SELECT image_id, series, round_even(0.22::DOUBLE * time + 5, 0)::INT AS x, round_even(-0.7::DOUBLE * ({SHOWN('surv')}) + 75, 0)::INT AS y FROM km WHERE n_censor > 0),
mp AS (SELECT DISTINCT image_id, series, x, j AS y FROM mk JOIN (SELECT unnest(generate_series(1, 80)) AS j) ON j BETWEEN greatest(1, y - 2) AND least(80, y + 2) WHERE x BETWEEN 1 AND 120)"""
TRACE = KM + f""", tr AS (SELECT image_id, series, time AS x, surv AS s FROM km UNION ALL SELECT DISTINCT image_id, series, 0.0::DOUBLE, 1.0::DOUBLE FROM km),
steps AS (SELECT image_id, series, row_number() OVER (PARTITION BY image_id, series ORDER BY x, s DESC) AS ord, x, {SHOWN('s')} AS y FROM tr)"""


@query(f"WITH {STEPS}{PAINT}{SHOWN_PIXELS}")
def layer_survival(spark, d):
    return render.layer_survival(ipd(spark, d), how_of(spark, d), *_axes(spark, d), legend(spark, d).withColumn("layer", F.col("ord")))


@query(f"WITH {STEPS}{THIN}, {MARKS} SELECT image_id, x::INT AS x, y::INT AS y, min_by(color, layer) AS color FROM (SELECT * FROM pp UNION ALL SELECT * FROM mp) p JOIN lay ON p.series = lay.series GROUP BY image_id, x, y")
def layer_censoring(spark, d):
    return render.layer_survival(ipd(spark, d), how_of(spark, d), *_axes(spark, d), legend(spark, d).withColumn("layer", F.col("ord")), censoring=True)


@query(f"WITH {TRACE}{PAINT}{SHOWN_PIXELS}")
def layer_trace(spark, d):
    scaled = scaled_of(spark, d).join(how_of(spark, d).select("image_id", "max_y", "increasing"), "image_id")
    return render.layer_trace(scaled, how_of(spark, d), *_axes(spark, d), legend(spark, d).withColumn("layer", F.col("ord")))


FACE = ", ".join(f"('{g}', {r}, {c})" for g, lines in render.GLYPHS.items() for r, bits in enumerate(lines) for c in range(5) if bits >> (4 - c) & 1)


@query(f"""WITH {TICKS}, face(letter, r, c) AS (VALUES {FACE}), i AS (SELECT generate_series AS i FROM generate_series(0, 200)), im AS (SELECT DISTINCT image_id FROM axis),
lines AS (SELECT image_id, 10 + i AS x, 100 AS y FROM im, i WHERE i <= 120 UNION SELECT image_id, 10, 20 + i FROM im, i WHERE i <= 80
  UNION SELECT image_id, round_even(x, 0)::BIGINT, 100 + i FROM axis, i WHERE i <= 8 UNION SELECT image_id, 2 + i, round_even(y, 0)::BIGINT FROM axis, i WHERE i <= 8),
words AS (SELECT image_id, label AS word, x, y, greatest(1, least((y2 - y1 + 1) // 7, (x2 - x1 + 1) // (length(label) * 6 - 1))) AS size FROM axis),
laid AS (SELECT image_id, round_even(x - size * (length(word) * 6 - 1) / 2.0::DOUBLE, 0)::BIGINT AS x0, round_even(y - size * 7 / 2.0::DOUBLE, 0)::BIGINT AS y0, size, i AS place, substr(word, (i + 1)::INT, 1) AS letter FROM words, i WHERE i < length(word)),
ink AS (SELECT image_id, x0 + size * (place * 6 + c) + a.i AS x, y0 + size * r + b.i AS y FROM laid JOIN face ON laid.letter = face.letter JOIN i a ON a.i < size JOIN i b ON b.i < size)
SELECT image_id, x::INT AS x, y::INT AS y FROM (SELECT * FROM lines UNION SELECT * FROM ink) p WHERE x BETWEEN 1 AND 140 AND y BETWEEN 1 AND 120""")
def ruler_pixels(spark, d):
    """Axes, ticks and words of a panel from (10, 20) to (130, 100) on 140 x 120."""
    ticks, label = tick_tables(spark, d)
    axis, named = calibrate.resolve(ticks, label), label.select("image_id", "label", F.col("label").alias("word"))
    images = axis.select("image_id").distinct()
    panel = images.select("image_id", *[F.lit(v).alias(c) for c, v in (("x1", 10), ("x2", 130), ("y1", 20), ("y2", 100), ("pad_x1", 4), ("pad_x2", -4), ("pad_y1", 4), ("pad_y2", -3))])
    return render.ruler(panel, axis, axis, images.select("image_id", F.lit(140).alias("width"), F.lit(120).alias("height")), named)


@query(f"""WITH {STEPS}{PAINT}, drawn AS ({SHOWN_PIXELS}), thin AS (SELECT * FROM ({f"WITH {STEPS}{THIN}, {MARKS} SELECT image_id, x::INT AS x, y::INT AS y, min_by(color, layer) AS color FROM (SELECT * FROM pp UNION ALL SELECT * FROM mp) p JOIN lay ON p.series = lay.series GROUP BY image_id, x, y"}))
SELECT coalesce(a.image_id, b.image_id) AS image_id, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y, coalesce(a.color, '#ffffff') AS color_before, coalesce(b.color, '#ffffff') AS color_after
FROM drawn a FULL JOIN thin b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y WHERE coalesce(a.color, '#ffffff') <> coalesce(b.color, '#ffffff')""")
def compare_pixels(spark, d):
    """Where the drawing of the curves and that with censor marks differ, as rasters on white."""
    sizes = how_of(spark, d).select("image_id", "height", "width")
    one, two = (raster.pixels(raster.from_pixels(f(spark, d), sizes, "#ffffff")) for f in (layer_survival, layer_censoring))
    return pixels.difference(one, two)


# --- rasters (kernels) ----------------------------------------------------------------------------------------


def rasters_of(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings' images as rasters; a short last one is filled with white."""
    p = pixel_table(spark, d)
    return raster.from_pixels(p, p.select("image_id", F.lit(50).alias("height"), F.lit(64).alias("width")).distinct(), "#ffffff")


FULL = PIX + """, grid AS (SELECT i.image_id, x.x, y.y FROM (SELECT DISTINCT image_id FROM pix) i CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS x) x CROSS JOIN (SELECT unnest(generate_series(1, 50)) AS y) y),
whole AS (SELECT g.image_id, g.x::INT AS x, g.y::INT AS y, coalesce(p.color, '#ffffff') AS color FROM grid g LEFT JOIN pix p ON g.image_id = p.image_id AND g.x = p.x AND g.y = p.y)"""


@query(f"WITH {FULL} SELECT * FROM whole")
def raster_round_trip(spark, d):
    return raster.pixels(rasters_of(spark, d))


@query(f"WITH RECURSIVE {LAB} SELECT * FROM lab")
def raster_components(spark, d):
    return raster.components(rasters_of(spark, d))


@query(f"WITH RECURSIVE {LAB}, s AS (SELECT image_id, component FROM lab GROUP BY ALL HAVING sqrt(((max(y) - min(y) + 1) * (max(y) - min(y) + 1) + (max(x) - min(x) + 1) * (max(x) - min(x) + 1))::DOUBLE) >= 0.1::DOUBLE * sqrt((64 * 64 + 50 * 50)::DOUBLE)) SELECT lab.image_id, x, y, color FROM lab JOIN s ON lab.image_id = s.image_id AND lab.component = s.component")
def raster_clean(spark, d):
    panel = pixel_table(spark, d).select("image_id", F.lit(1).alias("x1"), F.lit(64).alias("x2"), F.lit(1).alias("y1"), F.lit(50).alias("y2")).distinct()
    return raster.pixels(raster.clean(rasters_of(spark, d), panel, 0.1), foreground_only=True)


_MEAN = lambda i: f"lpad(lower(to_hex(round_even(sum(n * ('0x' || substr(color, {2 * i + 2}, 2))::INT)::DOUBLE / sum(n), 0)::INT)), 2, '0')"


@query(f"""WITH {FULL}, n AS (SELECT image_id, color, count(*) AS n FROM whole GROUP BY ALL),
m AS (SELECT image_id, '#' || {_MEAN(0)} || {_MEAN(1)} || {_MEAN(2)} AS mean FROM n WHERE color <> '#ffffff' GROUP BY image_id)
SELECT w.image_id, x, y, CASE WHEN color = '#ffffff' THEN color ELSE mean END AS color FROM whole w LEFT JOIN m ON w.image_id = m.image_id""")
def raster_quantize(spark, d):
    return raster.pixels(raster.quantize(rasters_of(spark, d), 2))


_LEVEL = lambda c: "lower(lpad(to_hex(" + _gray(*(f"('0x' || substr({c}, {i}, 2))::INT" for i in (2, 4, 6))) + "), 2, '0'))"


@query(f"WITH {FULL} SELECT image_id, x, y, '#' || {_LEVEL('color')} || {_LEVEL('color')} || {_LEVEL('color')} AS color FROM whole")
def raster_grayscale(spark, d):
    return raster.pixels(raster.grayscale(rasters_of(spark, d)))


@query(f"""WITH RECURSIVE {LAB}{FULL[len(PIX):]}, big AS (SELECT image_id, component FROM lab GROUP BY ALL HAVING max(y) - min(y) + 1 >= 0.15::DOUBLE * 50 OR max(x) - min(x) + 1 >= 0.15::DOUBLE * 64),
gone AS (SELECT DISTINCT lab.image_id, x + dx AS x, y + dy AS y FROM lab JOIN big ON lab.image_id = big.image_id AND lab.component = big.component CROSS JOIN (SELECT unnest(generate_series(-2, 2)) AS dx) CROSS JOIN (SELECT unnest(generate_series(-2, 2)) AS dy))
SELECT w.image_id, w.x, w.y, CASE WHEN g.x IS NULL THEN color ELSE '#ffffff' END AS color FROM whole w LEFT JOIN gone g ON w.image_id = g.image_id AND w.x = g.x AND w.y = g.y""")
def raster_clean_for_text(spark, d):
    return raster.pixels(raster.clean_for_text(rasters_of(spark, d)))


SCALED = """pts AS (SELECT image_id, CASE WHEN color = '#dc3030' THEN 'a' ELSE 'b' END AS series, 0.25::DOUBLE * x - 1 AS x, 100 - 2.0::DOUBLE * y AS y FROM fg)"""


@query(f"""WITH {FG}, {SCALED}, {HOW[HOW.index('how AS'):]}, s AS (SELECT p.image_id, series, x, CASE WHEN increasing THEN 1 - y / max_y ELSE y / max_y END AS y, max_y, increasing FROM pts p JOIN how h ON p.image_id = h.image_id)
SELECT image_id, series, round(x, 6) AS x, round(y, 6) AS y, max_y, increasing FROM s WHERE x >= 0 UNION ALL SELECT DISTINCT image_id, series, 0.0::DOUBLE, 1.0::DOUBLE, max_y, increasing FROM s""")
def scale_path(spark, d):
    """Pixels of two colours to (time, survival) by two ticks an axis and the legend."""
    path = pixels.foreground(pixel_table(spark, d))
    images = path.select("image_id").distinct()
    make = lambda rows, schema: images.crossJoin(F.broadcast(spark.createDataFrame(rows, schema)))
    axes = make([(0.0, 4.0), (15.0, 64.0)], "value double, x double"), make([(0.0, 50.0), (100.0, 0.0)], "value double, y double")
    named = make([("a", "#dc3030", 1), ("b", "#3030a0", 2)], "series string, color string, ord int")
    return rounded(scale.scale(path, *axes, named))


@query()
def raster_line_width(spark, d):
    return raster.line_widths(rasters_of(spark, d))


@query()
def raster_paths(spark, d):
    """Shortest path and skeleton of each colour through its largest component."""
    return raster.paths(rasters_of(spark, d))


@query()
def rendered_paths(spark, d):
    """Curves drawn from the patients, then traced back from the drawing."""
    drawn = layer_survival(spark, d)
    return raster.paths(raster.from_pixels(drawn, how_of(spark, d).select("image_id", "height", "width"), "#ffffff"))


FIGURE_ARMS = {"view": "#dc3030", "click": "#3030a0", "error": "#30a030", "purchase": "#a0a030", "signup": "#30a0a0"}


def _sheet(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """How the patients' figures are drawn, and their axes: a canvas of 240 x 160, columns 30 and 190 are times 0 and 640."""
    named = ipd(spark, d).select("image_id").distinct()
    how = how_of(spark, d).withColumn("width", F.lit(240)).withColumn("height", F.lit(160)).withColumn("increasing", F.lit(False))
    make = lambda rows, c: named.crossJoin(F.broadcast(spark.createDataFrame(rows, f"value double, {c} double")))
    return how, (make([(0.0, 30.0), (640.0, 190.0)], "x"), make([(0.0, 140.0), (100.0, 12.0)], "y"))


def _figure(spark: SparkSession, curves: DataFrame, named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rasters of the curves with both axes, and the labels of their ticks, for the images in `named`. The x axis ends one
    column right of the curves' canvas: the panel, which ends with it, holds the latest times, and no fall of a curve there
    is taken for the panel's right side."""
    lines = spark.range(27, 242).select(F.col("id").cast("int").alias("x"), F.lit(143).alias("y")).unionByName(spark.range(5, 144).select(F.lit(27).alias("x"), F.col("id").cast("int").alias("y")))
    ink = named.crossJoin(F.broadcast(lines.withColumn("color", F.lit("#000000"))))
    image = raster.from_pixels(curves.filter("x > 29 and y < 141").unionByName(ink), named.select("image_id", F.lit(160).alias("height"), F.lit(241).alias("width")), "#ffffff")
    ticks = [("A", "0", 30.0, 148.0), ("B", "640", 190.0, 148.0), ("C", "0", 20.0, 140.0), ("D", "100", 20.0, 12.0)]
    return image, named.crossJoin(F.broadcast(spark.createDataFrame([(n, w, 90.0, x, y, int(x) - 3, int(x) + 3, int(y) - 2, int(y) + 2) for n, w, x, y in ticks], "label string, word string, confidence double, x double, y double, x1 int, x2 int, y1 int, y2 int")))


def _inputs(spark: SparkSession, own: DataFrame) -> DataFrame:
    """The judgment inputs that all figures share, beside those of each image in `own`."""
    shared = specs.rows(spark, {"-": {"x_label": ["A", "B"], "x_value": [0.0, 640.0], "y_label": ["C", "D"], "y_value": [0.0, 100.0], "background": "#ffffff", "garbage": ["#000000"], "series": list(FIGURE_ARMS.values()), "series_names": list(FIGURE_ARMS), "reference": "click"}})
    return own.crossJoin(F.broadcast(shared.drop(*own.columns)))


def figures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rasters with axes, labels and inputs for the patients' figures: five arms on a canvas."""
    how, axes = _sheet(spark, d)
    arms = legend(spark, d).filter("series <> 'none'").withColumn("layer", F.col("ord"))
    image, label = _figure(spark, render.layer_survival(ipd(spark, d), how, *axes, arms), how.select("image_id"))
    at_risk = km.numbers_at_risk(ipd(spark, d), [0.0, 100.0, 200.0])
    lists = at_risk.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("series", "x", F.col("patients").cast("int").alias("patients")))).alias("r"))
    return image, label, _inputs(spark, lists.select("image_id", F.col("r.patients").alias("risk_patients"), F.col("r.series").alias("risk_series"), F.col("r.x").alias("risk_x")))


def fronted(spark: SparkSession, d: str, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same figures once for each of their arms, `image/arm`, with that arm in front: arms may lie within a line's width
    of each other, and of one that others cover a figure shows nothing or not the end. Inputs name the arms that show; those
    behind come with no patients, so that each arm's are read once, from the figure that shows it whole."""
    how, axes = _sheet(spark, d)
    points = keep(render.curves(ipd(spark, d), how, *axes).distinct(), "points")
    arms = F.create_map(*[F.lit(v) for i, (s, c) in enumerate(FIGURE_ARMS.items()) for v in (s, F.struct(F.lit(i + 1).alias("ord"), F.lit(c).alias("color")))])
    pairs = points.select("image_id", "series").distinct()
    pairs = pairs.join(pairs.select("image_id", F.col("series").alias("front")), "image_id").select("image_id", F.concat("image_id", F.lit("/"), "front").alias("figure"), "series", "front", arms[F.col("series")].alias("arm"))
    layers = pairs.select(F.col("figure").alias("image_id"), "series", "arm.color", F.when(F.col("series") == F.col("front"), 0).otherwise(F.col("arm.ord")).alias("layer"))
    drawn = keep(render.painted(points.join(pairs, ["image_id", "series"]).select(F.col("figure").alias("image_id"), "series", "x", "y"), layers), "drawn")
    image, label = _figure(spark, drawn, drawn.select("image_id").distinct())
    shown = drawn.filter("x > 29 and y < 141").select(F.col("image_id").alias("figure"), "color").distinct()
    counts = km.numbers_at_risk(ipd(spark, d), [0.0, 100.0, 200.0]).groupBy("image_id", "series").agg(F.sort_array(F.collect_list(F.struct("x", F.col("patients").cast("int").alias("patients")))).alias("own"))
    none = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0).alias("patients")))
    rows = pairs.join(counts, ["image_id", "series"]).withColumn("color", F.col("arm.color")).join(shown, ["figure", "color"])
    rows = rows.groupBy("figure", "front").agg(F.sort_array(F.collect_list(F.struct("arm.ord", "color", "series", F.when(F.col("series") == F.col("front"), F.col("own")).otherwise(none).alias("risk")))).alias("a"))
    risk = F.flatten(F.transform("a", lambda a: F.transform(a["risk"], lambda r: F.struct(r["x"].alias("x"), r["patients"].alias("patients"), a["series"].alias("series")))))
    rows = rows.withColumn("r", risk).select(F.col("figure").alias("image_id"), F.col("a.color").alias("series"), F.col("a.series").alias("series_names"), F.col("front").alias("reference"), *[F.col(f"r.{c}").alias(f"risk_{c}") for c in ("patients", "series", "x")])
    return image, label, _inputs(spark, rows)


def _canvas(sql: str) -> str:
    """The layers' SQL for the figures' canvas and axes."""
    for small, large in (("0.22::DOUBLE * x + 5", "0.25::DOUBLE * x + 30"), ("-0.7::DOUBLE * y + 75", "-1.28::DOUBLE * y + 140"), ("least(120", "least(240"), ("least(80", "least(160"), ("(1, 120)", "(1, 240)"), ("(1, 80)", "(1, 160)"), (SHOWN("s"), "100 * s")):
        sql = sql.replace(small, large)
    return sql


# all that is drawn right of the y axis and above the x axis is kept: the curves begin in one point and are one component
@query(_canvas(f"WITH {STEPS}{PAINT}") + f""", drawn AS ({SHOWN_PIXELS}), inside AS (SELECT image_id, color, count(*) AS n FROM drawn WHERE x > 29 AND y < 141 GROUP BY ALL)
SELECT i.image_id, lay.layer::INT AS ord, lay.series, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT image_id FROM ipd) i CROSS JOIN lay LEFT JOIN inside ON inside.image_id = i.image_id AND inside.color = lay.color""")
def distill_counts(spark, d):
    """Calibrate, panel, mask, classify, clean and count, on all figures."""
    from .reconstruct import Engine, distill

    keep = Engine(spark)._keep  # or every rule and stage would plan, and draw, the figures again
    return distill(*(keep(t, n) for t, n in zip(figures(spark, d), ("source", "label", "spec"), strict=True)), keep)["counts"]


@query()
def reconstruct(spark, d):
    """The whole way: drawn figures to patients, every arm from the figure that has it in front."""
    from .reconstruct import Engine

    engine = Engine(spark)
    image, label, inputs = fronted(spark, d, engine._keep)
    found = engine.reconstruct(image, inputs, findings=label)
    order = F.array_position(F.array(*[F.lit(s) for s in FIGURE_ARMS]), F.col("series")).cast("int")
    return found.select(F.expr("left(image_id, length(image_id) - length(series) - 1)").alias("image_id"), order.alias("ord"), "series", "time", "status")
