"""Raster kernels, pixel relations, labels, rendering, sources and the whole pipeline on synthetic images."""

import heapq
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stairlight.functions import colors, text
from stairlight.operators import calibrate, kernels as K, ocr, pixels, raster, render
from stairlight.plans import queries
from stairlight.plans.reconstruct import Engine, distill
from stairlight.schemas import TABLES, DataError
from stairlight.sources import images, png, sinks, spec as specs
from stairlight.streaming import images as stream

WHITE, BLACK, RED, BLUE = 0xFFFFFF, 0, 0xDC3030, 0x3030A0


def blank(h, w):
    return np.full((h, w), WHITE)


def l_axis():
    c = blank(100, 100)
    c[9:80, 19] = BLACK
    c[79, 19:90] = BLACK
    return c


def as_raster(spark, **named):
    return spark.createDataFrame([(k, *c.shape, bytearray(K.to_bytes(c))) for k, c in named.items()], TABLES["raster"])


def to_colors(row):
    return K.to_colors(K.to_array(row["data"], row["height"], row["width"]))


def flood(mask):
    labels, todo = np.zeros(mask.shape, int), [tuple(p) for p in np.argwhere(mask.T)[:, ::-1]]
    for p in todo:
        if not labels[p]:
            mark, queue = p[1] * mask.shape[0] + p[0] + 1, [p]
            labels[p] = mark
            while queue:
                y, x = queue.pop()
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not labels[q]:
                        labels[q] = mark
                        queue.append(q)
    return labels


@pytest.mark.parametrize("seed", range(6))
def test_components_against_flood_fill(seed):
    mask = np.random.default_rng(seed).random((17, 23)) < 0.55
    assert (K.components(mask) == flood(mask)).all()


def test_components_of_nothing():
    assert not K.components(np.zeros((4, 4), bool)).any()


def test_thinning_keeps_a_thin_connected_line():
    mask = np.zeros((10, 20), bool)
    mask[3:6, 2:18] = True
    bones = K.thin(mask)
    assert bones.any() and (bones <= mask).all() and bones.sum(0).max() <= 2 and bones.sum() <= 18


def test_line_width_of_a_thick_line():
    c = blank(10, 20)
    c[3:6, 2:18] = RED
    assert K.line_width(c, WHITE) in (3, 4)
    assert K.line_width(blank(5, 5), WHITE) == 2


def test_dilation():
    mask = np.zeros((9, 9), bool)
    mask[4, 4] = True
    assert K.dilate(mask, 2).sum() == 25 and K.dilate_disk(mask, 1).sum() == 5


@pytest.mark.parametrize("most", [2, 4, 8])
def test_quantize_bounds_colours(most):
    c = np.random.default_rng(1).integers(0, 1 << 24, (20, 20))
    assert len(np.unique(K.quantize(c, most))) <= most
    few = np.where(np.arange(400).reshape(20, 20) % 3 == 0, RED, WHITE)
    assert (K.quantize(few, most) == few).all()


def test_two_colours_split_ink_from_paper():
    c = blank(10, 10)
    c[2:4, 2:4] = 0x202020
    c[4, 4] = 0x303030
    assert K.foreground(c).sum() == 5


def test_find_line_takes_the_mean_of_ties_and_all_points():
    mask = np.zeros((12, 9), bool)
    mask[2:9, [3, 5]] = True
    mask[11, 4] = True
    assert K.find_line(mask, np.arange(1, 10)) == (5, 12, 12)
    mask[:, :] = False
    mask[2:9, 3], mask[10, 3] = True, True
    assert K.find_line(mask, np.arange(1, 10)) == (4, 3, 11)
    assert K.find_line(mask, np.arange(6, 9)) is None


@pytest.mark.parametrize("seed", range(5))
def test_runs_and_level_lines_against_upright_ones(seed):
    mask = np.random.default_rng(seed).random((31, 31)) < 0.7
    for axis in (0, 1):
        expected = [max(map(len, "".join("x" if v else " " for v in line).split()), default=0) for line in (mask.T if axis == 0 else mask)]
        assert K.longest_runs(mask, axis).tolist() == expected
    # a row search is a column search of the image turned so that the lowest row is the first column
    turned, found = mask[::-1].T, K.find_line(mask, np.arange(3, 29), level=True)
    other = K.find_line(turned, np.arange(4, 30))
    assert (found is None) == (other is None) and (found is None or (32 - found[0], *found[1:]) == other)


def test_panel_of_an_l_axis_and_a_box():
    p = K.panel(l_axis(), 18, 83, 20, 4)
    assert (p["x1"], p["y2"], p["x2"], p["y1"]) == (20, 80, 90, 10)
    assert p["pad_x1"] > 0 > p["pad_y2"] and p["pad_x2"] > 0 > p["pad_y1"]
    boxed = l_axis()
    boxed[4, 24:95] = BLACK
    boxed[14:75, 94] = BLACK
    q = K.panel(boxed, 18, 83, 20, 4)
    assert (q["y1"], q["x2"]) == (5, 95) and q["pad_y1"] > 0 > q["pad_x2"]


def test_panel_without_axes():
    with pytest.raises(ValueError, match="y-axis"):
        K.panel(blank(50, 50), 10, 40, 10, 4)


def cheapest(target, mask, start, end):
    g, best, queue = np.where(target, 1.0, 0.1), {start: 0.0}, [(0.0, start)]
    while queue:
        c, p = heapq.heappop(queue)
        for q in ((p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)):
            if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and c + 2 / (g[p] + g[q]) < best.get(q, 1e9):
                best[q] = c + 2 / (g[p] + g[q])
                heapq.heappush(queue, (best[q], q))
    return best.get(end)


@pytest.mark.parametrize("seed", range(5))
def test_shortest_path_cost_and_connection(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((9, 12)) < 0.85
    mask[0, 0] = mask[8, 11] = True
    target = mask & (rng.random((9, 12)) < 0.5)
    path, cost = K.shortest(target, mask, (0, 0), (8, 11))
    expected = cheapest(target, mask, (0, 0), (8, 11))
    if expected is None:
        assert not path
    else:
        assert cost == pytest.approx(expected)
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 and mask[b] for a, b in zip(path, path[1:]))


def step_curve():
    c = blank(20, 40)
    c[4, :20] = c[9, 19:] = RED
    c[4:10, 19] = RED
    return c


def test_path_follows_a_step_curve():
    found, width = K.paths(step_curve())
    y, x = np.nonzero(found[RED])
    assert width in (1, 2) and x.min() <= 2 and x.max() >= 37 and {4, 9} <= set(y.tolist())


def test_path_passes_under_another_curve():
    c = blank(5, 20)
    c[1, :12] = RED
    c[1:3, 11] = RED
    c[2, 7:20] = BLUE
    found, _ = K.paths(c)
    assert set(found) == {RED, BLUE} and np.nonzero(found[BLUE])[1].min() <= 7
    with pytest.raises(ValueError, match="no curve"):
        K.paths(blank(5, 5))


def test_pixel_round_trip_and_relations(spark):
    r = as_raster(spark, a=l_axis(), b=step_curve())
    p = raster.pixels(r)
    assert p.count() == 100 * 100 + 20 * 40
    sizes = r.select("image_id", "height", "width")
    back = {x["image_id"]: to_colors(x) for x in raster.from_pixels(p, sizes, "#000000").collect()}
    assert (back["a"] == l_axis()).all() and (back["b"] == step_curve()).all()
    assert {x["image_id"]: x["background"] for x in colors.most_frequent(p).collect()} == {"a": "#ffffff", "b": "#ffffff"}
    assert pixels.difference(p, p).count() == 0


def test_mask_relation_equals_mask_kernel(spark):
    r = as_raster(spark, b=step_curve())
    rects = spark.createDataFrame([("b", 1, 5, 30, 3, 12, True), ("b", 2, 15, 18, 1, 20, False)], "image_id string, ord int, x1 int, x2 int, y1 int, y2 int, keep boolean")
    a = raster.pixels(raster.mask(r, rects, initial=False))
    assert pixels.difference(a, pixels.mask(raster.pixels(r), rects, initial=False)).count() == 0
    assert raster.pixels(raster.mask(r, rects.filter("false"))).join(raster.pixels(r), ["image_id", "x", "y", "color"]).count() == 800


def test_classify_relation_equals_kernel(spark):
    c = np.random.default_rng(2).integers(0, 1 << 24, (12, 12))
    r = as_raster(spark, a=c)
    palette = spark.createDataFrame([("a", "#ffffff", ["#dc3030"], ["#000000"])], "image_id string, background string, series array<string>, garbage array<string>")
    a = raster.pixels(raster.classify(r, palette))
    assert pixels.difference(a, pixels.classify(raster.pixels(r), "#ffffff", ["#dc3030"], ["#000000"])).count() == 0
    assert {x["color"] for x in a.select("color").distinct().collect()} <= {"#ffffff", "#dc3030"}
    with pytest.raises(ValueError, match="unique"):
        pixels.classify(raster.pixels(r), "#ffffff", ["#ffffff"])


def test_clean_drops_short_components(spark):
    c = l_axis()
    c[50:52, 60:62] = BLACK
    panel = spark.createDataFrame([("a", 20, 90, 10, 80)], "image_id string, x1 int, x2 int, y1 int, y2 int")
    assert (to_colors(raster.clean(as_raster(spark, a=c), panel).first()) == l_axis()).all()


def test_clean_for_text_drops_lines_and_keeps_letters(spark):
    c = l_axis()
    c[90:94, 50:53] = BLACK
    out = to_colors(raster.clean_for_text(as_raster(spark, a=c)).first())
    assert (out[90:94, 50:53] == BLACK).all() and (out != WHITE).sum() == 12
    assert (to_colors(raster.clean_for_text(as_raster(spark, a=blank(8, 8))).first()) == WHITE).all()


def test_path_and_endpoint_relations(spark):
    fg = pixels.foreground(raster.pixels(as_raster(spark, a=step_curve())))
    start = pixels.start_points(fg, fg, spark.createDataFrame([("a", 1)], "image_id string, start_x int"))
    assert (start.first()["start_x"], start.first()["start_y"]) == (1, 5)
    end = pixels.end_points(fg, start).first()
    assert (end["end_x"], end["end_y"]) == (40, 10)
    assert raster.paths(as_raster(spark, a=step_curve())).select("width", "height").distinct().first() == (40, 20)


def test_colours(spark):
    assert colors.NAMED["green"] == (0, 255, 0) and colors.NAMED["gray50"] == colors.NAMED["grey50"] == (127, 127, 127) and colors.NAMED["red4"] == (139, 0, 0) and len(colors.NAMED) > 600
    odd = spark.createDataFrame([("SteelBlue",), ("steelbluish",), ("#12",), (None,)], "c string").select(colors.rgb(F.col("c")).alias("a")).collect()
    assert [r["a"] for r in odd] == ["#4682b4", None, None, None]
    df = spark.createDataFrame([("#DC3030",), ("red",), ("#dc303080",)], "c string")
    rows = df.select(colors.rgb(F.col("c")).alias("a"), colors.rgba(F.col("c")).alias("b"), colors.valid(F.col("c")).alias("v")).collect()
    assert [tuple(r) for r in rows] == [("#dc3030", "#dc3030ff", True), ("#ff0000", "#ff0000ff", False), ("#dc3030", "#dc303080", True)]
    near = colors.nearest(spark.createDataFrame([("#fe0101",)], "c string"), "c", [(n, colors.hex_of(v)) for n, v in colors.NAMED.items()], "n")
    assert near.first()["n"] == "red"
    assert spark.range(1).select(colors.ruler(F.lit("#7f7f80")).alias("r"), colors.flatten(F.lit(0), F.lit(0.5)).alias("f")).first() == ("#ffffff", 128)


def test_text(spark):
    df = spark.createDataFrame([("Drug A (high)!", "3.5", 26), ("--x--", ".5", 25), ("", "5.", 651)], "t string, w string, n int")
    rows = df.select(text.slug(F.col("t")), text.positive_number(F.col("w")), text.letters(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [("drug_a_high", True, "AA"), ("x", True, "Z"), ("", False, "AAA")]
    one = df.limit(1).select(*[c.alias(str(i)) for i, c in enumerate(text.box(F.lit("5,6,9,13"), 4))]).first()
    assert tuple(one) == (2, 2, 2, 4)  # 1.5, 1.75, 2.5, 3.5 half to even


RAW = [(0, 1, "12", 90.0, "39,39,79,79"), (1, 1, "1-2", 95.0, "43,39,83,79"), (0, 2, "abc", 99.0, "0,0,10,10"), (0, 3, "7", 10.0, "0,0,10,10"), (0, 4, "0", 80.0, "199,39,239,79"), (0, 5, "30", 80.0, "39,399,79,439")]


def test_labels_pool_and_letter_in_reading_order(spark):
    raw = spark.createDataFrame([("a", *r) for r in RAW], "image_id string, mode int, ord int, word string, confidence double, bbox string")
    rows = ocr.labels(raw).orderBy("label").collect()
    assert [(r["label"], r["word"]) for r in rows] == [("A", "12"), ("B", "0"), ("C", "30")]
    assert rows[0]["confidence"] == 95.0 and rows[0]["x1"] == 11


def test_detect_with_an_engine(spark):
    engine = lambda image_id, rgb, mode: [("6", 91.0, "3,3,19,19")] if mode == 7 and rgb.shape == (80, 160, 3) else []
    out = ocr.labels(ocr.detect(as_raster(spark, a=step_curve()), engine)).collect()
    assert [(r["label"], r["word"], r["x1"], r["x2"]) for r in out] == [("A", "6", 1, 5)]


def test_built_in_engine_reads_drawn_numbers(spark):
    words = [("12.5", 30.0, 12.0), ("0", 100.0, 12.0), ("300", 30.0, 40.0), ("47", 100.0, 40.0), ("6.98", 65.0, 62.0)]
    rows = spark.createDataFrame([("a", w, x, y, 60, 14) for w, x, y in words], "image_id string, word string, x double, y double, box_width int, box_height int")
    sizes = spark.createDataFrame([("a", 76, 140)], "image_id string, height int, width int")
    image = raster.from_pixels(render.text(rows).withColumn("color", F.lit("#202020")), sizes, "#ffffff")
    found = ocr.labels(ocr.detect(image, ocr.glyphs)).orderBy("label").collect()
    assert [r["word"] for r in found] == [w for w, _, _ in words]
    assert all(r["confidence"] == 100.0 and abs(r["x"] - x) <= 1.5 and abs(r["y"] - y) <= 1.5 for r, (_, x, y) in zip(found, words))
    assert ocr.detect(as_raster(spark, a=blank(9, 9)), ocr.glyphs).count() == 0
    lines = ocr.labels(ocr.detect(as_raster(spark, a=l_axis()), ocr.glyphs))
    assert lines.count() == 0


def test_overlaps_and_pool_against_brute_force(spark):
    rng = random.Random(3)
    boxes = [("a", i, x, x + rng.randint(1, 300), y, y + rng.randint(1, 300)) for i in range(60) for x, y in [(rng.randint(1, 900), rng.randint(1, 900))]]
    df = spark.createDataFrame(boxes, "image_id string, box int, x1 int, x2 int, y1 int, y2 int")
    meet = lambda a, b: a[2] < b[3] and a[3] > b[2] and a[4] < b[5] and a[5] > b[4]
    assert {(r["a"], r["b"]) for r in ocr.overlaps(df).collect()} == {(a[1], b[1]) for a in boxes for b in boxes if a[1] < b[1] and meet(a, b)}
    found = df.select("image_id", F.lit(0).alias("mode"), F.col("box").alias("ord"), F.lit("1").alias("word"), ((F.col("box") * 7) % 11).cast("double").alias("confidence"), "x1", "x2", "y1", "y2", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    kept = []
    for b in sorted(boxes, key=lambda b: (-(b[1] * 7 % 11), b[1])):
        if not any(meet(b, k) for k in kept):
            kept.append(b)
    assert {r["ord"] for r in ocr.pool(found).collect()} == {b[1] for b in kept}


LABEL = [("A", "0", 20, 86), ("B", "12", 90, 86), ("C", "0", 15, 80), ("D", "1", 15, 10)]


def label_table(spark, rows=LABEL):
    return spark.createDataFrame([("a", n, w, 90.0, float(x), float(y), x - 2, x + 2, y - 2, y + 2) for n, w, x, y in rows], TABLES["label"])


SPEC = {"x_label": ["A", "B"], "x_value": [0.0, 12.0], "y_label": ["C", "D"], "y_value": [0.0, 1.0], "background": "#ffffff", "garbage": ["#000000"], "series": ["#DC3030"], "series_names": ["Arm"], "reference": "Arm", "risk_patients": [100, 80], "risk_series": ["Arm", "Arm"], "risk_x": [0.0, 6.0]}


def figure():
    c = l_axis()
    c[29:31, 20:56] = RED
    c[29:51, 54:56] = RED
    c[49:51, 54:86] = RED
    return c


def test_calibrate(spark):
    x, y = calibrate.calibrate(specs.rows(spark, {"a": SPEC}), label_table(spark))
    assert {(r["label"], r["value"], r["x"]) for r in x.collect()} == {("A", 0.0, 20.0), ("B", 12.0, 90.0)}
    b = calibrate.band(x, y).first()
    assert (b["y_axis_column"], b["x_axis_row"], b["median_height"], b["band"]) == (17, 84, 4.0, 16)
    for bad, message in ((SPEC | {"x_label": ["A", "Z"]}, "Unknown labels not in OCR data: Z"), (SPEC | {"x_label": ["A", "C"]}, "share labels: C"), (SPEC | {"x_label": ["A"]}, "length exactly 2"), (SPEC | {"x_label": ["A", "E"]}, "not aligned"), (SPEC | {"x_value": [1.0, 1.0]}, "one value"), (SPEC | {"x_label": ["A", "A"]}, "one label"), (SPEC | {"y_value": [0.0, float("nan")]}, "missing entry")):
        with pytest.raises(DataError, match=message):
            calibrate.calibrate(specs.rows(spark, {"a": bad}), label_table(spark, [*LABEL, ("E", "9", 50, 40)]))


def test_distill(spark):
    out = distill(as_raster(spark, a=figure()), label_table(spark), specs.rows(spark, {"a": SPEC}))
    p = out["panel"].first()
    assert (p["x1"], p["x2"], p["y1"], p["y2"]) == (20, 90, 10, 80)
    clean = to_colors(out["clean"].first())
    assert set(np.unique(clean)) == {RED, WHITE}
    assert out["counts"].first()["n"] == (clean == RED).sum() > 100
    with pytest.raises(DataError, match="valid hex"):
        distill(as_raster(spark, a=figure()), label_table(spark), specs.rows(spark, {"a": SPEC | {"background": "nope"}}))
    with pytest.raises(DataError, match="reference"):
        distill(as_raster(spark, a=figure()), label_table(spark), specs.rows(spark, {"a": SPEC | {"reference": "B"}}))


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/engine")
    with pytest.raises(DataError, match="no survival yet"):
        engine.quantiles([0.5])
    data = engine.reconstruct(as_raster(spark, a=figure()), specs.rows(spark, {"a": SPEC}), findings=label_table(spark))
    assert data.count() == 100
    drop = engine.quantiles([0.6]).first()["time"]
    assert drop == pytest.approx(6.0, abs=0.5)
    assert engine.counts().filter("series = 'total'").first()["patients"] == 100
    assert engine.risk_table("wide").count() == 2 and engine.events_table() is None
    assert engine.legend().first()["color_name"] is not None
    painted = to_colors(engine.rendered().first())
    assert painted.shape == (100, 100) and (painted == RED).sum() > 60
    assert painted[0, 0] == WHITE
    difference = engine.compare()
    assert {(r["x"], r["y"]) for r in pixels.difference(raster.pixels(engine.tables["source"]), raster.pixels(engine.impression())).collect()} == {(r["x"], r["y"]) for r in difference.collect()}
    assert (to_colors(engine.preview().first()) == BLACK).sum() > 100
    for call, message in ((lambda: engine.compare(front=2), "front 2"), (lambda: engine.rendered("bones"), "what must be"), (lambda: engine.quantiles([1.5]), "probabilities"), (lambda: engine.quantiles([0.5], "odds"), "type"), (lambda: engine.probabilities([-1.0]), "times"), (lambda: engine.quantiles([0.5], confidence=1.0), "confidence"), (lambda: engine.quantize(as_raster(spark, a=figure())), "once"), (lambda: engine.distill(specs.rows(spark, {"a": SPEC})), "once"), (lambda: engine.hazard_ratios("nobody"), "reference")):
        with pytest.raises(DataError, match=message):
            call()
    assert engine.data().count() == 100
    marked = to_colors(engine.annotated().first())
    assert (marked == 0xFF0000).sum() > 40 and marked.shape == (100, 100)
    with pytest.raises(TimeoutError):
        Engine(spark, f"file://{tmp_path}/late").reconstruct(as_raster(spark, a=figure()), specs.rows(spark, {"a": SPEC}), findings=label_table(spark), timeout=0.01)
    with pytest.raises(Exception, match="at least one other"):
        engine.hazard_ratios().collect()
    done = sinks.write_csv({"counts": engine.counts(), "events_table": None}, f"file://{tmp_path}/out/export")
    assert done == ["counts"] and spark.read.option("header", True).csv(f"file://{tmp_path}/out/export/data/counts").count() == 2
    for bad in ("", "/", "file:///", "/tmp/../etc/x"):
        with pytest.raises(ValueError, match="refusing"):
            sinks.write_csv({}, bad)


def events(spark, folder, arms):
    """arms: (user_id, series) -> times; every third patient is censored, alike in all arms."""
    rows, ids = [], 0
    for (user, series), times in arms.items():
        rows += [(3 * (ids + i) + (i % 3), user, series, float(t)) for i, t in enumerate(times)]
        ids += len(times)
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_reconstruct_reads_arms_that_others_cover(spark, tmp_path):
    times = [round(-50 * math.log(1 - (i + 0.5) / 90), 2) for i in range(90)]
    arms = {(4, s): times for s in ("view", "click", "error", "purchase", "signup")} | {(5, "view"): times, (5, "signup"): times}
    rows = queries.reconstruct(spark, events(spark, tmp_path, arms)).collect()
    found = {}
    for r in rows:
        found.setdefault((r["image_id"], r["ord"], r["series"]), []).append((r["time"], r["status"]))
    assert sorted(found) == [("fig0", 1, "view"), ("fig0", 2, "click"), ("fig0", 3, "error"), ("fig0", 4, "purchase"), ("fig0", 5, "signup"), ("fig1", 1, "view"), ("fig1", 5, "signup")]
    assert all(sorted(v) == sorted(found["fig0", 1, "view"]) and len(v) == 90 for v in found.values())
    assert np.median([t for t, _ in found["fig0", 5, "signup"]]) == pytest.approx(np.median(times), abs=8)


def test_distill_counts_keep_the_latest_times(spark, tmp_path):
    times = [round(-50 * math.log(1 - (i + 0.5) / 90), 2) for i in range(90)]
    late = times[:30] + [838.0] * 60  # falls in the canvas's last columns
    arms = {(4, "view"): times, (4, "error"): [*times[:-1], 834.0], (5, "view"): times, (5, "click"): late, (6, "signup"): [*times, 2000.0]}
    folder = events(spark, tmp_path, arms)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    expected = con.sql(f"select image_id, ord, series, n from ({queries.ORACLES['distill_counts']})").fetchall()
    assert sorted(map(tuple, queries.distill_counts(spark, folder).select("image_id", "ord", "series", "n").collect())) == sorted(expected)


def test_layers(spark):
    data = spark.createDataFrame([("a", "s", 5.0, 1), ("a", "s", 10.0, 0)], "image_id string, series string, time double, status int")
    how = spark.createDataFrame([("a", 1.0, False, 20, 21, 1)], "image_id string, max_y double, increasing boolean, width int, height int, line_width int")
    axes = spark.createDataFrame([("a", 0.0, 1.0), ("a", 10.0, 19.0)], "image_id string, value double, x double"), spark.createDataFrame([("a", 1.0, 1.0), ("a", 0.0, 21.0)], "image_id string, value double, y double")
    legend = spark.createDataFrame([("a", "s", "#dc3030", 1)], "image_id string, series string, color string, layer int")
    assert [(r["x"], r["y"]) for r in render.steps(data, how).orderBy("ord").collect()] == [(0, 1), (5, 1), (5, 0.5), (10, 0.5)]
    points = {(r["x"], r["y"]) for r in render.layer_survival(data, how, *axes, legend).collect()}
    assert points == {(x, 1) for x in range(1, 11)} | {(10, y) for y in range(1, 12)} | {(x, 11) for x in range(10, 20)}
    marked = {(r["x"], r["y"]) for r in render.layer_survival(data, how, *axes, legend, censoring=True).collect()}
    assert marked - points == {(19, y) for y in (9, 10, 12, 13)}


def two_arms():
    c = figure()
    c[59:61, 20:70] = BLUE
    return c


def test_export_has_a_page_for_each_legend_row(spark, tmp_path):
    two = SPEC | {"series": ["#dc3030", "#3030a0"], "series_names": ["Arm", "Other one"], "risk_patients": [100, 80, 50, 40], "risk_series": ["Arm", "Arm", "Other one", "Other one"], "risk_x": [0.0, 6.0, 0.0, 6.0], "background": "#FFFFFF"}
    engine = Engine(spark, f"file://{tmp_path}/engine")
    engine.reconstruct(as_raster(spark, a=two_arms()), specs.rows(spark, {"a": two}), findings=label_table(spark))
    (tmp_path / "out" / "x").mkdir(parents=True)
    (tmp_path / "out" / "x" / "old.txt").write_text("old")
    assert "data" in engine.export(f"file://{tmp_path}/out/x")
    pages = {r["name"]: r["value"] for r in spark.read.text(f"file://{tmp_path}/out/x/compare").collect()}
    assert len(pages) == 2 and all(n.startswith(("arm_", "other_one_")) and h.count("data:image/png;base64,") == 2 for n, h in pages.items())
    assert not (tmp_path / "out" / "x" / "old.txt").exists()
    dark = specs.rows(spark, {"a": two | {"series": ["#dc3030", "#dc3030"]}})
    with pytest.raises(DataError, match="unique"):
        distill(as_raster(spark, a=two_arms()), label_table(spark), dark)


def test_text_is_centred_and_fits_its_box(spark):
    words = spark.createDataFrame([("a", "10", 50.0, 30.0, 22, 14), ("b", "I", 10.0, 10.0, 3, 3), ("c", "", 1.0, 1.0, 9, 9)], "image_id string, word string, x double, y double, box_width int, box_height int")
    points = {}
    for r in render.text(words).collect():
        points.setdefault(r["image_id"], set()).add((r["x"], r["y"]))
    xs, ys = ([p[k] for p in points["a"]] for k in (0, 1))
    assert set(points) == {"a", "b"} and max(xs) - min(xs) < 22 and max(ys) - min(ys) + 1 == 14 and abs(sum(xs) / len(xs) - 50) < 4
    assert len(points["b"]) == sum(bin(v).count("1") for v in render.GLYPHS["I"])


def test_ruler(spark):
    panel = spark.createDataFrame([("a", 20, 30, 10, 40, 3, -3, 3, -3)], TABLES["panel"])
    axis = lambda x, y: spark.createDataFrame([("a", float(x), float(y))], "image_id string, x double, y double")
    out = {(r["x"], r["y"]) for r in render.ruler(panel, axis(25, 48), axis(12, 15), spark.createDataFrame([("a", 50, 44)], "image_id string, width int, height int")).collect()}
    assert out == {(x, 40) for x in range(20, 31)} | {(20, y) for y in range(10, 41)} | {(25, y) for y in range(40, 45)} | {(x, 15) for x in range(14, 21)}


def test_png_round_trip_and_filters():
    rgb = np.random.default_rng(4).integers(0, 256, (7, 9, 3)).astype(np.uint8)
    assert (png.decode(png.encode(rgb)) == rgb).all()
    with pytest.raises(ValueError, match="not a PNG"):
        png.decode(b"GIF89a")
    assert (png.over_white(np.zeros((1, 1, 4), np.uint8)) == 255).all()


def test_image_folder_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name, c in (("a", figure()), ("b", step_curve())):
        (folder / f"{name}.png").write_bytes(png.encode(K.to_array(K.to_bytes(c), *c.shape)))
    assert images.register(spark, str(folder)).count() == 2
    got = {r["image_id"].rsplit("/", 1)[1]: to_colors(r) for r in images.read(spark, str(folder)).collect()}
    assert (got["a.png"] == figure()).all() and (got["b.png"] == step_curve()).all()
    query = stream.run(stream.rasters(spark, str(folder)), raster.line_widths, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    (folder / "c.txt").write_text("x")
    with pytest.raises(DataError, match="must be one of"):
        images.register(spark, str(folder))
