"""Sessions, growth, rasters, recurrences and steps: hand-worked values and brute force."""

import datetime as dt
import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from panelspark.functions import calendar as CAL, fire, geo
from panelspark.operators import raster as R, recurrence as REC, sessions as S, spatial as G, steps as T


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_gap_sessions_split_only_beyond_the_gap(spark):
    times = [0, 5400, 10801, 10801, 30000]
    points = spark.createDataFrame([("f", i, t) for i, t in enumerate(times)], "entity string, id int, t long")
    got = {r.id: r.session for r in S.sessionise(points, "entity", "t", 5400).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 3}


def test_growth_geometry_and_angles(spark):
    offsets = spark.createDataFrame([("f", 1.0, 0.0), ("f", 2.0, 0.0)], "f string, dx double, dy double")
    g = S.growth_geometry(offsets, ["f"], 375.0).first()
    assert (g.bearing, g.distance_max, g.distance_mean, g.directionality) == (90.0, 750.0, 562.5, 1.0)
    r = one(spark, a=geo.angle_between(F.lit(350.0), F.lit(10.0)), b=geo.angle_between(F.lit(90.0), F.lit(270.0)), c=geo.bearing(F.lit(0.0), F.lit(0.0)),
            u=geo.wind_vector(F.lit(10.0), F.lit(270.0))[0], v=geo.wind_vector(F.lit(10.0), F.lit(360.0))[1], calm=geo.wind_from(F.lit(0.0), F.lit(0.0)), turn=geo.wind_from(F.lit(0.0), F.lit(-5.0)))
    assert (r.a, r.b, r.c, r.calm, r.turn) == (20.0, 180.0, None, None, 0.0)
    assert r.u == pytest.approx(10) and r.v == pytest.approx(-10)


def test_middle_row_and_mode(spark):
    points = spark.createDataFrame([("f", 1, t, "D" if t < 4 else "N") for t in (1, 2, 3, 7, 7, 9)], "entity string, session int, t long, daynight string")
    assert S.middle_times(points, "entity", "session", "t").first().middle_time == 7
    assert S.modal_value(points, ["entity"], "daynight", "m").first().m == "D"


def brute_fill(cells):
    xs, ys = [x for x, _ in cells], [y for _, y in cells]
    box = {(x, y) for x in range(min(xs) - 1, max(xs) + 2) for y in range(min(ys) - 1, max(ys) + 2)}
    start = (min(xs) - 1, min(ys) - 1)
    outside, queue = {start}, deque([start])
    while queue:
        x, y = queue.popleft()
        for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
            if n in box and n not in outside and n not in cells:
                outside.add(n)
                queue.append(n)
    return box - outside


def brute_close(cells, passes=2):
    around = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    for _ in range(passes):
        cells = {(x + i, y + j) for x, y in cells for i, j in around}
    for _ in range(passes):
        cells = {(x, y) for x, y in cells if all((x + i, y + j) in cells for i, j in around)}
    return cells


def test_burned_area_against_flood_fill(spark):
    rng = random.Random(11)
    shapes = {"s": {(rng.randrange(16), rng.randrange(16)) for _ in range(90)}, "ring": {(x, y) for x in range(12) for y in range(12) if x in (0, 11) or y in (0, 11)},
              "spiral": {(x, y) for x in range(9) for y in range(9)} - {(4, 4), (4, 5), (5, 5), (6, 5), (6, 6), (7, 6), (8, 6), (2, 2)}}
    df = spark.createDataFrame([(k, x, y) for k, s in shapes.items() for x, y in s], "k string, x long, y long")
    filled, burned = {}, {}
    for r in R.fill_holes(df, ["k"]).collect():
        filled.setdefault(r.k, set()).add((r.x, r.y))
    for r in R.burned_area(df, ["k"]).collect():
        burned.setdefault(r.k, set()).add((r.x, r.y))
    for k, s in shapes.items():
        assert filled[k] == brute_fill(s), k
        assert burned[k] == brute_fill(brute_close(s)) | s, k


def test_category_shares(spark):
    pixels = [2] * 50 + [650] * 20 + [13] * 10 + [102] * 15 + [101] * 5
    table = spark.createDataFrame([(2, "conifer", 100), (650, "mixedwood", 50), (13, "deciduous", 0), (102, "water", None), (101, "non_fuel", None)], "code int, `group` string, percent int")
    s = R.category_shares(spark.createDataFrame([(c,) for c in pixels], "code int"), [], "code", table, ["conifer", "mixedwood", "water"]).first()
    assert (s.conifer_share, s.mixedwood_share, s.water_share, s.dominant_code, s.weighted_percent) == (0.5, 0.2, 0.15, 2, 75.0)


def test_elevation_planes(spark):
    plane = spark.createDataFrame([("w", r, c, 100.0 - 9.0 * r) for r in range(6) for c in range(5)], "w string, r int, c int, z double")
    got = R.slope_aspect(plane, ["w"], "r", "c", "z", 90.0).collect()
    assert all(x.slope_pct == pytest.approx(10) and x.aspect_deg == pytest.approx(180) for x in got)
    samples = spark.createDataFrame([("a", i, float(i % 3 * 10)) for i in range(9)] + [("b", i, 5.0 if i else None) for i in range(9)], "cell string, i int, z double")
    t = {r.cell: r for r in R.sample_terrain(samples, "cell", "i", "z", 10000.0).collect()}
    assert t["a"].slope_deg > 0 and t["a"].sample_count == 9 and t["a"].aspect_sin == pytest.approx(-1)
    assert t["b"].slope_deg is None and t["b"].sample_count == 8 and t["b"].elevation_mean == 5.0


def test_daily_codes_published_days(spark):
    days = [(17.0, 42.0, 25.0, 0.0), (20.0, 21.0, 25.0, 2.4), (8.5, 40.0, 17.0, 0.0), (6.5, 25.0, 6.0, 0.0), (13.0, 34.0, 24.0, 0.0)]
    want = [(87.7, 8.5, 19.0, 10.9, 8.5, 10.1), (86.2, 10.4, 23.6, 8.8, 10.4, 9.3), (87.0, 11.8, 26.1, 6.5, 11.7, 7.6), (88.8, 13.2, 28.2, 4.9, 13.1, 6.2), (89.1, 15.4, 31.5, 12.6, 15.3, 14.8)]
    df = spark.createDataFrame([("f", i, *d, 4) for i, d in enumerate(days)] + [("f", 90, None, 1.0, 1.0, 1.0, 4)], "f string, day int, temp double, rh double, wind double, rain double, month int")
    got = REC.daily_codes(df, ["f"], "day").orderBy("day").collect()
    assert len(got) == 5
    for row, expected in zip(got, want):
        assert (row.ffmc, row.dmc, row.dc, row.isi, row.bui, row.fwi) == pytest.approx(expected, abs=0.06)


def test_hourly_moisture_is_reseeded_and_matches_a_plain_loop(spark):
    rng = random.Random(4)
    hours = [("f", h, rng.uniform(5, 30), rng.uniform(20, 100), rng.uniform(0, 40), rng.choice([0.0, 0.0, 1.5]), h % 24, 70.0 + h // 24) for h in range(70)]
    df = spark.createDataFrame(hours, "f string, t int, temp double, rh double, wind double, rain double, hour int, code double")
    got = {r.t: r.ffmc for r in REC.hourly_ffmc(df, ["f"], "t", "hour", "code").collect()}
    previous = hours[0][7]
    for _, t, temp, rh, wind, rain, hour, code in hours:
        if hour == 16:
            previous = code
        else:
            step = one(spark, v=fire.next_hourly_ffmc(*[F.lit(v) for v in (temp, rh, wind, rain, previous)])) if t % 9 == 0 else None
            previous = got[t] if step is None else step.v
        assert got[t] == pytest.approx(previous)


def test_fuel_rates_and_ellipse(spark):
    df = spark.createDataFrame([(2, 10.0, 60.0, 180), (102, 10.0, 60.0, 180), (13, 10.0, 40.0, 180), (13, 10.0, 80.0, 180), (31, 10.0, 40.0, 120), (650, 10.0, 60.0, 180)], "code int, isi double, bui double, doy int")
    got = [r.ros for r in fire.with_spread_rate(df, "code", F.col("isi"), F.col("bui"), F.col("doy"), "ros").orderBy("code", "bui").collect()]
    conifer, green_low, green_dry, grass, water, mixed = got[0], got[1], got[2], got[3], got[4], got[5]
    assert conifer == pytest.approx(110 * (1 - math.exp(-0.282)) ** 1.5 * math.exp(50 * math.log(0.7) * (1 / 60 - 1 / 64)))
    assert (green_low, water) == (0.0, 0.0) and 0 < green_dry < mixed < conifer and grass > 0
    rate = lambda a: fire.directional_rate(F.lit(10.0), F.lit(2.0), F.lit(3.0), F.lit(a))
    r = one(spark, head=rate(0.0), back=rate(180.0), none=fire.directional_rate(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(10.0)), lb=fire.length_to_breadth(F.lit(0.0)))
    assert (r.head, r.back) == (pytest.approx(10), pytest.approx(2)) and (r.none, r.lb) == (0.0, 1.0)


def test_projection_round_trip_and_origin(spark):
    lcc = geo.ConformalConic()
    points = spark.createDataFrame([(-95.0, 49.0), (-84.85, 48.0), (-76.0, 56.5)], "lon double, lat double")
    x, y = lcc.project(F.col("lon"), F.col("lat"))
    placed = points.withColumns({"x": x, "y": y})
    lon, lat = lcc.unproject(F.col("x"), F.col("y"))
    rows = placed.withColumns({"lon2": lon, "lat2": lat}).collect()
    assert rows[0].x == pytest.approx(0, abs=1e-6) and rows[0].y == pytest.approx(0, abs=1e-6)
    assert all(r.lon2 == pytest.approx(r.lon, abs=1e-9) and r.lat2 == pytest.approx(r.lat, abs=1e-9) for r in rows)
    assert one(spark, c=geo.cell_origin(F.lit(-1.0), 10000)).c == -10000


def test_issue_instant_follows_daylight_saving(spark):
    days = spark.createDataFrame([(dt.date(2019, 7, 1),), (dt.date(2019, 1, 1),)], "d date")
    got = sorted(r.i for r in days.select(CAL.issue_instant(F.col("d")).alias("i")).collect())
    assert got == [dt.datetime(2019, 1, 1, 5), dt.datetime(2019, 7, 1, 4)]


def test_polygon_cover_holes_and_boundary(spark):
    ring = lambda pts, n: [("p", n, i, *map(float, (*a, *b))) for i, (a, b) in enumerate(zip(pts, pts[1:] + pts[:1]))]
    edges = ring([(0, 0), (10, 0), (10, 10), (0, 10)], 0) + ring([(4, 4), (4, 6), (6, 6), (6, 4)], 1)
    e = spark.createDataFrame(edges, "poly string, ring int, edge int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 0.0, 3.0), (4, 4.0, 5.0), (5, 11.0, 5.0), (6, 30.0, 5.0)], "point int, px double, py double")
    assert sorted(r.point for r in G.covered_points(p, e, "point", "poly", 3.0).collect()) == [1, 3, 4]
    assert {r.point: r.gap for r in G.points_near(p, e, "point", "poly", 3.0, 2.0).collect()} == {1: 0.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 1.0}
    s = G.polygon_summary(e, "poly", "ring").first()
    assert (s.area, s.centroid_x, s.centroid_y, s.rings) == (96.0, 5.0, 5.0, 2)


def test_regrid_propagates_unknowns(spark):
    native = spark.createDataFrame([(1, 0, 5), (2, 0, None), (3, 0, 2)], "n int, t int, v int")
    weights = spark.createDataFrame([("a", 1, 0.5), ("a", 3, 1.0), ("b", 1, 1.0), ("b", 2, 0.5), ("c", 2, 0.0), ("c", 3, 1.0)], "target string, n int, w double")
    assert {r.target: r.v for r in G.regrid(native, weights, ["t"], "target", "n", "v").collect()} == {"a": 4.5, "b": None, "c": 2.0}


def test_later_passes_leave_step_features_unchanged(spark):
    arrivals = [("f", x, y, s) for s in (1, 2, 3) for x in range(s * 3) for y in range(4)]
    seen = list({(f, x, y): (f, x, y, s) for f, x, y, s in reversed(arrivals)}.values())
    steps = spark.createDataFrame([("f", 1, 2)], "entity string, observation int, next_observation int")
    out = []
    for rows in (seen, [r for r in seen if r[3] <= 2]):
        start, fresh = T.step_cells(steps, spark.createDataFrame(rows, "entity string, x long, y long, first_session int"), "entity", "observation")
        active = T.active_edge(start, start, ["entity", "observation"])
        wind = start.select("entity", "observation").distinct().withColumn("downwind_deg", F.lit(90.0))
        out.append((sorted(map(tuple, fresh.collect())), sorted(map(tuple, T.candidate_features(start, active, ["entity", "observation"], 2, wind, 375.0).collect()))))
    assert out[0] == out[1] and len(out[0][0]) == 12


@pytest.mark.parametrize("whole", [1, 1 << 18])
def test_sessions_of_detections_at_one_time(spark, monkeypatch, whole):
    from panelspark.operators import ordered as O

    monkeypatch.setattr(O, "WHOLE", whole)
    rows = [(e, t, n) for e in (1, 2) for t in (0, 5, 5, 5, 30, 30, 36, 60, 60) for n in range(3)]
    got = S.sessionise(spark.createDataFrame([*rows, (None, 1, 0), (1, None, 0)], "e int, t int, n int").repartition(5), "e", "t", 10).collect()
    numbers = {0: 1, 5: 1, 30: 2, 36: 2, 60: 3}
    assert sorted((r.e, r.t, r.n, r.session) for r in got) == sorted((e, t, n, numbers[t]) for e, t, n in rows)


def test_session_summary_of_small_sessions_shuffles_the_points_once_for_four_reductions(spark):
    import re

    rows = [(e, t, 1, t % 3, t % 2, "D", "s") for e in range(4) for t in range(0, 400, 7)]
    points = S.sessionise(spark.createDataFrame(rows, "e int, t int, p int, cx int, cy int, c string, l string"), "e", "t", 10)
    seen = []
    real, S.checkpoint = S.checkpoint, lambda df: seen.append(df) or real(df)
    try:
        S.session_summary(points, "e", "session", "t", "p", "c", "l").collect()
    finally:
        S.checkpoint = real
    plan = seen[-1]._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(e#\d+, session#\d+[^,]*, \d+\), REPARTITION_BY_COL", plan)) >= 1
    assert not re.search(r"hashpartitioning\(e#\d+, session#\d+L?, (cx|cy|c|l|t)#", plan)
