"""Past-only history, weather windows and stations: window edges, leakage and brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import intervals as I, panel as P, stations as S


@pytest.fixture(scope="module")
def grid(spark):
    return spark.createDataFrame([("a", 0, 0, -85.0, 48.0), ("b", 10000, -10000, -84.85, 48.0)], "cell string, x long, y long, lon double, lat double")


def history(spark, grid, events, first=0, last=60):
    panel = grid.select("cell", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    counts = spark.createDataFrame(events, "cell string, day int").groupBy("cell", "day").agg(F.count(F.lit(1)).alias("event_count"))
    own = P.past_history(panel, counts, "cell", "day", "event_count", [30], "same", recency=True)
    around = P.neighbourhood_counts(counts, grid, "cell", "day", "event_count", 10000)
    table = P.past_history(own, around, "cell", "day", "event_count", [30], "around")
    return {(r.cell, r.day): r for r in table.collect()}


def test_same_day_event_does_not_count_and_window_edges(spark, grid):
    rows = history(spark, grid, [("a", 5), ("a", 6)])
    assert (rows["a", 5].same_30d, rows["a", 5].same_censored, rows["a", 5].same_days_since) == (0, 1, None)
    assert (rows["a", 6].same_30d, rows["a", 6].same_censored, rows["a", 6].same_days_since) == (1, 0, 1)
    assert (rows["a", 35].same_30d, rows["a", 36].same_30d, rows["a", 37].same_30d) == (2, 1, 0)
    assert (rows["b", 6].same_30d, rows["b", 6].around_30d) == (0, 1)  # diagonal neighbour


def test_future_events_change_nothing_earlier(spark, grid):
    events = [("a", 5), ("b", 9), ("a", 20)]
    before, after = history(spark, grid, events), history(spark, grid, events + [("a", 30), ("b", 30), ("b", 31)])
    assert {k: v for k, v in before.items() if k[1] <= 30} == {k: v for k, v in after.items() if k[1] <= 30}


def test_seven_day_rain_needs_all_days(spark):
    rain = spark.createDataFrame([("a", d, 1.0) for d in range(1, 8)] + [("b", d, 1.0) for d in (1, 2, 3, 5, 6, 7)], "cell string, day int, rain double")
    issues = spark.createDataFrame([("a", 8), ("a", 9), ("b", 8), ("a", 100)], "cell string, day int")
    got = {(r.cell, r.day): (r.coverage_days, r.rain_7d) for r in P.complete_window_sum(rain, ["cell"], "day", "rain", 7, issues).collect()}
    assert got == {("a", 8): (7, 7.0), ("a", 9): (6, None), ("b", 8): (6, None), ("a", 100): (0, None)}


def test_first_valid_and_conflicts(spark):
    records = spark.createDataFrame([(1, 1, None, 10), (1, 2, 5.0, 11), (1, 3, 6.0, 12), (2, 4, 7.0, 13), (2, 5, None, 14), (3, 6, None, 15)], "station int, seq int, fwi double, temp int")
    kept = {r.station: (r.seq, r.temp) for r in S.first_valid(records, ["station"], "seq", "fwi").collect()}
    assert kept == {1: (2, 11), 2: (4, 13), 3: (6, 15)}
    counts = {r.station: (r.duplicates, r.conflicts) for r in S.duplicate_counts(records, ["station"], "seq", "fwi").collect()}
    assert counts == {1: (2, 2), 2: (1, 1), 3: (0, 0)}


def haversine(a, b):
    lon1, lat1, lon2, lat2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def places():
    rng = random.Random(3)
    cells = [(i, rng.uniform(-95, -80), rng.uniform(45, 55)) for i in range(30)]
    # A third of the stations share one small area.
    stations = [(i, *((rng.uniform(-90.1, -90), rng.uniform(50, 50.1)) if i % 3 == 0 else (rng.uniform(-96, -79), rng.uniform(44, 56))), rng.randrange(0, 60)) for i in range(240)]
    return cells, stations


def test_nearest_against_brute_force(spark, places):
    cells, stations = places
    c = spark.createDataFrame(cells, "cell int, lon double, lat double")
    s = spark.createDataFrame(stations, "station int, lon double, lat double, first_seen int")
    got = {(r.cell, r["rank"]): r.station for r in S.nearest(c, s, 4, "cell", "station", "first_seen").collect()}
    for cell, lon, lat in cells:
        want = sorted(stations, key=lambda x: (haversine((lon, lat), (x[1], x[2])), x[3], x[0]))[:4]
        assert [got[cell, i + 1] for i in range(4)] == [x[0] for x in want]


def serving(spark, cells, stations, first_day=5):
    c = spark.createDataFrame(cells, "cell int, lon double, lat double")
    s = spark.createDataFrame(stations, "station int, lon double, lat double, first_seen int")
    spans = S.as_of_nearest(c, s, 4, "cell", "station", first_day).collect()
    return {(cell, d): {r.station for r in spans if r.cell == cell and r.since <= d and (r.until is None or d < r.until)} for cell, *_ in cells for d in range(first_day, 61)}


def test_as_of_nearest_against_brute_force_and_future_stations(spark, places):
    cells, stations = places
    got = serving(spark, cells, stations)
    for cell, lon, lat in cells:
        for d in range(5, 61):
            known = [x for x in stations if x[3] <= d]
            want = sorted(known, key=lambda x: (haversine((lon, lat), (x[1], x[2])), x[3], x[0]))[:4]
            assert got[cell, d] == {x[0] for x in want}
    nearer = [(1000 + i, lon + 1e-4, lat, 40) for i, lon, lat in cells]
    later = serving(spark, cells, stations + nearer)
    assert {k: v for k, v in got.items() if k[1] < 40} == {k: v for k, v in later.items() if k[1] < 40}
    assert later[0, 40] != got[0, 40]


def test_weighted_means_skip_nulls(spark):
    served = spark.createDataFrame([(1, 0.5, 10.0, 1.0, 0, 0), (1, 2.0, 20.0, None, 1, 2), (1, 3.0, None, 9.0, 1, None), (2, 1.0, None, 4.0, 0, 0)], "cell int, distance_km double, fwi double, rain double, imputed int, status int")
    w = {r.cell: r for r in S.weighted_day(served, ["cell"], ["fwi", "rain"], "fwi", "imputed", "status").collect()}
    assert (w[1].station_count, w[1].nearest_km, w[1].missing, w[1].imputed_fraction, w[1].status_fraction) == (2, 0.5, 0, 0.5, 0.5)
    assert w[1].fwi == pytest.approx((10 + 20 / 4) / 1.25) and w[1].rain == 1.0
    assert (w[2].station_count, w[2].missing, w[2].nearest_km, w[2].fwi, w[2].rain) == (0, 1, None, None, None)


def test_interval_boundaries_and_noon_rain(spark):
    hour = 3600
    rows = spark.createDataFrame([("f", i * hour, float(i)) for i in range(6)], "site string, t long, v double")
    steps = spark.createDataFrame([("f", hour, int(3.5 * hour))], "site string, start long, end long")
    assert sorted(r.t for r in I.interval_join(steps, rows, ["site"], "t", 86400).collect()) == [2 * hour, 3 * hour]
    rain = spark.createDataFrame([("f", i * hour, 9.0 if i == 37 else 0.0) for i in range(72)], "site string, t long, rain double")
    noon = I.trailing_sum_at(rain, "site", "t", "rain", 24, 12, "r").orderBy("t").collect()
    assert [(r.t // 86400, r.r) for r in noon] == [(1, 0.0), (2, 9.0)]


def test_step_window_falls_back_to_next_then_last(spark):
    hourly = spark.createDataFrame([("f", t, t) for t in (0, 3600, 36000)], "site string, t long, v long")
    steps = spark.createDataFrame([("f", 0, 3600), ("f", 7200, 10800), ("f", 72000, 75600)], "site string, start long, end long")
    got = {(r.start, r.t) for r in I.step_rows(steps, hourly, ["site"], "t", 86400, ["v"]).collect()}
    assert got == {(0, 0), (7200, 36000), (72000, 36000)}


def test_dimension_join_fails_on_missing_or_repeated_key(spark, grid):
    facts = spark.createDataFrame([("a", 1), ("z", 2)], "cell string, v int")
    with pytest.raises(Exception, match="missing or repeated"):
        P.dimension_join(facts, grid, ["cell"]).collect()
    with pytest.raises(Exception, match="missing or repeated"):
        P.dimension_join(facts.where("cell = 'a'"), grid.union(grid), ["cell"]).collect()


def test_season_spine_has_1840_days(spark):
    span = spark.createDataFrame([(dt.date(2010, 1, 1), dt.date(2019, 12, 31))], "a date, b date")
    assert P.date_spine(span, F.col("a"), F.col("b"), "day", ((5, 1), (10, 31))).count() == 1840
