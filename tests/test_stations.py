"""Station search through a tree of boxes: the same stations as brute force, and candidates that do not grow with their number."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelspark.operators import stations as S


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))


def made(spark, n, seed=0, days=3000):
    """Half of the stations in one town, the others all over; a third of them seen on the first day."""
    rng = random.Random(seed)
    place = lambda i: (-79.4 + rng.gauss(0, 0.05), 43.7 + rng.gauss(0, 0.05)) if i % 2 else (rng.uniform(-95, -74), rng.uniform(42, 56))
    stations = [(i, *place(i), 0 if rng.random() < 1 / 3 else rng.randrange(1, days)) for i in range(n)]
    cells = [(i, rng.uniform(-95, -74), rng.uniform(42, 56)) for i in range(60)] + [(60 + i, -79.4 + rng.gauss(0, 0.05), 43.7 + rng.gauss(0, 0.05)) for i in range(20)] + [(80, 179.9, 10.0), (81, -179.9, -60.0)]
    return cells, stations, spark.createDataFrame(cells, "cell int, lon double, lat double"), spark.createDataFrame(stations, "station int, lon double, lat double, first_seen int")


@pytest.fixture(scope="module")
def some(spark):
    return made(spark, 700)


def test_leaves_cover_neighbours(spark, some):
    _, stations, _, df = some
    sizes = [r["count"] for r in S.leaves(df.withColumn("g", F.lit(0)), "station", "leaf", "g").groupBy("leaf").count().collect()]
    assert sum(sizes) == len(stations) and max(sizes) == S.LEAF and len(sizes) == -(-len(stations) // S.LEAF)


def test_nearest(spark, some):
    cells, stations, c, s = some
    got = {(r.cell, r["rank"]): r.station for r in S.nearest(c, s, 4, "cell", "station", "station").collect()}
    for cell, *at in cells:
        want = sorted(stations, key=lambda x: (km(at, x[1:3]), x[0]))[:4]
        assert [got[cell, i + 1] for i in range(4)] == [x[0] for x in want]


@pytest.mark.parametrize("first_day", [0, 1500])
def test_as_of_nearest(spark, some, first_day):
    cells, stations, c, s = some
    spans = {}
    for r in S.as_of_nearest(c, s, 4, "cell", "station", first_day).collect():
        spans.setdefault(r.cell, []).append(r)
    for day in {first_day, first_day + 1, 1700, 2500, 2999}:
        for cell, *at in cells[::5]:
            seen = sorted((x for x in stations if x[3] <= day), key=lambda x: (km(at, x[1:3]), x[3], x[0]))[:4]
            got = {r.station for r in spans[cell] if r.since <= day and (r.until is None or day < r.until)}
            assert got == {x[0] for x in seen}, (cell, day)


def test_few_early_stations_and_missing_places(spark):
    """Fewer stations than k on the first day leave no bound on distance; places without coordinates never serve."""
    rows = [(1, -80.0, 44.0, 5), (2, -81.0, 44.0, 0), (3, None, 44.0, 0), (4, 100.0, -44.0, 9)]
    s = spark.createDataFrame(rows, "station int, lon double, lat double, first_seen int")
    c = spark.createDataFrame([(1, -80.0, 44.1), (2, None, 1.0)], "cell int, lon double, lat double")
    got = sorted((r.cell, r.station, r.since, r.until) for r in S.as_of_nearest(c, s, 4, "cell", "station", 0).collect())
    assert got == [(1, 1, 5, None), (1, 2, 0, None), (1, 4, 9, None)]
    assert S.nearest(c, s.limit(0), 4, "cell", "station", "station").isEmpty()


def test_candidates_do_not_grow_with_the_stations(spark):
    """A hundred times the stations: about as many candidates a cell, in town and far from it."""

    def candidates(n, as_of):
        _, _, c, s = made(spark, n, seed=1)
        dealt = S.strata(s, 0, 4, "station") if as_of else s.withColumn("__stratum", F.lit(0))
        counted = S._candidates(c, dealt, 4, "cell", "station").groupBy("cell").count()
        return counted.agg(F.avg("count"), F.max("count")).first()

    few, many = candidates(400, False), candidates(40_000, False)
    assert many[0] < 2 * few[0] and many[0] < 400 and many[1] < 2500
    # Strata of first_seen, each twice as large as the one before, are searched one by one: a logarithm of the number.
    few, many = candidates(400, True), candidates(40_000, True)
    assert many[0] < 1600
