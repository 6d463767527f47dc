"""Distance transform and pyramid search against brute force, and how many candidates they meet."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import nearest as N


def brute(x, y, cells):
    return min(((u - x) ** 2 + (v - y) ** 2, u, v) for u, v in cells)


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(4)
    out = {"dense": {(rng.randrange(40), rng.randrange(30)) for _ in range(300)}, "thin": {(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(40)}, "one": {(63, -64)}}
    # Equal distances on both sides of a tile's border.
    return out | {"ties": {(63, 63), (64, 64), (60, 66), (66, 60), (60, 60)}}


def frame(spark, sets):
    return spark.createDataFrame([(k, x, y) for k, s in sets.items() for x, y in s], "k string, x int, y int")


@pytest.mark.parametrize("radius", [1, 5, 16, 40])
def test_candidates_within_a_radius(spark, sets, radius):
    got = {}
    for r in N.nearest_within(frame(spark, sets), ["k"], radius).collect():
        assert (r.x, r.y) not in got.setdefault(r.k, {})
        got[r.k][r.x, r.y] = (r.d2, r.near_x, r.near_y)
    for k, cells in sets.items():
        steps = range(-radius, radius + 1)
        reached = {(x + i, y + j) for x, y in cells for i in steps for j in steps if i * i + j * j <= radius * radius}
        assert set(got[k]) == reached
        for x, y in random.Random(1).sample(sorted(reached), min(400, len(reached))):
            assert got[k][x, y] == brute(x, y, cells), (k, x, y)
    unburned = N.candidate_cells(frame(spark, sets), ["k"], radius)
    assert unburned.where("burned_d2 = 0").isEmpty() and unburned.count() == sum(len(v) for v in got.values()) - sum(map(len, sets.values()))


def test_empty_set_and_repeated_cells(spark):
    none = spark.createDataFrame([], "k string, x int, y int")
    assert N.nearest_within(none, ["k"], 3).isEmpty() and N.pyramid(none, ["k"])[0].isEmpty()
    wanted = spark.createDataFrame([("a", 1, 2)], "k string, x int, y int")
    assert N.nearest_cell(wanted, none, ["k"]).collect()[0].near_d2 is None
    twice = spark.createDataFrame([("a", 0, 0)] * 2, "k string, x int, y int")
    assert N.nearest_within(twice, ["k"], 1).count() == 5
    assert [(r.near_x, r.near_d2) for r in N.nearest_cell(wanted.union(wanted), twice, ["k"]).collect()] == [(0, 5), (0, 5)]


@pytest.fixture(scope="module")
def hot():
    """One group with most of the cells and one cell far from all others; small and lone groups."""
    rng = random.Random(2)
    cells = [("hot", rng.randrange(60), rng.randrange(60), rng.randrange(5)) for _ in range(250)] + [("hot", 5000, 9000, 4), ("hot", -7000, 3, 2), ("b", 0, 0, 0), ("b", 700, 20, 1)]
    return list({(k, x, y): (k, x, y, o) for k, x, y, o in cells}.values())


def test_nearest_earlier_cell(spark, hot):
    df = spark.createDataFrame(hot, "k string, x long, y long, o int")
    for r in N.nearest_cell(df, df, ["k"], order="o").collect():
        earlier = [(x, y) for k, x, y, o in hot if k == r.k and o < r.o]
        assert (r.near_d2, r.near_x, r.near_y) == (brute(r.x, r.y, earlier) if earlier else (None, None, None))


@pytest.mark.parametrize("close, reach", [(8, None), (3, None), (8, 20)])
def test_nearest_cell_of_a_group(spark, hot, close, reach):
    df = spark.createDataFrame(hot, "k string, x long, y long, o int")
    wanted = spark.createDataFrame([(k, x, y) for k in ("hot", "b", "none") for x in (-50, 0, 31, 4000) for y in (5, 30, 8999)], "k string, x int, y int")
    rows = N.nearest_cell(wanted, df, ["k"], close=close, reach=reach).collect()
    assert len(rows) == wanted.count()
    for r in rows:
        cells = [(x, y) for k, x, y, _ in hot if k == r.k]
        want = brute(r.x, r.y, cells) if cells else (None, None, None)
        if reach and cells and want[0] > reach * reach:
            want = (None, None, None)
        assert (r.near_d2, r.near_x, r.near_y) == want


def test_a_far_cell_meets_few_candidates(spark):
    """A hot group of 40,000 cells with a far one: tiles and cells met do not grow with the group."""
    side = np.arange(200)
    xs, ys = (a.ravel().tolist() for a in np.meshgrid(side, side))
    cells = spark.createDataFrame([("hot", x, y, 1) for x, y in zip(xs, ys)] + [("hot", 100_000, 70_000, 0)], "k string, x int, y int, o int")
    wanted = spark.createDataFrame([("hot", 90_000, 70_000, 2), ("hot", 300, 300, 2), ("hot", 50, 50, 1), ("hot", 100, 100, 2)], "k string, x int, y int, o int")
    numbered = wanted.withColumn("__w", F.monotonically_increasing_id())
    levels = N.pyramid(cells, ["k"], "o")
    assert len(levels) == 8 and levels[-1].count() <= 4
    tiles = N.tile_candidates(numbered, levels, ["k"], "o")
    met = {(r.x, r.y): r["count"] for r in tiles.groupBy("x", "y").count().collect()}
    # Beside the far cell, outside of a corner, for one whose own group does not count, and inside of the block.
    assert met[90_000, 70_000] == 1 and met[50, 50] == 1 and met[300, 300] <= 4 and met[100, 100] <= 9
    got = {(r.x, r.y): (r.near_x, r.near_y) for r in N.nearest_cell(wanted, cells, ["k"], order="o").collect()}
    assert got == {(90_000, 70_000): (100_000, 70_000), (300, 300): (199, 199), (50, 50): (100_000, 70_000), (100, 100): (100, 100)}


def test_tiles_of_the_transform_are_bounded(spark):
    """A cell is sent to four tiles at most, so a hot group is spread over its tiles."""
    cells = spark.createDataFrame([("hot", x, y) for x in range(0, 640, 4) for y in range(0, 640, 4)], "k string, x int, y int")
    plan = N.nearest_within(cells, ["k"], 16)
    assert plan.count() > 409_600
    assert N.TILE >= 2 * 16


@pytest.mark.parametrize("paired", [0, 60, 1 << 9])
def test_earlier_cells_of_small_groups_are_met_in_pairs(spark, sets, monkeypatch, paired):
    monkeypatch.setattr(N, "PAIRED", paired)
    pyramids, real = [], N.pyramid
    monkeypatch.setattr(N, "pyramid", lambda *a, **o: pyramids.append(a) or real(*a, **o))
    wide = {"wide": {(-40000, 5), (40000, 5), (0, -40000)}, "far": {(-16000, -16000), (16000, 16000), (16000, -16000)}}
    placed = [(k, x, y, (x * 7 + y * 3) % 5) for k, s in (sets | wide).items() for x, y in s]
    df = spark.createDataFrame(placed, "k string, x int, y int, o int")
    earlier = lambda k, o: [(u, v) for kk, u, v, oo in placed if kk == k and oo < o]
    got = {(r.k, r.x, r.y): (r.near_d2, r.near_x, r.near_y) for r in N.nearest_cell(df, df, ["k"], order="o").collect()}
    assert got == {(k, x, y): brute(x, y, earlier(k, o)) if earlier(k, o) else (None, None, None) for k, x, y, o in placed}
    assert len(pyramids) == 1  # the wide group is never met in pairs
