"""Nearest cells on a lattice: an exact distance transform within a radius, and a search through a pyramid of tiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.session import checkpoint

#: Cells along a side of a tile of the distance transform; a task holds one tile and its margin at a time.
TILE = 64
#: Side of the smallest tiles of the pyramid, and how many times larger each level's are.
LEAF, FACTOR = 8, 4
#: Cells of a group up to which every pair is compared, and bits of the offsets of such a pair.
PAIRED, BITS = 1 << 9, 16
FAR = np.iinfo(np.int64).max // 4


def _transformed(grid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distance to the nearest set cell, its column and its row, for the grid without a margin of `radius`.

    The first pass finds the nearest set cell within each row, the second the best of the
    rows within the radius. Among equals the cell with the smallest column, then row.
    """
    rows, width = grid.shape
    column = np.arange(width)
    left = np.maximum.accumulate(np.where(grid, column, -FAR), axis=1)
    right = np.minimum.accumulate(np.where(grid, column, FAR)[:, ::-1], axis=1)[:, ::-1]
    near = np.where(column - left <= right - column, left, right)
    inner = slice(radius, width - radius)
    near = near[:, inner]
    gap = np.minimum(np.abs(near - column[inner]), 2 * radius + 1)
    height = rows - 2 * radius
    best, at_x, at_y = np.full(gap[:height].shape, FAR), np.zeros_like(near[:height]), np.zeros_like(near[:height])
    for step in range(-radius, radius + 1):
        own = slice(radius + step, radius + step + height)
        d2, x = gap[own] ** 2 + step * step, near[own]
        better = (d2 < best) | (d2 == best) & (x < at_x)
        best, at_x = np.where(better, d2, best), np.where(better, x, at_x)
        at_y = np.where(better, np.arange(own.start, own.stop)[:, None], at_y)
    return best, at_x, at_y


def nearest_within(cells: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """(keys, x, y, d2, near_x, near_y) for every lattice position within `radius` cells of a set cell, the set's own (d2 = 0) included.

    Distances are Euclidean and exact. A cell is sent to the tiles that its radius reaches (2.25 rows a cell at a
    radius of 16), so a group of any size is spread over its tiles. Equal distances go to the smallest (x, y).
    """
    keys = list(keys)
    tiles = lambda c: F.explode(F.sequence(F.floor((F.col(c) - radius) / TILE), F.floor((F.col(c) + radius) / TILE)))
    placed = cells.select(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    placed = placed.withColumn("__tx", tiles("x")).withColumn("__ty", tiles("y"))
    schema = cells.select(*keys).schema
    for name in ("x", "y", "d2", "near_x", "near_y"):
        schema = schema.add(name, "long")

    def run(table: pa.Table) -> pa.Table:
        west, south = (table.column(c)[0].as_py() * TILE - radius for c in ("__tx", "__ty"))
        grid = np.zeros((TILE + 2 * radius, TILE + 2 * radius), dtype=bool)
        grid[table.column("y").to_numpy() - south, table.column("x").to_numpy() - west] = True
        d2, at_x, at_y = _transformed(grid, radius)
        y, x = np.nonzero(d2 <= radius * radius)
        own = table.select(keys).slice(0, 1).take(pa.array(np.zeros(len(x), dtype=np.int64)))
        numbers = (x + west + radius, y + south + radius, d2[y, x], at_x[y, x] + west, at_y[y, x] + south)
        return pa.table([*own.columns, *[pa.array(v.astype(np.int64)) for v in numbers]], names=[*keys, "x", "y", "d2", "near_x", "near_y"])

    return placed.groupBy(*keys, "__tx", "__ty").applyInArrow(run, schema)


def candidate_cells(burned: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """Unburned cells within `radius` cells of the burned set, with the squared distance to the nearest burned cell and its place."""
    found = nearest_within(burned, keys, radius).where(F.col("d2") > 0)
    return found.withColumnsRenamed({"d2": "burned_d2", "near_x": "burned_x", "near_y": "burned_y"})


def pyramid(cells: DataFrame, keys: Sequence[str], order: str | None = None) -> list[DataFrame]:
    """Summaries of the occupied tiles, by level from the smallest tiles up: (keys, tx, ty, box, first).

    `box` is the extent of a tile's cells and `first` its cell of the smallest order (then x, y). The
    tiles of the last level are as wide as the widest group, so that a group has four at most.
    """
    at = lambda c: F.floor(F.col(c) / LEAF).cast("long")
    first = F.struct((F.col(order) if order else F.lit(0)).alias("order"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    ends = {"west": F.min("x"), "east": F.max("x"), "south": F.min("y"), "north": F.max("y")}
    level = cells.groupBy(*keys, at("x").alias("tx"), at("y").alias("ty")).agg(F.min(first).alias("first"), F.struct(*[c.cast("long").alias(n) for n, c in ends.items()]).alias("box"))
    levels = [checkpoint(level)]
    span = levels[0].groupBy(*keys).agg(F.greatest(F.max("box.east") - F.min("box.west"), F.max("box.north") - F.min("box.south")).alias("s"))
    width, size = span.agg(F.max("s")).first()[0] or 0, LEAF
    while size <= width:
        size *= FACTOR
        up = lambda c: F.floor(F.col(c) / FACTOR).cast("long")
        ends = {"west": F.min("box.west"), "east": F.max("box.east"), "south": F.min("box.south"), "north": F.max("box.north")}
        level = levels[-1].groupBy(*keys, up("tx").alias("tx"), up("ty").alias("ty")).agg(F.min("first").alias("first"), F.struct(*[c.alias(n) for n, c in ends.items()]).alias("box"))
        levels.append(level)
    return levels


def _square(x: Column, y: Column) -> Column:
    return (x * x + y * y).cast("long")


def _promising(met: DataFrame, order: str | None) -> DataFrame:
    """Of the tiles met by each wanted cell, those that may hold its nearest cell: no farther than the surest cell of any."""
    x, y, box, first = F.col("x"), F.col("y"), F.col("box"), F.col("first")
    usable = met.where(first["order"] < F.col(order)) if order else met
    beyond = lambda v, low, high: F.greatest(low - v, v - high, F.lit(0))
    least = _square(beyond(x, box["west"], box["east"]), beyond(y, box["south"], box["north"]))
    # The tile's first cell is a cell that counts, so its distance is a bound on the nearest.
    sure = F.min(_square(x - first["x"], y - first["y"])).over(W.partitionBy("__w"))
    return usable.withColumns({"__least": least, "__sure": sure}).where("__least <= __sure").drop("__least", "__sure", "box", "first")


def tile_candidates(wanted: DataFrame, levels: list[DataFrame], keys: Sequence[str], order: str | None = None) -> DataFrame:
    """(wanted columns, tx, ty): the smallest tiles that may hold the nearest cell of each wanted row, numbered by `__w`.

    Searched from the largest tiles down: a row meets only the occupied tiles below those that stay promising.
    """
    keys, state = list(keys), _promising(wanted.join(levels[-1], list(keys)), order)
    for level in reversed(levels[:-1]):
        up = lambda c: F.floor(F.col(c) / FACTOR).cast("long")
        below = level.withColumns({"__px": up("tx"), "__py": up("ty")})
        state = _promising(state.withColumnsRenamed({"tx": "__px", "ty": "__py"}).join(below, [*keys, "__px", "__py"]).drop("__px", "__py"), order)
    return state


def _in_small_groups(wanted: DataFrame, cells: DataFrame, keys: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
    """`wanted` of the groups whose cells are few and close enough to be met in pairs, and of the others; None where there are none."""
    placed = cells.select(*keys, "x", "y", F.lit(1).alias("__c")).unionByName(wanted.select(*keys, "x", "y", F.lit(0).alias("__c")))
    span = lambda c: F.max(c) - F.min(c)
    sizes = placed.groupBy(*keys).agg(((F.sum("__c") <= PAIRED) & (F.greatest(span("x"), span("y")) < 1 << BITS - 1)).alias("__small"))
    small, large = sizes.agg(F.count(F.when(F.col("__small"), 1)), F.count(F.when(~F.col("__small"), 1))).first()
    if not large or not small:
        return (wanted, None) if not large else (None, wanted)
    sizes = checkpoint(sizes.where("__small").select(*keys))
    return wanted.join(sizes, keys, "left_semi"), wanted.join(sizes, keys, "left_anti")


def _nearest_of_pairs(wanted: DataFrame, cells: DataFrame, keys: list[str], order: str) -> DataFrame:
    """`nearest_cell` by meeting every cell of the group: distance and offset share one whole number, whose smallest is the answer."""
    half, c = 1 << BITS - 1, F.col
    other = cells.select(*keys, c("x").cast("long").alias("__x"), c("y").cast("long").alias("__y"), c(order).alias("__o"))
    met = wanted.withColumn("__w", F.monotonically_increasing_id()).join(other.withColumnsRenamed({k: f"__r_{k}" for k in keys}), [c(k) == c(f"__r_{k}") for k in keys] + [c("__o") < c(order)], "left")
    x, y = c("__x") - c("x"), c("__y") - c("y")
    packed = F.shiftleft(_square(x, y), 2 * BITS) + F.shiftleft((x + half).cast("long"), BITS) + (y + half)
    found = met.groupBy(*wanted.columns, "__w").agg(F.min(packed).alias("__p"))
    offset = lambda bits: F.shiftright("__p", bits).bitwiseAND(F.lit((1 << BITS) - 1).cast("long")) - half
    near = {"near_x": c("x").cast("long") + offset(BITS), "near_y": c("y").cast("long") + offset(0), "near_d2": F.shiftright("__p", 2 * BITS)}
    return found.withColumns(near).select(*wanted.columns, *near)


def nearest_cell(wanted: DataFrame, cells: DataFrame, keys: Sequence[str], *, order: str | None = None, reach: int | None = None, close: int = LEAF) -> DataFrame:
    """For each wanted cell, the nearest cell of the same group: adds `near_x`, `near_y`, `near_d2` (squared cells).

    With `order`, only cells whose `order` is smaller than the wanted cell's count
    (for growth: cells first seen earlier). Ties go to the smallest (x, y); NULL where no cell counts, or with `reach`
    none within it. Without `order`, cells within `close` are found by the distance transform; with it, groups of at most
    PAIRED cells are compared pair by pair. The rest search a pyramid of tile summaries, so the cells
    compared for each are those of a few smallest tiles, however large or far the group is.
    """
    keys, near = list(keys), ["near_x", "near_y", "near_d2"]
    if order is None:
        radius = reach or close
        close = nearest_within(cells, keys, radius).withColumnRenamed("d2", "near_d2")
        placed = wanted.withColumns({"__x": F.col("x").cast("long"), "__y": F.col("y").cast("long")})
        placed = placed.join(close.withColumnsRenamed({"x": "__x", "y": "__y"}), [*keys, "__x", "__y"], "left").select(*wanted.columns, *near)
        if reach:
            return placed
        placed = checkpoint(placed)
        done, rest = placed.where("near_d2 is not null"), placed.where("near_d2 is null").drop(*near)
    else:
        paired, rest = _in_small_groups(wanted, cells, keys)
        done = None if paired is None else _nearest_of_pairs(paired, cells, keys, order)
        if reach and done is not None:
            done = done.withColumns({n: F.when(F.col("near_d2") <= reach * reach, F.col(n)) for n in near})
        if rest is None:
            return done
    numbered = checkpoint(rest.withColumn("__w", F.monotonically_increasing_id()))
    tiles = tile_candidates(numbered.select("__w", *keys, "x", "y", *([order] if order else [])), pyramid(cells, keys, order), keys, order)
    at = lambda c: F.floor(F.col(c) / LEAF).cast("long")
    other = cells.select(*keys, F.col("x").cast("long").alias("__x"), F.col("y").cast("long").alias("__y"), at("x").alias("tx"), at("y").alias("ty"), *([F.col(order).alias("__o")] if order else []))
    met = tiles.join(other, [*keys, "tx", "ty"])
    met = met.where(F.col("__o") < F.col(order)) if order else met
    best = F.min(F.struct(_square(F.col("x") - F.col("__x"), F.col("y") - F.col("__y")).alias("near_d2"), F.col("__x").alias("near_x"), F.col("__y").alias("near_y")))
    found = numbered.join(met.groupBy("__w").agg(best.alias("__best")), "__w", "left")
    if reach:
        found = found.withColumn("__best", F.when(F.col("__best.near_d2") <= reach * reach, F.col("__best")))
    found = found.select(*wanted.columns, *[F.col(f"__best.{c}").alias(c) for c in near])
    return found if done is None else done.unionByName(found)
