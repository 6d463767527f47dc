"""Raster windows as pixel tables: coordinates, slope, zonal and category summaries, coarse means, burned area."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.operators.connect import labels
from panelspark.operators.ordered import join_keys, quantiles
from panelspark.operators.spatial import dilate, erode
from panelspark.session import checkpoint


def pixel_centres(pixels: DataFrame, row: str, col: str, west: Column, north: Column, size: float) -> DataFrame:
    return pixels.withColumns({"px": west + (F.col(col) + 0.5) * size, "py": north - (F.col(row) + 0.5) * size})


def slope_aspect(pixels: DataFrame, keys: list[str], row: str, col: str, value: str, size: float) -> DataFrame:
    """Slope in percent and down-slope bearing by central differences, one-sided at the window edges.

    A pixel row or column of a window is bounded by the raster width.
    """

    def gradient(along: str, across: str) -> Column:
        line = W.partitionBy(*keys, across).orderBy(along)
        back, ahead = F.lag(value).over(line), F.lead(value).over(line)
        return F.when(back.isNull(), (ahead - F.col(value)) / size).when(ahead.isNull(), (F.col(value) - back) / size).otherwise((ahead - back) / (2 * size))

    g = pixels.withColumns({"__south": gradient(row, col), "__east": gradient(col, row)})
    aspect = F.pmod(F.degrees(F.atan2(-F.col("__east"), F.col("__south"))), F.lit(360.0))
    return g.withColumns({"slope_pct": F.hypot("__east", "__south") * 100, "aspect_deg": aspect}).drop("__south", "__east")


def sample_terrain(samples: DataFrame, cell: str, sample: str, value: str, size: float) -> DataFrame:
    """Terrain of nine samples (0..8, south to north then west to east): mean, population ruggedness, coverage, and slope when all nine exist."""
    column, row = F.col(sample) % 3, F.floor(F.col(sample) / 3)
    side = lambda axis, at: F.avg(F.when(axis == at, F.col(value)))
    run = 2 * size / 3
    t = samples.groupBy(cell).agg(
        F.avg(value).alias("elevation_mean"), F.stddev_pop(value).alias("ruggedness"), F.count(value).alias("sample_count"), F.count(F.lit(1)).alias("__all"),
        ((side(column, 2) - side(column, 0)) / run).alias("__dx"), ((side(row, 2) - side(row, 0)) / run).alias("__dy"),
    )
    full = F.col("sample_count") == 9
    # Flat ground reads as a bearing of half a turn (sine 0, cosine -1).
    flat = (F.col("__dx") == 0) & (F.col("__dy") == 0)
    aspect = F.atan2(-F.col("__dx"), -F.col("__dy"))
    return t.select(
        cell, "elevation_mean", "ruggedness", "sample_count", (F.col("sample_count") / F.col("__all")).alias("coverage_fraction"),
        F.when(full, F.degrees(F.atan(F.hypot("__dx", "__dy")))).alias("slope_deg"),
        F.when(full, F.when(flat, 0.0).otherwise(F.sin(aspect))).alias("aspect_sin"), F.when(full, F.when(flat, -1.0).otherwise(F.cos(aspect))).alias("aspect_cos"),
    )


def category_shares(pixels: DataFrame, keys: list[str], code: str, table: DataFrame, groups: list[str]) -> DataFrame:
    """Share of each group, unknown share, weighted percent and most common burnable code, long pixels to one wide row.

    `table` has code, group, percent (NULL: not burnable). Pixels are reduced to
    one row per code before anything else.
    """
    counted = pixels.groupBy(*keys, code).agg(F.count(F.lit(1)).alias("__n")).join(table.withColumnRenamed("code", code), code, "left")
    n = F.col("__n")
    shares = [(F.sum(F.when(F.col("group") == g, n).otherwise(0)) / F.sum(n)).alias(f"{g}_share") for g in groups]
    burnable = F.col("percent").isNotNull()
    return counted.groupBy(*keys).agg(
        F.sum(n).alias("cells"), *shares, (F.sum(F.when(F.col("group").isNull(), n).otherwise(0)) / F.sum(n)).alias("unknown_share"),
        (F.sum(F.when(burnable, n * F.col("percent"))) / F.sum(F.when(burnable, n))).alias("weighted_percent"),
        F.max_by(F.col(code), F.when(burnable, F.struct(n, F.col(code)))).alias("dominant_code"),
    )


def zone_terrain(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, range, mean slope, exact 90th percentile slope and slope-weighted circular mean aspect per zone."""
    radians, weight = F.radians("aspect_deg"), F.col("slope_pct")
    table = pixels.groupBy(*keys).agg(
        F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"), F.avg(weight).alias("slope_mean"),
        F.avg(F.degrees(F.atan(weight / 100))).alias("slope_mean_deg"),
        (F.sum(F.sin(radians) * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias("aspect_sin"),
        (F.sum(F.cos(radians) * weight) / F.nullif(F.sum(weight), F.lit(0.0))).alias("aspect_cos"),
    )
    return join_keys(table, quantiles(pixels, keys, "slope_pct", {"slope_p90": 0.9}), keys)


def block_mean(pixels: DataFrame, keys: list[str], size: float, values: dict[str, Column]) -> DataFrame:
    """Means of fine pixels over the coarse cell holding their centre."""
    index = lambda c: F.floor(F.col(c) / size).cast("long")
    return pixels.groupBy(*keys, index("px").alias("x"), index("py").alias("y")).agg(*[F.avg(c).alias(n) for n, c in values.items()])


def closed(cells: DataFrame, keys: list[str], passes: int = 2) -> DataFrame:
    """Gaps bridged by dilating and then eroding `passes` times, on an unbounded lattice."""
    grown = cells.select(*keys, "x", "y").distinct()
    for _ in range(passes):
        grown = dilate(grown, keys)
    for _ in range(passes):
        grown = erode(grown, keys)
    return grown


#: Columns of a tile in which runs of adjacent rows meet.
STRIP = 64


def fill_holes(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells plus every empty cell that cannot reach the outside through edge-adjacent empty cells.

    Each row of a set becomes its runs of empty cells between set cells. Runs that touch in adjacent rows are connected, and
    those that face the outside are connected with it (node 0); runs of other components are holes. Runs,
    not cells, are joined, by strips of STRIP columns, and labelled in rounds that grow with the
    logarithm of the longest way out. Runs that touch nothing are settled without a round.
    """
    order = W.partitionBy(*keys, "y").orderBy("x")
    stepped = cells.select(*keys, "x", "y").distinct().withColumn("__before", F.lag("x").over(order))
    runs = stepped.where(F.col("x") - F.col("__before") > 1).select(*keys, "y", (F.col("__before") + 1).alias("lo"), (F.col("x") - 1).alias("hi"))
    runs = checkpoint(runs.withColumn("node", F.monotonically_increasing_id() + 1))
    rows = cells.groupBy(*keys, "y").agg(F.min("x").alias("__w"), F.max("x").alias("__e"))
    faced = runs.withColumn("__y", F.explode(F.array(F.col("y") - 1, F.col("y") + 1)))
    beside = faced.join(rows.withColumnRenamed("y", "__y"), [*keys, "__y"], "left")
    out = F.col("__w").isNull() | (F.col("lo") < F.col("__w")) | (F.col("hi") > F.col("__e"))
    open_ = beside.where(out).select(F.lit(0).cast("long").alias("a"), F.col("node").alias("b")).distinct()
    strips = runs.withColumn("__s", F.explode(F.sequence(F.floor(F.col("lo") / STRIP), F.floor(F.col("hi") / STRIP))))
    above = strips.select(*keys, "__s", (F.col("y") - 1).alias("y"), F.col("node").alias("b"), F.col("lo").alias("__lo"), F.col("hi").alias("__hi"))
    touching = strips.join(above, [*keys, "y", "__s"]).where((F.col("__lo") <= F.col("hi")) & (F.col("lo") <= F.col("__hi"))).select(F.col("node").alias("a"), "b")
    edges = checkpoint(touching.unionByName(open_).distinct())
    joined = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    reached = labels(joined, edges).where("label = 0").select("node")
    holes = runs.join(reached, "node", "left_anti").withColumn("x", F.explode(F.sequence("lo", "hi"))).select(*keys, "x", "y")
    return cells.select(*keys, "x", "y").union(holes).distinct()


def burned_area(detected: DataFrame, keys: list[str], passes: int = 2) -> DataFrame:
    """Detected cells with gaps closed and holes filled."""
    shape = checkpoint(closed(detected, keys, passes))
    return fill_holes(shape, keys).union(detected.select(*keys, "x", "y")).distinct()
