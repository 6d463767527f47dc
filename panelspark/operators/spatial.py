"""Point-in-polygon, point-to-edge, morphology and area-weight operators on tables of edges and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.geo import crosses, point_segment_distance

EDGE = ("x1", "y1", "x2", "y2")


def ring_area(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Signed shoelace area per ring."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return edges.groupBy(*keys).agg((F.sum(cross) / 2).alias("signed_area"))


def polygon_summary(edges: DataFrame, poly: str, ring: str) -> DataFrame:
    """Bounds, planar area (outer ring 0 minus holes), centroid, and ring count per polygon."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = edges.groupBy(poly, ring).agg(
        F.sum(cross).alias("__a"),
        F.sum((F.col("x1") + F.col("x2")) * cross).alias("__cx"),
        F.sum((F.col("y1") + F.col("y2")) * cross).alias("__cy"),
        *[f(c).alias(n) for f, c, n in ((F.min, "x1", "west"), (F.min, "y1", "south"), (F.max, "x1", "east"), (F.max, "y1", "north"))],
    )
    # Orientation differs between sources: outer rings count positive, holes negative.
    sign = F.signum("__a") * F.when(F.col(ring) == 0, 1.0).otherwise(-1.0)
    total = F.sum(sign * F.col("__a"))
    return rings.groupBy(poly).agg(
        F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"), F.max("north").alias("north"),
        (total / 2).alias("area"),
        (F.sum(sign * F.col("__cx")) / (total * 3)).alias("centroid_x"),
        (F.sum(sign * F.col("__cy")) / (total * 3)).alias("centroid_y"),
        F.count(F.lit(1)).alias("rings"),
    )


def _band(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _candidates(points: DataFrame, edges: DataFrame, point: str, poly: str, size: float, margin: float) -> DataFrame:
    """(point, polygon) pairs whose bounding box, grown by `margin`, holds the point; met through lattice buckets."""
    box = edges.groupBy(poly).agg(F.min("x1").alias("__w"), F.max("x1").alias("__e"), F.min("y1").alias("__s"), F.max("y1").alias("__n"))
    span = lambda lo, hi: F.sequence(_band(F.col(lo) - margin, size), _band(F.col(hi) + margin, size))
    tiles = box.withColumn("__bx", F.explode(span("__w", "__e"))).withColumn("__by", F.explode(span("__s", "__n")))
    placed = points.withColumns({"__bx": _band(F.col("px"), size), "__by": _band(F.col("py"), size)})
    met = placed.join(tiles, ["__bx", "__by"])
    inside = F.col("px").between(F.col("__w") - margin, F.col("__e") + margin) & F.col("py").between(F.col("__s") - margin, F.col("__n") + margin)
    return met.where(inside).drop("__w", "__e", "__s", "__n", "__bx", "__by")


def _with_edges(pairs: DataFrame, edges: DataFrame, poly: str, size: float, margin: float) -> DataFrame:
    """Each pair with the polygon's edges whose height range, grown by `margin`, holds the point."""
    low, high = F.least("y1", "y2") - margin, F.greatest("y1", "y2") + margin
    banded = edges.select(poly, *EDGE).withColumn("__by", F.explode(F.sequence(_band(low, size), _band(high, size))))
    met = pairs.withColumn("__by", _band(F.col("py"), size)).join(banded, [poly, "__by"])
    return met.where(F.col("py").between(low, high)).drop("__by")


def _relation() -> tuple[Column, Column]:
    c = F.col
    distance = point_segment_distance(c("px"), c("py"), c("x1"), c("y1"), c("x2"), c("y2"))
    hit = crosses(c("px"), c("py"), c("x1"), c("y1"), c("x2"), c("y2"))
    return F.sum(hit), F.min(distance)


def covered_points(points: DataFrame, edges: DataFrame, point: str, poly: str, size: float) -> DataFrame:
    """(point, polygon) pairs where the polygon - holes excluded, boundary included - covers the point."""
    hits, near = _relation()
    pairs = _with_edges(_candidates(points, edges, point, poly, size, 0.0), edges, poly, size, 0.0)
    found = pairs.groupBy(point, poly).agg(hits.alias("__h"), near.alias("__d"))
    return found.where((F.col("__h") % 2 == 1) | (F.col("__d") <= 1e-9)).select(point, poly)


def points_near(points: DataFrame, edges: DataFrame, point: str, poly: str, size: float, buffer: float) -> DataFrame:
    """(point, polygon, gap) for points covered (gap 0) or within `buffer` of the boundary."""
    hits, near = _relation()
    pairs = _with_edges(_candidates(points, edges, point, poly, size, buffer), edges, poly, size, buffer)
    found = pairs.groupBy(point, poly).agg(hits.alias("__h"), near.alias("__d"))
    gap = F.when(F.col("__h") % 2 == 1, 0.0).otherwise(F.col("__d"))
    return found.withColumn("gap", gap).where(F.col("gap") <= buffer).select(point, poly, "gap")


def owned_points(points: DataFrame, edges: DataFrame, windows: DataFrame, point: str, poly: str, time: str, size: float, buffer: float) -> DataFrame:
    """One polygon per point: near it in space and inside its [start, end) window; the smallest gap wins.

    Adds `claims`, the number of polygons that qualified.
    """
    near = points_near(points.select(point, "px", "py"), edges, point, poly, size, buffer)
    timed = near.join(points.select(point, time), point).join(windows, poly)
    timed = timed.where((F.col(time) >= F.col("start")) & (F.col(time) < F.col("end")))
    return timed.groupBy(point).agg(
        F.min_by(F.col(poly), F.struct("gap", poly)).alias(poly), F.min("gap").alias("gap"), F.count(F.lit(1)).alias("claims")
    )


def polygon_relation(points: DataFrame, edges: DataFrame, point: str, poly: str) -> DataFrame:
    """Inside flag and distance to an already assigned polygon: 0 inside, NULL without a position."""
    met = points.select(point, poly, "px", "py").join(edges.select(poly, *EDGE), poly, "left")
    hits, near = _relation()
    found = met.groupBy(point).agg(hits.alias("__h"), near.alias("__d"))
    inside = (F.col("__h") % 2 == 1) | (F.col("__d") <= 1e-9)
    return found.select(point, inside.alias("inside"), F.when(inside, 0.0).otherwise(F.col("__d")).alias("distance"))


def regrid(native: DataFrame, weights: DataFrame, keys: list[str], target: str, source: str, value: str, weight: str = "w") -> DataFrame:
    """Area-weighted sums onto target cells; any unknown value with a positive weight makes the result NULL."""
    met = weights.join(native, source)
    unknown = F.max(((F.col(weight) > 0) & F.col(value).isNull()).cast("int")) == 1
    return met.groupBy(target, *keys).agg(F.when(~unknown, F.sum(F.col(weight) * F.col(value))).alias(value))


def square(radius: int) -> Column:
    return F.array(*[
        F.struct(F.lit(x).cast("long").alias("dx"), F.lit(y).cast("long").alias("dy"))
        for x in range(-radius, radius + 1) for y in range(-radius, radius + 1)
    ])


def moved(cells: DataFrame, keys: list[str], offsets: Column) -> DataFrame:
    """Every cell shifted by every offset."""
    return cells.withColumn("__o", F.explode(offsets)).select(
        *keys, (F.col("x") + F.col("__o.dx")).alias("x"), (F.col("y") + F.col("__o.dy")).alias("y")
    )


def dilate(cells: DataFrame, keys: list[str], radius: int = 1) -> DataFrame:
    return moved(cells, keys, square(radius)).distinct()


def erode(cells: DataFrame, keys: list[str], radius: int = 1) -> DataFrame:
    """Cells whose whole square neighbourhood is in the set."""
    full = (2 * radius + 1) ** 2
    counted = moved(cells.distinct(), keys, square(radius)).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias("__n"))
    return counted.where(F.col("__n") == full).select(*keys, "x", "y")


def edge_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.select(*keys, "x", "y").join(erode(cells, keys), [*keys, "x", "y"], "left_anti")


def neighbour_counts(cells: DataFrame, keys: list[str], radius: int, name: str) -> DataFrame:
    """How many cells of the set lie in the square block around each position."""
    return moved(cells, keys, square(radius)).groupBy(*keys, "x", "y").agg(F.count(F.lit(1)).alias(name))


def quadrature(cells: DataFrame, size: float) -> DataFrame:
    """Nine equal-area sample points per cell, ordered south to north, then west to east."""
    third = size / 3
    samples = [(i * 3 + j, dx, dy) for i, dy in enumerate((-third, 0.0, third)) for j, dx in enumerate((-third, 0.0, third))]
    offsets = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for n, dx, dy in samples])
    return cells.withColumn("__o", F.explode(offsets)).withColumns(
        {"sample": F.col("__o.n"), "sx": F.col("x") + size / 2 + F.col("__o.dx"), "sy": F.col("y") + size / 2 + F.col("__o.dy")}
    ).drop("__o")

