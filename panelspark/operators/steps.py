"""Steps between consecutive observations, and features of the candidate cells of each step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.functions.geo import angle_between, bearing
from panelspark.operators.metrics import set_overlap
from panelspark.operators.ordered import neighbour
from panelspark.operators.ranking import top_k
from panelspark.operators.raster import burned_area
from panelspark.operators.sessions import growth_geometry
from panelspark.operators.nearest import candidate_cells, nearest_cell
from panelspark.operators.spatial import dilate, edge_cells, neighbour_counts
from panelspark.session import checkpoint


def consecutive_steps(observations: DataFrame, entity: str, number: str, time: str) -> DataFrame:
    """(entity, observation, next_observation, hours) where the next observation is the next number."""
    moved = neighbour(observations.select(entity, number, time), [entity], number, {"next_observation": number, "__t": time}, following=True)
    near = moved.where(F.col("next_observation") == F.col(number) + 1)
    return near.select(entity, number, "next_observation", ((F.col("__t") - F.col(time)) / 3600).alias("hours"))


def step_cells(steps: DataFrame, arrivals: DataFrame, entity: str, number: str, repair: bool = True) -> tuple[DataFrame, DataFrame]:
    """Cells burned by the start of each step (gaps closed, holes filled), and cells first seen at its end.

    The burned set of a step is every cell seen so far, so the output of a replay
    grows with steps x cells by definition.
    """
    known = arrivals.select(entity, "x", "y", "first_session")
    met = steps.select(entity, number, "next_observation").join(known, entity)
    detected = met.where(F.col("first_session") <= F.col(number)).select(entity, number, "x", "y")
    keys = [entity, number]
    start = checkpoint(burned_area(detected, keys) if repair else detected)
    fresh = met.where(F.col("first_session") == F.col("next_observation")).select(entity, number, "x", "y")
    return start, fresh.join(start, [*keys, "x", "y"], "left_anti")


def usable_steps(steps: DataFrame, fresh: DataFrame, entity: str, number: str, hours: tuple[float, float] = (6.0, 30.0), least: int = 5) -> DataFrame:
    counted = fresh.groupBy(entity, number).agg(F.count(F.lit(1)).alias("observed_new"))
    joined = steps.join(counted, [entity, number], "left").fillna(0, ["observed_new"])
    return joined.withColumn("usable", F.col("hours").between(*hours) & (F.col("observed_new") >= least))


def active_edge(start: DataFrame, recent: DataFrame, keys: list[str]) -> DataFrame:
    """Edge cells next to the latest detections; the whole edge where a step has none."""
    edge = checkpoint(edge_cells(start, keys))
    near = edge.join(dilate(recent, keys), [*keys, "x", "y"], "left_semi")
    rest = edge.join(near.select(*keys).distinct(), keys, "left_anti")
    return near.unionByName(rest)


def candidate_features(start: DataFrame, active: DataFrame, keys: list[str], radius: int, downwind: DataFrame, size: float, convergence: Column | float = 0.0) -> DataFrame:
    """Candidate cells with distances, wind-relative geometry and neighbourhood counts.

    `downwind` has the keys and `downwind_deg`. Offsets point from the nearest
    active cell.
    """
    cells = candidate_cells(start, keys, radius)
    placed = nearest_cell(cells, active, keys, close=radius)
    placed = placed.join(downwind, keys)
    east, north = F.col("x") - F.col("near_x"), F.col("y") - F.col("near_y")
    distance = F.sqrt(F.col("near_d2").cast("double")) * size
    toward = F.pmod(bearing(east.cast("double"), north.cast("double")) + convergence, F.lit(360.0))
    # On the front itself there is no direction; an unknown wind stays unknown.
    cosine = F.when(F.col("near_d2") == 0, F.lit(0.0)).otherwise(F.cos(F.radians(toward - F.col("downwind_deg"))))
    table = placed.withColumns(
        {"distance_to_burned": F.sqrt(F.col("burned_d2").cast("double")) * size, "distance_to_active": distance, "bearing_deg": toward, "downwind_cos": cosine}
    )
    table = table.withColumn("crosswind_sin", F.when(F.col("downwind_cos").isNotNull(), F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("downwind_cos") * F.col("downwind_cos")))))
    table = table.withColumns({"along_wind": F.col("distance_to_active") * F.col("downwind_cos"), "across_wind": F.col("distance_to_active") * F.col("crosswind_sin")})
    for cells_of, name in ((active, "active_nearby"), (start, "burned_nearby")):
        table = table.join(neighbour_counts(cells_of.select(*keys, "x", "y"), keys, 3, name), [*keys, "x", "y"], "left").fillna(0, [name])
    return table


def rise_from_front(cells: DataFrame, elevation: DataFrame, keys: list[str]) -> DataFrame:
    """Elevation gain from the nearest front cell, and the gain per metre (0 on the front)."""
    own = cells.join(elevation.select(*keys, "x", "y", "elevation"), [*keys, "x", "y"], "left")
    front = elevation.select(*keys, F.col("x").alias("near_x"), F.col("y").alias("near_y"), F.col("elevation").alias("__front"))
    met = own.join(front, [*keys, "near_x", "near_y"], "left").withColumn("rise", F.col("elevation") - F.col("__front")).drop("__front")
    d = F.col("distance_to_active")
    return met.withColumn("slope_from_front", F.when(d > 0, F.col("rise") / F.greatest(d, F.lit(1.0))).otherwise(0.0))


def previous_step(cells: DataFrame, history: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """What was known of the step's own observation, prefixed `previous_`; NULL when it is not on record."""
    return cells.join(history.select(*keys, *[F.col(c).alias(f"previous_{c}") for c in columns]), keys, "left")


def growth_shape(fresh: DataFrame, start: DataFrame, keys: list[str], size: float, prefix: str) -> DataFrame:
    """90th-percentile distance and head bearing of new cells from the nearest starting cell."""
    near = nearest_cell(fresh.select(*keys, "x", "y"), start, keys).where(F.col("near_d2").isNotNull())
    offsets = near.withColumns({"dx": (F.col("x") - F.col("near_x")).cast("double"), "dy": (F.col("y") - F.col("near_y")).cast("double")})
    shape = growth_geometry(offsets, keys, size)
    return shape.select(*keys, F.col("distance_p90").alias(f"{prefix}_distance"), F.col("head_bearing").alias(f"{prefix}_bearing"))


def even_growth(candidates: DataFrame, keys: list[str], distance: str, cell: str, sizes: DataFrame) -> DataFrame:
    """The k candidates nearest to the active edge, k = `sizes` (keys, k); equal distances in cell order."""
    scored = candidates.withColumn("__s", -F.col(distance))
    return top_k(scored, keys, "__s", cell, sizes).where("selected").drop("__s", "selected", "rank", "rank_min", "rank_max", "midrank", "group_size")


def score_steps(predicted: DataFrame, observed: DataFrame, start: DataFrame, candidates: DataFrame, keys: list[str], size: float) -> DataFrame:
    """Overlap, growth shape, direction error and the even-growth baseline of each step.

    `candidates` has the keys, x, y, a numeric `cell` order and `distance_to_active`.
    """
    table = set_overlap(predicted, observed, keys, ["x", "y"])
    for cells, prefix in ((observed, "observed"), (predicted, "predicted")):
        table = table.join(growth_shape(cells, start, keys, size, prefix), keys, "left")
    table = table.withColumn("direction_error", angle_between(F.col("predicted_bearing"), F.col("observed_bearing")))
    even = even_growth(candidates, keys, "distance_to_active", "cell", table.select(*keys, F.col("predicted").alias("k")))
    base = set_overlap(even, observed, keys, ["x", "y"]).select(*keys, F.col("iou").alias("even_iou"), F.col("recall").alias("even_recall"))
    return table.join(base, keys, "left")
