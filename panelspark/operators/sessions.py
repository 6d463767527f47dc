"""Gap sessions of point detections, their summaries, and growth from one to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.functions.geo import bearing
from panelspark.operators.ordered import group_cuts, join_keys, neighbour, quantiles, running
from panelspark.operators.nearest import nearest_cell
from panelspark.session import checkpoint


def sessionise(points: DataFrame, entity: str, time: str, gap: float, session: str = "session") -> DataFrame:
    """Number the sessions 1..n of each entity: a step longer than `gap` starts a new one.

    Rows without an entity or a time are left out. A very busy entity is cut into pieces,
    so it is spread over many tasks; `time` is in seconds.
    """
    points = points.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
    cuts = group_cuts(points, [entity], time)
    stepped = neighbour(points, [entity], time, {"__before": time}, cuts=cuts)
    starts = stepped.withColumn("__start", (F.col("__before").isNull() | (F.col(time) - F.col("__before") > gap)).cast("long"))
    # Of rows at one time only one starts a session, and which one is not fixed: all of them take its number.
    return running(starts, [entity], time, {session: "__start"}, peers=True, cuts=cuts).drop("__before", "__start")


def arrival_cells(points: DataFrame, entity: str, session: str, cell_x: str = "cx", cell_y: str = "cy") -> DataFrame:
    """First session in which each cell of an entity was seen."""
    return points.groupBy(entity, F.col(cell_x).alias("x"), F.col(cell_y).alias("y")).agg(F.min(session).alias("first_session"))


def middle_times(points: DataFrame, entity: str, session: str, time: str) -> DataFrame:
    """Time of the middle row (index n div 2) of each session, whatever its size."""
    counted = points.groupBy(entity, session, time).agg(F.count(F.lit(1)).alias("__n"))
    cuts = group_cuts(counted, [entity, session], time, points)
    placed = running(counted, [entity, session], time, {"__upto": "__n"}, totals=True, cuts=cuts)
    target = F.floor(F.col("__upto_total") / 2)
    hit = (F.col("__upto") - F.col("__n") <= target) & (target < F.col("__upto"))
    return placed.where(hit).select(entity, session, F.col(time).alias("middle_time"))


def modal_value(points: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest."""
    counted = points.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    return counted.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(-F.col("__n"), F.col(value))).alias(name))


def session_summary(points: DataFrame, entity: str, session: str, time: str, power: str, category: str, label: str, *, written: bool = False) -> DataFrame:
    """One row per session: counts, cells, areas in cells, power, modal category, labels, middle time and hours.

    Distinct cells and labels are reduced to their own keys first; nothing is
    collected per session but the (few) distinct labels. Points that are not a
    `written` table are written first, as five reductions read them.
    """
    keys = [entity, session]
    points = points if written else checkpoint(points)
    if not group_cuts(points, keys, time):
        points = points.repartition(*keys)  # small sessions: four of the reductions and their joins share this shuffle
    cells = points.groupBy(*keys, "cx", "cy").agg(F.count(F.lit(1)).alias("__n"), F.sum(power).alias("__p"), F.max(power).alias("__m"))
    base = cells.groupBy(*keys).agg(
        F.sum("__n").alias("detections"), F.count(F.lit(1)).alias("cells_detected"), F.sum("__p").alias("power_total"), F.max("__m").alias("power_max")
    )
    arrivals = arrival_cells(points, entity, session).groupBy(entity, F.col("first_session").alias(session)).agg(F.count(F.lit(1)).alias("new_cells"))
    labels = points.select(*keys, label).distinct().groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(label)), "+").alias("labels"))
    table = base.join(arrivals, keys, "left").fillna(0, ["new_cells"])
    table = table.join(modal_value(points, keys, category, "category"), keys).join(labels, keys)
    table = checkpoint(table.join(middle_times(points, entity, session, time), keys))
    first = table.where(F.col(session) == 1).select(entity, F.col("middle_time").alias("__first"))
    cuts = group_cuts(table, [entity], session)
    table = running(table, [entity], session, {"cumulative_cells": "new_cells"}, cuts=cuts)
    table = neighbour(table, [entity], session, {"__previous": "middle_time"}, cuts=cuts)
    table = table.join(first, entity)
    return table.withColumns(
        {
            "hours_since_previous": (F.col("middle_time") - F.col("__previous")) / 3600,
            "hours_since_first": (F.col("middle_time") - F.col("__first")) / 3600,
        }
    ).drop("__previous", "__first")


def growth_offsets(points: DataFrame, entity: str, session: str, origin: DataFrame | None = None) -> DataFrame:
    """Each newly seen cell with the offset from the nearest cell seen earlier, in cells.

    Cells of an entity's first session are measured from `origin` (entity, ox, oy
    in cell units) when one is reported, and are left out otherwise. `reference`
    says which was used.
    """
    arrivals = checkpoint(arrival_cells(points, entity, session))  # both sides of the search
    # Only the cells of an entity's first session have no earlier one.
    found = nearest_cell(arrivals, arrivals, [entity], order="first_session").where("near_d2 is not null")
    from_cells = found.select(
        entity, F.col("first_session").alias(session), "x", "y",
        (F.col("x") - F.col("near_x")).cast("double").alias("dx"), (F.col("y") - F.col("near_y")).cast("double").alias("dy"),
        F.lit("earlier_detections").alias("reference"),
    )
    if origin is None:
        return from_cells
    starts = arrivals.groupBy(entity).agg(F.min("first_session").alias("__start"))
    from_origin = arrivals.join(starts, entity).where("first_session = __start").join(origin, entity).select(
        entity, F.col("first_session").alias(session), "x", "y",
        (F.col("x") + 0.5 - F.col("ox")).alias("dx"), (F.col("y") + 0.5 - F.col("oy")).alias("dy"), F.lit("reported_origin").alias("reference"),
    )
    return from_cells.unionByName(from_origin)


def growth_geometry(offsets: DataFrame, keys: list[str], size: float, quantile: float = 0.9) -> DataFrame:
    """Distance and direction of growth: mean, quantile and maximum distance, mean and head bearing, directionality."""
    measured = checkpoint(offsets.select(*keys, "dx", "dy", (F.hypot("dx", "dy") * size).alias("__d")))  # the search is behind both sides of the join
    cut = quantiles(measured, keys, "__d", {"distance_p90": quantile})
    joined = join_keys(measured, cut, keys)
    head = F.col("__d") >= F.col("distance_p90")
    table = joined.groupBy(*keys).agg(
        F.avg("__d").alias("distance_mean"), F.max("distance_p90").alias("distance_p90"), F.max("__d").alias("distance_max"),
        F.avg("dx").alias("__x"), F.avg("dy").alias("__y"), F.avg(F.when(head, F.col("dx"))).alias("__hx"), F.avg(F.when(head, F.col("dy"))).alias("__hy"),
    )
    length = F.hypot("__x", "__y") * size
    return table.withColumns(
        {
            "bearing": bearing(F.col("__x"), F.col("__y")), "head_bearing": bearing(F.col("__hx"), F.col("__hy")),
            "directionality": F.when(F.col("distance_mean") == 0, 0.0).otherwise(length / F.nullif(F.col("distance_mean"), F.lit(0.0))),
        }
    ).drop("__x", "__y", "__hx", "__hy")


def entity_summary(points: DataFrame, entity: str, session: str, time: str, reported: DataFrame, start_day: str, area_cells: str) -> DataFrame:
    """First and last time, first place, counts, share of the reported area seen, and lag from the reported start."""
    keyed = points.groupBy(entity).agg(
        F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.min_by(F.struct("x", "y"), F.struct(time, "id")).alias("__p"),
        F.count(F.lit(1)).alias("detections"), F.max(session).alias("sessions"),
    )
    seen = arrival_cells(points, entity, session).groupBy(entity).agg(F.count(F.lit(1)).alias("cells"))
    table = keyed.join(seen, entity).join(reported, entity)
    return table.select(
        entity, "first_time", "last_time", F.col("__p.x").alias("first_x"), F.col("__p.y").alias("first_y"), "detections", "sessions", "cells",
        (F.col("cells") / F.col(area_cells)).alias("detected_share"),
        (F.floor(F.col("first_time") / 86400) - F.col(start_day)).cast("long").alias("lag_days"),
    )


def trackable(summary: DataFrame, growth_steps: DataFrame, entity: str, min_steps: int = 3, min_share: float = 0.2) -> DataFrame:
    """Flag entities with enough growth steps and enough of the reported area seen."""
    joined = summary.join(growth_steps, entity, "left").fillna(0, ["growth_steps"])
    return joined.withColumn("trackable", (F.col("growth_steps") >= min_steps) & (F.coalesce(F.col("detected_share"), F.lit(0.0)) >= min_share))


def best_match(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, tie: str) -> DataFrame:
    """Left rows with the right row of the same key whose `b` is closest to `a`; a keyed aggregate, not a sort."""
    rest = [c for c in right.columns if c not in keys]
    met = left.join(right, keys, "left")
    gap = F.abs(F.col(a) - F.col(b))
    chosen = met.groupBy(*left.columns).agg(
        F.count(F.col(b)).alias("candidates"), F.min_by(F.struct(*rest), F.struct(gap.isNull(), gap, F.col(tie))).alias("__m")
    )
    return chosen.select(*left.columns, "candidates", *[F.col(f"__m.{c}").alias(c) for c in rest])
