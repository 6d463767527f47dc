"""Interval joins, as-of lookups, trailing windows and interval weather.

Series here have one row per entity and clock unit (hour, day, 3-hour bin) after
their own aggregation, so a window group is bounded by the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.geo import wind_from
from panelspark.operators.ordered import neighbour


def consecutive(points: DataFrame, entity: str, time: str) -> DataFrame:
    """(entity, start, end] intervals between consecutive distinct times."""
    times = points.select(entity, time).distinct()
    stepped = neighbour(times, [entity], time, {"start": time})
    return stepped.where("start is not null").select(entity, "start", F.col(time).alias("end"))


def interval_join(intervals: DataFrame, rows: DataFrame, keys: list[str], time: str, bucket: int, *, open_start: bool = True) -> DataFrame:
    """Rows with start < time <= end (or start <= time < end), met through time buckets so the join has equal keys."""
    block = lambda c: F.floor(c / bucket).cast("long")
    spread = intervals.withColumn("__b", F.explode(F.sequence(block(F.col("start")), block(F.col("end")))))
    met = spread.join(rows.withColumn("__b", block(F.col(time))), [*keys, "__b"])
    t = F.col(time)
    inside = (t > F.col("start")) & (t <= F.col("end")) if open_start else (t >= F.col("start")) & (t < F.col("end"))
    return met.where(inside).drop("__b")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], rule: str) -> DataFrame:
    """Look up `values` of `right` at each left time.

    Rules: `back` last row at or before; `next_or_last` exact, else the next row,
    else the last one; `last_or_first` the last row at or before, else the first.
    """
    wanted = left.select(*keys, time).distinct().withColumn("__need", F.lit(True))
    packed = right.select(*keys, time, F.struct(F.col(time).alias("__at"), *values).alias("__v"))
    merged = wanted.unionByName(packed, allowMissingColumns=True).groupBy(*keys, time).agg(F.max("__need").alias("__need"), F.max("__v").alias("__v"))
    order = W.partitionBy(*keys).orderBy(time)
    before = F.last("__v", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    after = F.first("__v", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing))
    found = {"back": before, "next_or_last": F.coalesce(after, before), "last_or_first": F.coalesce(before, after)}[rule]
    looked = merged.withColumn("__v", found).where("__need").select(*keys, time, F.col("__v.__at").alias("found_at"), *[F.col(f"__v.{v}").alias(v) for v in values])
    return left.join(looked, [*keys, time], "left")


def step_rows(steps: DataFrame, hourly: DataFrame, keys: list[str], time: str, bucket: int, values: list[str]) -> DataFrame:
    """Hourly rows in [start, end) of each step; a step without any gets the next row, else the last one."""
    ids = steps.columns
    inside = interval_join(steps, hourly.select(*keys, time, *values), keys, time, bucket, open_start=False)
    empty = steps.join(inside.select(*ids).distinct(), ids, "left_anti")
    fallback = as_of(empty.withColumn(time, F.col("start")), hourly, keys, time, values, "next_or_last").drop(time).withColumnRenamed("found_at", time)
    return inside.select(*ids, time, *values).unionByName(fallback.select(*ids, time, *values).where(F.col(time).isNotNull()))


def wind_summary(rows: DataFrame, keys: list[str], u: str, v: str, speed: str, more: dict[str, Column] | None = None) -> DataFrame:
    """Hours, mean wind vector, its direction and steadiness, and further aggregates; rows without wind are left out."""
    known = rows.where(F.col(u).isNotNull() & F.col(v).isNotNull() & F.col(speed).isNotNull())
    table = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hours"), F.avg(u).alias("wind_u"), F.avg(v).alias("wind_v"), F.avg(speed).alias("speed_mean"), F.max(speed).alias("speed_max"),
        *[c.alias(n) for n, c in (more or {}).items()],
    )
    return table.withColumns(
        {
            "direction": wind_from(F.col("wind_u"), F.col("wind_v")),
            "steadiness": F.when(F.col("speed_mean") > 0, F.hypot("wind_u", "wind_v") / F.nullif(F.col("speed_mean"), F.lit(0.0))),
        }
    )


def trailing_sum_at(hourly: DataFrame, entity: str, time: str, value: str, hours: int, at_hour: int, name: str) -> DataFrame:
    """Sum of the `hours` hours ending at the given hour of each day; rows without a full window are dropped."""
    window = W.partitionBy(entity).orderBy(time).rangeBetween(-(hours - 1) * 3600, 0)
    summed = hourly.withColumns({"__n": F.count(value).over(window), name: F.sum(value).over(window)})
    at = F.pmod(F.floor(F.col(time) / 3600), F.lit(24)) == at_hour
    return summed.where(at & (F.col("__n") == hours)).drop("__n")


def clip_to_entity(rows: DataFrame, bounds: DataFrame, entity: str, time: str) -> DataFrame:
    """Rows from the day before an entity's first time to two days after its last."""
    day = lambda c: F.floor(F.col(c) / 86400) * 86400
    met = rows.join(bounds.select(entity, day("first_time").alias("__lo"), day("last_time").alias("__hi")), entity)
    return met.where((F.col(time) >= F.col("__lo") - 86400) & (F.col(time) < F.col("__hi") + 2 * 86400)).drop("__lo", "__hi")


def short_spinup(daily: DataFrame, entity: str, counter: str, least: int) -> DataFrame:
    first = daily.groupBy(entity).agg(F.min(counter).alias("__c"))
    return first.agg(F.count(F.lit(1)).alias("entities"), F.count(F.when(F.col("__c") < least, 1)).alias("short"))


def complete_spine(counts: DataFrame, keys: list[str], bin_start: str, width: int) -> DataFrame:
    """Every bin between the first and last one, per key; a bin without a row counts as zero, an unknown stays NULL."""
    span = counts.agg(F.min(bin_start).alias("lo"), F.max(bin_start).alias("hi"))
    bins = F.sequence(span.select("lo").scalar(), span.select("hi").scalar(), F.lit(width).cast("long"))
    spine = counts.select(*keys).distinct().withColumn(bin_start, F.explode(bins))
    present = counts.withColumn("__seen", F.lit(True))
    values = [c for c in counts.columns if c not in (*keys, bin_start)]
    joined = spine.join(present, [*keys, bin_start], "left")
    return joined.withColumns({v: F.when(F.col("__seen").isNull(), F.lit(0)).otherwise(F.col(v)) for v in values}).drop("__seen")


def trailing_bins(spine: DataFrame, keys: list[str], bin_start: str, value: str, widths: list[int]) -> DataFrame:
    """Sums over the last w bins of a complete spine, NULL when any is unknown or fewer than w bins exist."""
    columns = {}
    for w in widths:
        window = W.partitionBy(*keys).orderBy(bin_start).rowsBetween(-(w - 1), 0)
        columns[f"{value}_{w}"] = F.when(F.count(value).over(window) == w, F.sum(value).over(window))
    return spine.withColumns(columns)


def last_complete_bin(issues: DataFrame, bins: DataFrame, issue: str, bin_end: str) -> DataFrame:
    """Latest bin end at or before each issue instant, with the lag in seconds (both sides are calendar-sized)."""
    ends = bins.select(F.col(bin_end).alias(issue)).distinct().withColumn("__k", F.lit(0)).withColumn("__e", F.col(issue))
    found = as_of(issues.withColumn("__k", F.lit(0)), ends, ["__k"], issue, ["__e"], "back")
    return found.select(*issues.columns, F.col("__e").alias(bin_end), (F.col(issue) - F.col("__e")).alias("lag_seconds"))
