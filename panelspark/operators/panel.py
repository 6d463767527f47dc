"""Cell-day labels, the dense panel, and strictly-past event history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.clean import in_season
from panelspark.operators.ordered import join_keys


def cell_day_labels(events: DataFrame, cell: str, day: str, large: Column) -> DataFrame:
    """Any-event flag, event count and any-large flag per cell and day (partial aggregation before the shuffle)."""
    return events.groupBy(cell, day).agg(
        F.lit(1).cast("int").alias("label"),
        F.count(F.lit(1)).alias("event_count"),
        F.max(large.cast("int")).alias("large_label"),
    )


def date_spine(cells: DataFrame, first: Column, last: Column, day: str, season: tuple | None = None) -> DataFrame:
    """One row per input row and calendar day of [first, last], optionally only in season."""
    dense = cells.withColumn(day, F.explode(F.sequence(first, last)))
    return dense.where(in_season(F.col(day), *season)) if season else dense


def dense_panel(cells: DataFrame, labels: DataFrame, cell: str, day: str, first: Column, last: Column, season: tuple | None = None) -> DataFrame:
    """Every cell on every day with zero-filled labels, without a shuffle of the dense rows.

    A cell's labels - at most one per calendar day - are packed into a map next to
    the cell; its days are then generated and looked up in place. Cells are spread
    over tasks first, so a small dimension still fills the cluster.
    """
    names = ["label", "event_count", "large_label"]
    packed = labels.groupBy(cell).agg(F.map_from_entries(F.collect_list(F.struct(F.col(day), F.struct(*names)))).alias("__held"))
    spread = cells.repartition(F.col(cell)).join(packed, cell, "left")
    panel = date_spine(spread, first, last, day, season).withColumn("__v", F.try_element_at("__held", F.col(day)))
    types = dict(labels.dtypes)
    return panel.withColumns({n: F.coalesce(F.col(f"__v.{n}"), F.lit(0).cast(types[n])) for n in names}).drop("__held", "__v")


def candidate_grid(extent: DataFrame, size: int) -> DataFrame:
    """All cell origins over each row's (min_x, min_y, max_x, max_y)."""
    snap = lambda c: (F.floor(F.col(c) / size) * size).cast("long")
    step = F.lit(size).cast("long")
    columns = extent.withColumn("x", F.explode(F.sequence(snap("min_x"), snap("max_x"), step)))
    return columns.withColumn("y", F.explode(F.sequence(snap("min_y"), snap("max_y"), step)))


def grid_membership(candidates: DataFrame, covered: DataFrame, event_cells: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose centre is covered, plus every cell that holds an event."""
    return candidates.join(covered.select(*keys), keys, "left_semi").select(*keys).union(event_cells.select(*keys)).distinct()


def lattice(radius: int) -> Column:
    """Array of the (dx, dy) offsets of a square neighbourhood."""
    steps = range(-radius, radius + 1)
    return F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx in steps for dy in steps])


def neighbourhood_counts(counts: DataFrame, cells: DataFrame, cell: str, day: str, count: str, size: int) -> DataFrame:
    """Daily counts summed over the 3x3 block of existing cells around each cell."""
    placed = counts.join(cells.select(cell, "x", "y"), cell).select("x", "y", day, count)
    spread = placed.withColumn("o", F.explode(lattice(1))).select(
        (F.col("x") + F.col("o.dx") * size).alias("x"), (F.col("y") + F.col("o.dy") * size).alias("y"), day, count
    )
    summed = spread.groupBy("x", "y", day).agg(F.sum(count).alias(count))
    return summed.join(cells.select(cell, "x", "y"), ["x", "y"]).select(cell, day, count)


def past_histories(panel: DataFrame, series: dict[str, tuple[DataFrame, list[int]]], cell: str, day: str, count: str, recency: tuple[str, ...] = ()) -> DataFrame:
    """Event counts in [t-L, t-1] for each series = {prefix: (counts, lookbacks)}, and days since the last earlier event.

    Each `counts` has one row per cell and event day, so however many events a
    cell has, its window group is bounded by the calendar. Panel and event rows
    share one table and all windows one sort: the dense panel is shuffled once and
    never joined. A lookback is the difference of two running totals, so its cost
    does not grow with its length. `day` is a whole day number or a date; the issue day itself
    never counts.
    """
    number = F.unix_date(F.col(day)) if dict(panel.dtypes)[day] == "date" else F.col(day)
    merged = panel.withColumn("__need", F.lit(True))
    for prefix, (counts, _) in series.items():
        merged = merged.unionByName(counts.select(cell, day, F.col(count).alias(f"__n_{prefix}")), allowMissingColumns=True)
    merged = merged.withColumn("__t", number.cast("long"))
    order = W.partitionBy(cell).orderBy("__t")
    columns = {}
    for prefix, (_, spans) in series.items():
        n = F.col(f"__n_{prefix}")
        until = lambda back: F.coalesce(F.sum(n).over(order.rangeBetween(W.unboundedPreceding, -back)), F.lit(0)).cast("long")  # noqa: E731,B023
        columns |= {f"{prefix}_{s}d": until(1) - until(s + 1) for s in spans}
        if prefix in recency:
            last = F.max(F.when(n > 0, F.col("__t"))).over(order.rangeBetween(W.unboundedPreceding, -1))
            columns |= {f"{prefix}_days_since": F.col("__t") - last, f"{prefix}_censored": last.isNull().cast("int")}
    kept = [*panel.columns, *columns]
    return merged.withColumns(columns).where("__need").select(*kept)


def past_history(panel: DataFrame, counts: DataFrame, cell: str, day: str, count: str, windows: list[int], prefix: str, recency: bool = False) -> DataFrame:
    """`past_histories` of one series."""
    return past_histories(panel, {prefix: (counts, windows)}, cell, day, count, (prefix,) if recency else ())


def required_days(issues: DataFrame, day: str, length: int) -> DataFrame:
    """Distinct days any issue day looks back on (t-1 ... t-length); a calendar-sized table to restrict sources with."""
    days = issues.select(day).distinct().withColumn("__past", F.explode(F.sequence(F.lit(1), F.lit(length))))
    return days.select((F.col(day) - F.col("__past")).alias(day)).distinct()


def complete_window_sum(series: DataFrame, keys: list[str], day: str, value: str, length: int, issues: DataFrame) -> DataFrame:
    """Sum over the `length` calendar days before each issue day, NULL unless all are present, plus the day count.

    `series` has one row per key and day. The frame is by day number, so a season
    gap simply leaves days missing; both tables are shuffled once and not expanded.
    """
    merged = issues.select(*keys, day).withColumn("__need", F.lit(True)).unionByName(
        series.select(*keys, day, F.col(value).alias("__v")), allowMissingColumns=True
    )
    frame = W.partitionBy(*keys).orderBy(day).rangeBetween(-length, -1)
    summed = merged.withColumns({"coverage_days": F.count("__v").over(frame), "__s": F.sum("__v").over(frame)}).where("__need")
    return summed.select(*keys, day, "coverage_days", F.when(F.col("coverage_days") == length, F.col("__s")).alias(f"{value}_{length}d"))


def prior_day(panel: DataFrame, observations: DataFrame, keys: list[str], day: str, lag: int = 1) -> DataFrame:
    """Left join of the observation dated exactly `lag` days earlier; adds its own date as `observation_day`."""
    moved = observations.withColumn("observation_day", F.col(day)).withColumn(day, F.col(day) + lag)
    return panel.join(moved, [*keys, day], "left")


def leakage_violations(panel: DataFrame, day: str, observation_day: str = "observation_day") -> DataFrame:
    late = F.col(observation_day) >= F.col(day)
    return panel.agg(F.count(F.when(late, 1)).alias("violations"), F.count(observation_day).alias("available"), F.count(F.lit(1)).alias("rows"))


def dimension_join(fact: DataFrame, dimension: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that fails the job when the dimension repeats a key or misses one."""
    once = dimension.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__copies"), *[F.first(c).alias(c) for c in dimension.columns if c not in keys]
    )
    joined = join_keys(fact, once, keys, "left")
    proof = F.when(F.col("__copies") == 1, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("dimension key missing or repeated: "), F.to_json(F.struct(*keys)))).cast("boolean")
    )
    return joined.where(proof).drop("__copies")


def alignment(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys missing on the right, and extra on the right, in one row."""
    a = left.select(*keys).distinct().withColumn("__l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("__r", F.lit(1))
    both = a.unionByName(b, allowMissingColumns=True).groupBy(*keys).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))
    return both.agg(F.count(F.when(F.col("__r").isNull(), 1)).alias("missing"), F.count(F.when(F.col("__l").isNull(), 1)).alias("extra"))


def label_reproduction(events: DataFrame, panel: DataFrame, cell: str, day: str, label: str = "label") -> DataFrame:
    """Rebuild labels from events and count panel rows (or event days) that disagree."""
    rebuilt = events.groupBy(cell, day).agg(F.count(F.lit(1)).alias("__events"))
    both = panel.select(cell, day, label).join(rebuilt, [cell, day], "full")
    wrong = F.coalesce(F.col(label), F.lit(-1)) != (F.coalesce(F.col("__events"), F.lit(0)) > 0).cast("int")
    return both.agg(F.count(F.lit(1)).alias("keys_compared"), F.count(F.when(wrong, 1)).alias("mismatches"))
