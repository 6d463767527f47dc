"""Station records: first-valid dedup, registry, nearest and as-of nearest stations, weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.functions.geo import EARTH_KM, distance_km
from panelspark.operators.ordered import join_keys, neighbour, running
from panelspark.session import checkpoint

#: Places in a leaf, and nodes of a level in a node of the next.
LEAF = 16
#: Bits of a coordinate on the curve that orders places.
BITS = 20


def first_valid(records: DataFrame, keys: list[str], seq: str, valid: str) -> DataFrame:
    """One record per key: the first in source order, replaced once if its `valid` column is NULL and a later one's is not.

    Source order must be an explicit column. The reduction is a plain aggregate,
    so repeated keys are combined before the shuffle.
    """
    rest = [c for c in records.columns if c not in keys]
    chosen = records.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(F.col(valid).isNull(), F.col(seq))).alias("__r"))
    return chosen.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def duplicate_counts(records: DataFrame, keys: list[str], seq: str, valid: str) -> DataFrame:
    """Per key: surplus rows, and surplus rows whose `valid` differed from the value resolved before them.

    The value resolved before a row is NULL until the first non-NULL one and that
    one afterwards, so a second pass over the rows against the resolved value is
    enough and no group is ever ordered in one task.
    """
    solved = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"),
        F.min(seq).alias("__first"),
        F.min(F.when(F.col(valid).isNotNull(), F.col(seq))).alias("__at"),
        F.min_by(F.col(valid), F.when(F.col(valid).isNotNull(), F.col(seq))).alias("__value"),
    )
    joined = join_keys(records.select(*keys, seq, valid), solved, keys)
    late = F.col(seq) > F.col("__at")
    conflict = (late & ~F.col(valid).eqNullSafe(F.col("__value"))) | ((F.col(seq) == F.col("__at")) & (F.col("__at") > F.col("__first")))
    return joined.groupBy(*keys).agg(
        (F.max("__n") - 1).alias("duplicates"), F.count(F.when(conflict, 1)).alias("conflicts")
    )


def backward_dates(records: DataFrame, seq: str, day: str) -> DataFrame:
    """Rows dated before the row preceding them in source order; of rows with one place in that order the earlier dated comes first."""
    with_previous = neighbour(records.select(seq, day), [], seq, {"previous_day": day}, ties=[day])
    return with_previous.where(F.col(day) < F.col("previous_day"))


def registry(records: DataFrame, station: str, day: str) -> DataFrame:
    """First observed day of each station."""
    return records.groupBy(station).agg(F.min(day).alias("first_seen"))


def buffered_extent_filter(rows: DataFrame, extent_of: DataFrame, lon: str = "lon", lat: str = "lat", buffer: float = 5.0) -> DataFrame:
    """Rows inside another table's bounding box grown by `buffer` degrees (a one-row scalar subquery)."""
    box = extent_of.agg(F.min(lon).alias("w"), F.max(lon).alias("e"), F.min(lat).alias("s"), F.max(lat).alias("n"))
    edge = lambda c: box.select(c).scalar()
    return rows.where(
        F.col(lon).between(edge("w") - buffer, edge("e") + buffer) & F.col(lat).between(edge("s") - buffer, edge("n") + buffer)
    )


def _curve() -> Column:
    """Place along the curve that visits each quarter of the map, and of each quarter, in turn: the interleaved bits of both coordinates."""

    def spread(c: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask))
        return c

    step = lambda v, low, width: F.greatest(F.lit(0), F.least(F.lit((1 << BITS) - 1), F.floor((F.col(v) - low) / width * (1 << BITS)))).cast("long")
    return spread(step("lon", -180.0, 360.0)).bitwiseOR(F.shiftleft(spread(step("lat", -90.0, 180.0)), 1))


def leaves(places: DataFrame, key: str, name: str, group: str) -> DataFrame:
    """`places` with the number of its leaf: LEAF neighbours along the curve of its group, so dense regions have small leaves."""
    ranked = running(places.withColumns({"__curve": _curve(), "__one": F.lit(1)}), [group], "__curve", {"__place": "__one"}, ties=[key])
    return ranked.withColumn(name, F.floor((F.col("__place") - 1) / LEAF).cast("long")).drop("__curve", "__one", "__place")


def strata(stations: DataFrame, first_day: int, k: int, station: str) -> DataFrame:
    """`stations` with `__stratum`: 0 for those seen by `first_day`, then 1, 2, ... by order of first_seen, each twice as large as the one before."""
    early = stations.where(F.col("first_seen") <= first_day).withColumn("__stratum", F.lit(0))
    late = running(stations.where(F.col("first_seen") > first_day).withColumn("__one", F.lit(1)), [], "first_seen", {"__rank": "__one"}, ties=[station])
    late = late.withColumn("__stratum", (1 + F.floor(F.log2(1 + (F.col("__rank") - 1) / k))).cast("int"))
    return early.unionByName(late.drop("__one", "__rank"))


def _box_distance(low: bool) -> Column:
    """Lower or upper bound of the distance between any two points of boxes `a` and `b`."""
    c = F.col
    gap = lambda p, q, r, s: F.greatest(c(p) - c(q), c(r) - c(s), F.lit(0.0))
    reach = lambda p, q, r, s: F.greatest(F.abs(c(p) - c(q)), F.abs(c(r) - c(s)))
    cosines = lambda x: (F.cos(F.radians(c(f"{x}s"))), F.cos(F.radians(c(f"{x}n"))))
    half = lambda d: F.pow(F.sin(F.radians(F.least(d, F.lit(180.0)) / 2)), F.lit(2.0))
    if low:
        d_lon, d_lat = gap("aw", "be", "bw", "ae"), gap("as", "bn", "bs", "an")
        # The other way round the globe.
        d_lon = F.least(d_lon, F.greatest(F.lit(0.0), 360 - (F.greatest(c("ae"), c("be")) - F.least(c("aw"), c("bw")))))
        h = half(d_lat) + F.least(*cosines("a")) * F.least(*cosines("b")) * half(d_lon)
    else:
        crosses = lambda x: F.when((c(f"{x}s") <= 0) & (c(f"{x}n") >= 0), 1.0).otherwise(F.greatest(*cosines(x)))
        # Longitudes at least half a turn apart are nearer the other way round.
        apart = gap("aw", "be", "bw", "ae")
        d_lon = F.when(apart >= 180, 360 - apart).otherwise(reach("ae", "bw", "be", "aw"))
        h = half(d_lon) * crosses("a") * crosses("b") + half(reach("an", "bs", "bn", "as"))
    slack = -1e-6 if low else 1e-6
    return F.asin(F.sqrt(F.least(F.lit(1.0), h))) * (2 * EARTH_KM) + slack


def _useful(pairs: DataFrame, k: int, cell: str) -> DataFrame:
    """Of the (cell, station node) pairs those that may hold a station serving the cell.

    A node is of no use beyond the radius within which k stations of an earlier stratum lie for sure; for
    stratum 0, whose stations count from the first day, k of its own.
    """
    far = pairs.withColumns({"__lo": _box_distance(True), "__hi": _box_distance(False)})
    own = W.partitionBy(cell, "__stratum")
    far = far.withColumn("__upto", F.sum("__n").over(own.orderBy("__hi", "__bt").rowsBetween(W.unboundedPreceding, 0)))
    far = far.withColumn("__sure", F.min(F.when(F.col("__upto") >= k, F.col("__hi"))).over(own))
    before = F.min("__sure").over(W.partitionBy(cell).orderBy("__stratum").rangeBetween(W.unboundedPreceding, -1))
    radius = F.coalesce(F.when(F.col("__stratum") == 0, F.col("__sure")).otherwise(before), F.lit(float("inf")))
    kept = far.withColumn("__radius", radius).where("__lo <= __radius")
    return kept.select(cell, "aw", "ae", "as", "an", "__stratum", "__bt")


def leaf_pairs(cells: DataFrame, stations: DataFrame, k: int, cell: str) -> DataFrame:
    """(cell, __stratum, __bt) of cells and the station leaves that may serve them; `stations` has `__stratum` and `__bt`.

    The leaves of a stratum are the lowest level of a tree of boxes. Each cell goes down the trees from at most LEAF
    nodes at the top of each, through the nodes that stay of use: its pairs depend on k and the
    number of strata, not on how many stations there are.
    """
    bounds = [f(c).alias(f"b{n}") for f, c, n in ((F.min, "lon", "w"), (F.max, "lon", "e"), (F.min, "lat", "s"), (F.max, "lat", "n"))]
    levels = [checkpoint(stations.groupBy("__stratum", "__bt").agg(*bounds, F.count(F.lit(1)).alias("__n")))]
    top = levels[0].agg(F.max("__bt")).first()[0] or 0
    above = F.floor(F.col("__bt") / LEAF).cast("long")
    while top >= LEAF:
        up = levels[-1].withColumn("__bt", above)
        levels.append(up.groupBy("__stratum", "__bt").agg(*[f(c).alias(c) for f, c in ((F.min, "bw"), (F.max, "be"), (F.min, "bs"), (F.max, "bn"), (F.sum, "__n"))]))
        top //= LEAF
    boxes = levels[-1].agg(F.collect_list(F.struct(*levels[-1].columns))).scalar()  # LEAF for each doubling of the stations
    points = cells.select(cell, F.col("lon").alias("aw"), F.col("lon").alias("ae"), F.col("lat").alias("as"), F.col("lat").alias("an"))
    pairs = _useful(points.withColumn("__b", F.explode(boxes)).select(*points.columns, "__b.*"), k, cell)
    for level in reversed(levels[:-1]):
        below = level.withColumn("__up", above)
        pairs = _useful(pairs.withColumnRenamed("__bt", "__up").join(below, ["__stratum", "__up"]).drop("__up"), k, cell)
    return pairs.select(cell, "__stratum", "__bt")


def _candidates(cells: DataFrame, stations: DataFrame, k: int, cell: str, station: str) -> DataFrame:
    """Cells with the stations that may serve them and their distance; `stations` has `__stratum`."""
    placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    left = cells.select(cell, "lon", "lat").where(placed)
    right = checkpoint(leaves(stations.where(placed), station, "__bt", "__stratum"))
    far = right.withColumnsRenamed({"lon": "__lon", "lat": "__lat"})
    met = left.join(leaf_pairs(left, right, k, cell), cell).join(far, ["__stratum", "__bt"])
    return met.withColumn("distance_km", distance_km(F.col("lon"), F.col("lat"), F.col("__lon"), F.col("__lat"))).drop("__stratum", "__bt", "__lon", "__lat")


def nearest(cells: DataFrame, stations: DataFrame, k: int, cell: str, station: str, tie: str) -> DataFrame:
    """The k stations nearest to each cell: (cell, station, distance_km, rank); ties by `tie`, then station.

    Cells meet the stations of a few leaves, and the rank filter is applied inside each task before the shuffle.
    """
    here = stations.select(station, tie, "lon", "lat") if tie != station else stations.select(station, "lon", "lat")
    candidates = _candidates(cells, here.withColumn("__stratum", F.lit(0)), k, cell, station)
    order = W.partitionBy(cell).orderBy("distance_km", tie, station)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(cell, station, "distance_km", "rank")


def as_of_nearest(cells: DataFrame, stations: DataFrame, k: int, cell: str, station: str, first_day: int) -> DataFrame:
    """Days on which each station is among the k nearest *eligible* stations of a cell.

    A station is eligible from its `first_seen` day on. It serves a cell over
    [first_seen, until): it drops out on the day the k-th station that ranks
    before it - by (distance, first_seen, station) - has been seen. So one row per
    (cell, station) with a validity interval replaces a ranking per day, and a
    station that appears later can never change an earlier day. `first_day` is the
    earliest day that will be asked for.

    Stations farther than k that were surely seen before can never serve: they are searched in strata of
    first_seen, each bounded by the ones before it. Of the stations first seen on one day only the
    nearest k can. What is folded per cell is therefore at most k entries per calendar day.
    """
    seen = F.greatest(F.col("first_seen"), F.lit(first_day))
    kept = strata(stations.select(station, "first_seen", "lon", "lat"), first_day, k, station)
    candidates = _candidates(cells, kept, k, cell, station).withColumn("__seen", seen)
    same_day = W.partitionBy(cell, "__seen").orderBy("distance_km", "first_seen", station)
    kept = candidates.withColumn("__r", F.row_number().over(same_day)).where(F.col("__r") <= k)
    entry = F.struct("distance_km", "first_seen", F.col(station))
    per_cell = kept.groupBy(cell).agg(F.array_sort(F.collect_list(entry)).alias("__all"))

    def add(state: Column, item: Column) -> Column:
        """Keep the k earliest days seen so far; the last of them is when the next candidate would be displaced."""
        full = F.size(state["days"]) >= k
        until = F.when(full, F.element_at(state["days"], -1))
        used = until.isNull() | (until > item["first_seen"])
        days = F.slice(F.array_sort(F.concat(state["days"], F.array(item["first_seen"]))), 1, k)
        row = F.array(F.struct(item["distance_km"].alias("distance_km"), item["first_seen"].alias("since"), until.alias("until"), item[station].alias(station)))
        return F.struct(days.alias("days"), F.when(used, F.concat(state["rows"], row)).otherwise(state["rows"]).alias("rows"))

    day_type = stations.select("first_seen").schema["first_seen"].dataType
    key_type = stations.select(station).schema[station].dataType.simpleString()
    empty = F.struct(
        F.array().cast(f"array<{day_type.simpleString()}>").alias("days"),
        F.array().cast(f"array<struct<distance_km:double,since:{day_type.simpleString()},until:{day_type.simpleString()},{station}:{key_type}>>").alias("rows"),
    )
    folded = per_cell.select(cell, F.explode(F.aggregate("__all", empty, add, lambda s: s["rows"])).alias("__v"))
    return folded.select(cell, F.col(f"__v.{station}").alias(station), "__v.distance_km", "__v.since", "__v.until")


def served_days(validity: DataFrame, days: DataFrame, day: str, block: int = 64) -> DataFrame:
    """Every (cell, station, day) of `days` inside a validity interval; intervals and days meet through blocks of days."""
    at = lambda c: F.floor(c / block)
    last = days.agg(F.max(day)).scalar()
    spans = validity.withColumn("__b", F.explode(F.sequence(at(F.col("since")), at(F.greatest(F.col("since"), F.coalesce(F.col("until") - 1, last))))))
    joined = spans.join(days.withColumn("__b", at(F.col(day))), "__b").drop("__b")
    return joined.where((F.col(day) >= F.col("since")) & (F.col("until").isNull() | (F.col(day) < F.col("until"))))


def eligible_counts(stations: DataFrame, days: DataFrame, day: str, k: int) -> DataFrame:
    """min(k, stations seen so far) per day; one row per calendar day reaches the window."""
    arrivals = stations.groupBy(F.col("first_seen").alias(day)).agg(F.count(F.lit(1)).alias("__new"))
    merged = days.select(day).distinct().withColumn("__need", F.lit(True)).unionByName(arrivals, allowMissingColumns=True)
    merged = merged.groupBy(day).agg(F.max("__need").alias("__need"), F.sum("__new").alias("__new"))
    total = F.sum("__new").over(W.orderBy(day).rowsBetween(W.unboundedPreceding, 0))
    return merged.select(day, "__need", F.least(F.lit(k), F.coalesce(total, F.lit(0))).cast("long").alias("choices")).where("__need").drop("__need")


def weighted_day(served: DataFrame, keys: list[str], fields: list[str], valid: str, imputed: str, status: str) -> DataFrame:
    """Inverse-square-distance means and selection quality per key; every mean skips NULLs and is NULL without weight."""
    usable = F.col(valid).isNotNull()
    weight = F.lit(1.0) / F.pow(F.greatest(F.col("distance_km"), F.lit(1.0)), F.lit(2.0))
    means = []
    for field in fields:
        has = usable & F.col(field).isNotNull()
        means.append((F.sum(F.when(has, weight * F.col(field))) / F.sum(F.when(has, weight))).alias(field))
    return served.groupBy(*keys).agg(
        F.count(F.when(usable, 1)).alias("station_count"),
        F.min(F.when(usable, F.col("distance_km"))).alias("nearest_km"),
        F.avg(F.when(usable, F.col(imputed).cast("double"))).alias("imputed_fraction"),
        F.avg(F.when(usable & F.col(status).isNotNull(), (F.col(status) != 0).cast("double"))).alias("status_fraction"),
        F.coalesce(F.max(usable.cast("int")) == 0, F.lit(True)).cast("int").alias("missing"),
        *means,
    )
