"""Running sums, ranks, neighbours and exact quantiles of groups of any size.

A plain window function sorts a whole group in one task, which is right for groups
of at most WHOLE rows. Where any is larger, the ordered axis is cut at approximate
quantiles, so a group - even one holding most of the rows, even the single global
group - is spread over many tasks: each piece is windowed on its own and then
shifted by the totals of the pieces before it. The cut points decide only the
balance, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from panelspark.session import parts_for

PIECE = "__piece"
#: Rows of a group up to which one task sorts it whole.
WHOLE = 1 << 18


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on same-named keys where NULL equals NULL; an empty key list needs a one-row `right`."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    if not keys:
        return left.join(F.broadcast(renamed), F.lit(True), how)  # one row by contract
    same = reduce(Column.__and__, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__r_{k}" for k in keys])


def cut_points(df: DataFrame, order: str, parts: int | None = None) -> list[float]:
    """At most `parts - 1` increasing cut points of a numeric column (a driver-sized list)."""
    parts = parts or parts_for(df)
    probabilities = [i / parts for i in range(1, parts)]
    found = df.select(F.col(order).cast("double").alias("v")).approxQuantile("v", probabilities, 1.0 / (4 * parts))
    return sorted(set(found))


def group_cuts(df: DataFrame, keys: list[str], order: str, sized: DataFrame | None = None) -> list[float]:
    """`cut_points`, or none where every group of `keys` has at most WHOLE rows.

    `sized` is a table with the keys that is cheaper to count and whose groups are no smaller.
    """
    if keys:
        sizes = (df if sized is None else sized).groupBy(*keys).agg(F.count(F.lit(1)).alias("__c"))
        if (sizes.agg(F.max("__c")).first()[0] or 0) <= WHOLE:
            return []
    return cut_points(df, order)


def with_piece(df: DataFrame, order: str, cuts: list[float]) -> DataFrame:
    """Add the number of the piece each row falls in; pieces follow the order of the column."""
    if not cuts:  # an empty or constant axis is one piece
        return df.withColumn(PIECE, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    cast = df.withColumn("__v", F.col(order).cast("double"))
    bucketed = Bucketizer(splits=splits, inputCol="__v", outputCol=PIECE, handleInvalid="keep").transform(cast)
    return bucketed.withColumn(PIECE, F.col(PIECE).cast("int")).drop("__v")


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, str],
    *,
    ties: list[str] | None = None,
    descending: bool = False,
    totals: bool = False,
    peers: bool = False,
    cuts: list[float] | None = None,
) -> DataFrame:
    """Inclusive running sums of `sums` = {output: input} along `order` within `keys`.

    Rows should be unique in (`keys`, `order`) or be ordered by the extra `ties`
    columns; tied rows must share a piece, so ties never cross a cut. With `peers`
    tied rows all get the sum up to the last of them. With `totals` also adds
    `<output>_total` per group. `order` must be numeric and not NULL.
    """
    cuts = group_cuts(df, keys, order) if cuts is None else cuts
    direction = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())

    def upto(group: list[str]) -> WindowSpec:
        along = W.partitionBy(*group).orderBy(direction(order), *[F.col(t) for t in ties or []])
        return along.rangeBetween(W.unboundedPreceding, W.currentRow) if peers else along.rowsBetween(W.unboundedPreceding, W.currentRow)

    if keys and not cuts:
        sums_here = {o: F.coalesce(F.sum(c).over(upto(keys)), F.lit(0)) for o, c in sums.items()}
        return df.withColumns(sums_here | ({f"{o}_total": F.sum(c).over(W.partitionBy(*keys)) for o, c in sums.items()} if totals else {}))
    group = [*keys, PIECE]
    pieces = with_piece(df, order, cuts).repartition(*[F.col(c) for c in group])
    per_piece = pieces.groupBy(*group).agg(*[F.sum(c).alias(f"__s_{o}") for o, c in sums.items()])
    # At most one row per piece and group reaches this window.
    earlier = W.partitionBy(*keys).orderBy(direction(PIECE)).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    columns = [F.coalesce(F.sum(f"__s_{o}").over(earlier), F.lit(0)).alias(f"__o_{o}") for o in sums]
    if totals:
        columns += [F.sum(f"__s_{o}").over(whole).alias(f"{o}_total") for o in sums]
    offsets = per_piece.select(*group, *columns)
    local = pieces.withColumns({o: F.coalesce(F.sum(c).over(upto(group)), F.lit(0)) for o, c in sums.items()})
    joined = join_keys(local, offsets, group)
    shifted = joined.withColumns({o: F.col(o) + F.col(f"__o_{o}") for o in sums})
    return shifted.drop(PIECE, *[f"__o_{o}" for o in sums])


def neighbour(
    df: DataFrame, keys: list[str], order: str, values: dict[str, str], *, following: bool = False, cuts: list[float] | None = None, ties: list[str] | None = None
) -> DataFrame:
    """`values` = {output: input} of the previous (or following) row along `order` within `keys`.

    Rows with equal `order` share a piece; the `ties` columns order them, inside pieces and across cuts alike.
    """
    cuts = group_cuts(df, keys, order) if cuts is None else cuts
    step = F.lead if following else F.lag
    if keys and not cuts:
        near = step(F.struct(*values.values())).over(W.partitionBy(*keys).orderBy(order, *(ties or [])))
        return df.withColumn("__near", near).withColumns({o: F.col("__near")[c] for o, c in values.items()}).drop("__near")
    group = [*keys, PIECE]
    pieces = with_piece(df, order, cuts).repartition(*[F.col(c) for c in group])
    pick = F.min_by if following else F.max_by
    along = [order, *(ties or [])]
    edge = pieces.groupBy(*group).agg(pick(F.struct(*values.values()), F.struct(*along)).alias("__edge"))
    across = W.partitionBy(*keys).orderBy(PIECE)
    edge = edge.withColumn("__edge", step("__edge").over(across))
    inside = W.partitionBy(*group).orderBy(*along)
    local = pieces.withColumn("__near", step(F.struct(*values.values())).over(inside))
    joined = join_keys(local, edge, group)
    near = F.coalesce("__near", "__edge")
    return joined.withColumns({o: near[c] for o, c in values.items()}).drop(PIECE, "__near", "__edge")


def quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float], n: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles per group; equal values are merged before any sort. `n` names a count of rows where rows are merged already."""
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg((F.sum(n) if n else F.count(F.lit(1))).alias("__n"))
    ranked = running(counts, keys, value, {"__upto": "__n"}, totals=True, cuts=group_cuts(counts, keys, value, known))
    before = F.col("__upto") - F.col("__n")
    picks = []
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("__upto_total") - 1)
        low, high = F.floor(position), F.ceil(position)
        picks += [
            F.max(F.when((before <= low) & (low < F.col("__upto")), F.col(value).cast("double"))).alias(f"__lo_{name}"),
            F.max(F.when((before <= high) & (high < F.col("__upto")), F.col(value).cast("double"))).alias(f"__hi_{name}"),
        ]
    found = ranked.groupBy(*keys).agg(F.max("__upto_total").alias("__n"), *picks)
    for name, p in probabilities.items():
        position = F.lit(float(p)) * (F.col("__n") - 1)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        found = found.withColumn(name, low + (position - F.floor(position)) * (high - low))
    return found.select(*keys, *probabilities)


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Distinct values of each group with their average rank (ties share the mean position)."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(counts, keys, value, {"__upto": "__n"})
    return ranked.select(*keys, value, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(name))
