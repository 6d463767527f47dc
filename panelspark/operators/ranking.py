"""Ranks with tie bounds, budgeted selection, seeded samples and curve thinning, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.operators.ordered import join_keys, running


def tie_groups(df: DataFrame, groups: list[str], score: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """One row per group and distinct score, highest first: size, best and worst rank, group size.

    For every extra sum also `<name>_upto`, the running total from the top. Rows
    with equal scores are merged before anything is ordered.
    """
    sums = {"ties": F.count(F.lit(1)), **(sums or {})}
    counts = df.groupBy(*groups, score).agg(*[c.alias(n) for n, c in sums.items()])
    ranked = running(counts, groups, score, {f"{n}_upto": n for n in sums}, descending=True, totals=True)
    return ranked.withColumns({"rank_max": F.col("ties_upto"), "rank_min": F.col("ties_upto") - F.col("ties") + 1, "group_size": F.col("ties_upto_total")}).drop("ties_upto", "ties_upto_total")


def ranks(df: DataFrame, groups: list[str], score: str, tie: str) -> DataFrame:
    """Adds rank (score descending, `tie` ascending), rank_min, rank_max, midrank and group_size. `tie` is numeric and unique in a group."""
    bounds = tie_groups(df, groups, score).select(*groups, score, "rank_min", "rank_max", "group_size")
    bounded = join_keys(df, bounds, [*groups, score])
    placed = running(bounded.withColumn("__one", F.lit(1)), [*groups, score], tie, {"__in_tie": "__one"})
    return placed.withColumns(
        {"rank": F.col("rank_min") + F.col("__in_tie") - 1, "midrank": (F.col("rank_min") + F.col("rank_max")) / 2}
    ).drop("__one", "__in_tie")


def budget_size(size: Column, percent: int) -> Column:
    """ceil(size * percent / 100) in whole numbers."""
    return F.floor((size * percent + 99) / 100).cast("long")


def cutoff_ties(df: DataFrame, groups: list[str], score: str, label: str, percents: list[int]) -> DataFrame:
    """Per group and budget: the cut-off score, its ties, and the least, most and expected hits under any tie order."""
    levels = tie_groups(df, groups, score, {"positives": F.sum(label)})
    budgets = levels.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    budgets = budgets.withColumn("k", F.floor((F.col("group_size") * F.col("percent") + 99) / 100).cast("long"))
    at = budgets.where((F.col("rank_min") <= F.col("k")) & (F.col("k") <= F.col("rank_max")))
    above = F.col("positives_upto") - F.col("positives")
    slots = F.col("k") - F.col("rank_min") + 1
    zero = F.lit(0).cast("long")
    return at.select(
        *groups, "percent", "k", F.col("group_size").alias("rows"), F.col("positives_upto_total").alias("n_positive"), F.col(score).alias("cutoff_score"),
        F.col("ties").alias("tie_count"), slots.alias("slots"),
        (above + F.greatest(zero, slots - (F.col("ties") - F.col("positives")))).alias("least_hits"),
        (above + F.least(slots, F.col("positives"))).alias("most_hits"),
        (above + slots * F.col("positives") / F.col("ties")).alias("expected_hits"),
        (F.col("ties") > slots).cast("long").alias("ambiguous"),
        (F.col("k") * F.col("positives_upto_total") / F.col("group_size")).alias("random_hits"),
    )


def top_k(df: DataFrame, groups: list[str], score: str, tie: str, k: DataFrame, name: str = "selected") -> DataFrame:
    """Flag the k best rows of each group, where `k` = (groups, k) differs by group; ties by `tie`."""
    return join_keys(ranks(df, groups, score, tie), k, groups, "left").withColumn(name, F.coalesce(F.col("rank") <= F.col("k"), F.lit(False))).drop("k")


def budget_report(df: DataFrame, day: str, period: str, score: str, tie: str, label: str, flag: str, percents: list[int]) -> DataFrame:
    """Selection metrics for each period and pooled, for all rows and by coverage flag, at each budget."""
    ranked = ranks(df, [day], score, tie)
    hits = []
    for p in percents:
        chosen = F.col("rank") <= budget_size(F.col("group_size"), p)
        hits.append(F.struct(
            F.lit(p).alias("percent"), F.count(F.when(chosen, 1)).alias("alerts"), F.coalesce(F.sum(F.when(chosen, F.col(label))), F.lit(0)).alias("tp")
        ))
    daily = ranked.groupBy(day, period, flag).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("positive"), F.array(*hits).alias("__b"))
    # From here on there is one row per day, flag and budget.
    long = daily.withColumn("__b", F.explode("__b")).select(day, period, flag, "rows", "positive", "__b.percent", "__b.alerts", "__b.tp")
    coverage = F.when(F.col(flag) == 0, "covered").otherwise("missing")
    long = long.withColumn("period", F.explode(F.array(F.col(period).cast("string"), F.lit("pooled")))).withColumn("coverage", F.explode(F.array(F.lit("all"), coverage)))
    dates = df.select(day, F.explode(F.array(F.col(period).cast("string"), F.lit("pooled"))).alias("period")).distinct().groupBy("period").agg(F.count(F.lit(1)).alias("n_dates"))
    table = long.groupBy("period", "coverage", "percent").agg(
        F.sum("rows").alias("n_samples"), F.sum("positive").alias("n_positive"), F.sum("alerts").alias("n_alerts"), F.sum("tp").alias("true_positive"), F.countDistinct(day).alias("days_with_rows")
    ).join(dates, "period")
    ties = cutoff_ties(df, [day], score, label, percents).join(df.select(day, period).distinct(), day)
    ties = ties.withColumn("period", F.explode(F.array(F.col(period).cast("string"), F.lit("pooled")))).groupBy("period", "percent").agg(
        *[F.sum(c).alias(c) for c in ("least_hits", "most_hits", "expected_hits", "random_hits", "ambiguous")]
    ).withColumn("coverage", F.lit("all"))
    table = table.join(ties, ["period", "percent", "coverage"], "left")
    n, pos, alerts, tp, days = (F.col(c) for c in ("n_samples", "n_positive", "n_alerts", "true_positive", "n_dates"))
    fp, negative = alerts - tp, n - pos
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    return table.withColumns({
        "false_positive": fp, "false_negative": pos - tp, "true_negative": negative - fp, "precision": ratio(tp, alerts), "recall": ratio(tp, pos),
        "false_positive_rate": ratio(fp, negative), "alerts_per_day": ratio(alerts, days), "false_alerts_per_day": ratio(fp, days),
        "false_alerts_per_10000": ratio(fp * 10000, n), "lift_vs_random": tp / F.nullif(F.col("random_hits"), F.lit(0.0)),
    })


def seeded_priority(*keys: str, seed: int = 0) -> Column:
    return F.xxhash64(*keys, F.lit(seed))


def uniform_sample(df: DataFrame, size: int, priority: Column) -> DataFrame:
    """Fixed-size uniform sample: the rows of smallest pseudo-random priority, kept per task and merged."""
    return df.withColumn("__p", priority).orderBy("__p").limit(size).drop("__p")


def thin(points: DataFrame, order: str, most: int) -> DataFrame:
    """At most `most` rows evenly spaced along `order`, first and last included."""
    placed = running(points.withColumn("__one", F.lit(1)), [], order, {"__i": "__one"}, totals=True)
    i, last = F.col("__i") - 1, F.col("__i_total") - 1
    step = F.ceil(i * (most - 1) / F.nullif(last, F.lit(0)))
    keep = (F.col("__i_total") <= most) | (F.floor(step * last / (most - 1)) == i)
    return placed.where(keep).drop("__one", "__i", "__i_total")


def strict_order_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: row order is not kept by Spark, so uniqueness is what an ordering check proves."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
