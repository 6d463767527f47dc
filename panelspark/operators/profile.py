"""Descriptive summaries of large tables: moments, rollups, histograms, correlations, shares and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.operators.ordered import quantiles


def class_moments(df: DataFrame, columns: list[str], positive: Column) -> DataFrame:
    """(column, class, observed, mean, deviation, min, max) for all, positive and negative rows.

    One scan aggregates the two classes; the few rows for all of them are merged
    from those, so the aggregate holds each column once.
    """
    def moments(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.count(v).alias("observed"), F.avg(v).alias("mean"), F.var_pop(v).alias("__var"), F.min(v).alias("min"), F.max(v).alias("max"))

    name = F.when(positive, "positive").otherwise("negative").alias("class")
    halves = df.groupBy(name).agg(F.array(*[moments(c) for c in columns]).alias("__m")).select("class", F.explode("__m").alias("__m")).select("class", "__m.*")
    both = halves.withColumn("class", F.explode(F.array(F.lit("all"), F.col("class"))))
    n, mean = F.col("observed"), F.col("mean")
    # Spread of all rows: spread inside each class plus the distance of its mean from the overall mean.
    table = both.groupBy("column", "class").agg(
        F.sum("observed").alias("observed"), (F.sum(n * mean) / F.nullif(F.sum("observed"), F.lit(0))).alias("mean"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.collect_list(F.struct(n.alias("n"), mean.alias("m"), F.col("__var").alias("v"))).alias("__parts"),  # at most two entries
    )
    spread = F.aggregate("__parts", F.lit(0.0), lambda s, p: s + F.coalesce(p["n"] * (p["v"] + (p["m"] - F.col("mean")) * (p["m"] - F.col("mean"))), F.lit(0.0)))
    deviation = F.when(F.col("observed") > 1, F.sqrt(spread / (F.col("observed") - 1)))
    return table.select("column", "class", "observed", "mean", deviation.alias("deviation"), "min", "max")


def rollup_rates(df: DataFrame, keys: dict[str, Column], label: str, flag: str) -> DataFrame:
    """Rows, positives, flagged rows and their rates per key; a later, coarser rollup can be fed the result's columns."""
    table = df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("positives"), F.sum(flag).alias("flagged"))
    return with_rates(table)


def coarser(table: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Roll an existing rollup up further without touching the base rows."""
    summed = table.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(*[F.sum(c).alias(c) for c in ("rows", "positives", "flagged")])
    return with_rates(summed)


def with_rates(table: DataFrame) -> DataFrame:
    return table.withColumns({"rate": F.col("positives") / F.col("rows"), "flagged_fraction": F.col("flagged") / F.col("rows")})


def per_cell(cells: DataFrame, df: DataFrame, cell: str, label: str, flag: str) -> DataFrame:
    summed = df.groupBy(cell).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("positives"), F.sum(flag).alias("flagged"))
    joined = cells.select(cell).join(summed, cell, "left").fillna(0, ["rows", "positives", "flagged"])
    return joined.withColumn("flagged_fraction", F.col("flagged") / F.greatest(F.col("rows"), F.lit(1)))


def cross_tab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("rows"))


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) of low-cardinality metadata columns, as rows rather than collected sets."""
    long = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(long).alias("__v")).select("__v.*").where("value is not null").distinct()


def quantile_table(df: DataFrame, columns: list[str], probabilities: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Exact quantiles of several columns at once: columns are unpivoted and share one pass."""
    keys = keys or []
    long = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return quantiles(df.select(*keys, F.explode(long).alias("__v")).select(*keys, "__v.*"), [*keys, "column"], "value", probabilities)


def pairwise_correlations(df: DataFrame, columns: list[str], least: int = 1000) -> DataFrame:
    """(a, b, pairs, r) on rows complete for each pair; NULL below `least` pairs. All pairs share one scan."""
    cells = []
    for i, a in enumerate(columns):
        for b in columns[i + 1 :]:
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            x, y = (F.when(both, F.col(c).cast("double")) for c in (a, b))
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.when(both, 1)).alias("pairs"), F.corr(x, y).alias("r")))
    table = df.agg(F.array(*cells).alias("__c")).select(F.explode("__c").alias("__c")).select("__c.*")
    return table.withColumn("r", F.when(F.col("pairs") >= least, F.col("r")))


def strong_pairs(correlations: DataFrame, least: float = 0.9) -> DataFrame:
    return correlations.where(F.abs("r") >= least)


def binned_quartiles(df: DataFrame, band: Column, value: str) -> DataFrame:
    """Count, quartiles and median per band; rows outside the bands drop out."""
    banded = df.withColumn("band", band).where("band is not null")
    counts = banded.groupBy("band").agg(F.count(value).alias("observations"))
    return counts.join(quantiles(banded, ["band"], value, {"p25": 0.25, "median": 0.5, "p75": 0.75}), "band")


def histogram_shares(df: DataFrame, value: str, edges: list[float], keys: list[str] | None = None) -> DataFrame:
    """(bin, low, high, count, share of all rows) over fixed edges, last edge included; empty bins are kept."""
    keys = keys or []
    v, last = F.col(value), len(edges) - 2
    at = F.when(v.isNull() | (v < edges[0]) | (v > edges[-1]), None)
    for i, high in enumerate(edges[1:-1]):
        at = at.when(v < high, F.lit(i))
    counted = df.withColumn("bin", at.otherwise(F.lit(last))).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"))
    total = counted.groupBy(*keys).agg(F.sum("count").alias("__all")) if keys else counted.agg(F.sum("count").alias("__all"))
    spans = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(a)).alias("low"), F.lit(float(b)).alias("high")) for i, (a, b) in enumerate(zip(edges, edges[1:]))])
    spine = total.withColumn("__s", F.explode(spans)).select(*keys, "__all", "__s.*")
    joined = spine.join(counted, [*keys, "bin"], "left").fillna(0, ["count"])
    return joined.select(*keys, "bin", "low", "high", "count", (F.col("count") / F.col("__all")).alias("share"))


def group_shares(df: DataFrame, key: str, value: str) -> DataFrame:
    """Group sums as shares of the total (the total is a one-row subquery over the sums)."""
    sums = df.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows"))
    return sums.withColumn("share", F.col("total") / sums.agg(F.sum("total")).scalar())


def top_categories(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.asc(key)).limit(n)


def category_counts(df: DataFrame, group: str, category: str, values: list) -> DataFrame:
    """Wide zero-filled counts of the listed categories per group."""
    return df.groupBy(group).pivot(category, values).agg(F.count(F.lit(1))).fillna(0)


def coherence(df: DataFrame, angle: str, keep: Column, limit: float = 45.0) -> DataFrame:
    """Share of kept rows with an angle within the limit, and the exact median angle."""
    kept = df.where(keep & F.col(angle).isNotNull())
    table = kept.agg(F.count(F.lit(1)).alias("steps"), F.avg((F.col(angle) <= limit).cast("double")).alias("share_within"))
    return table.withColumn("median_angle", quantiles(kept, [], angle, {"median": 0.5}).select("median").scalar())


def cause_masks(events: DataFrame, keys: list[str], cause: str, bits: dict) -> DataFrame:
    """Bit mask of the causes of each key, its disjoint partition, and whether it contains the first two causes.

    `bits` maps natural, human and unknown cause values to 1, 2 and 4.
    """
    code = F.lit(0)
    for value, bit in bits.items():
        code = F.when(F.col(cause) == value, bit).otherwise(code)
    masked = events.groupBy(*keys).agg(F.bit_or(code).alias("mask"), F.count(F.lit(1)).alias("events"))
    m = F.col("mask")
    partition = F.when(m >= 4, "unknown_involved").when(m == 3, "mixed").when(m == 2, "human_only").when(m == 1, "natural_only")
    return masked.withColumns({"partition": partition, "natural_containing": m.bitwiseAND(1) != 0, "human_containing": m.bitwiseAND(2) != 0})


def exposure_state(day: Column, week: Column) -> Column:
    """State of two nested exposure windows; unknown when either is."""
    return F.when(day.isNull() | week.isNull(), "unknown").when(day > 0, "day_and_week").when(week > 0, "week_only").otherwise("neither")


def exposure_summary(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Counts of each exposure state and detected fractions, among all and among covered rows."""
    n = lambda s: F.count(F.when(F.col(state) == s, 1))
    table = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), n("unknown").alias("unknown"), n("day_and_week").alias("detected_day"), n("week_only").alias("week_only"), n("neither").alias("neither")
    )
    table = table.withColumns({"covered": F.col("rows") - F.col("unknown"), "detected_week": F.col("detected_day") + F.col("week_only")})
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return table.withColumns({
        "day_fraction": ratio("detected_day", "rows"), "week_fraction": ratio("detected_week", "rows"),
        "day_fraction_covered": ratio("detected_day", "covered"), "week_fraction_covered": ratio("detected_week", "covered"),
    })
