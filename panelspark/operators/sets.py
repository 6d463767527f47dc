"""Set operations on key tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def union_all(*tables: DataFrame) -> DataFrame:
    """Union by column name."""
    merged = tables[0]
    for table in tables[1:]:
        merged = merged.unionByName(table)
    return merged


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of `a` beyond those of `b`, repeats counted."""
    return a.select(*sorted(a.columns)).exceptAll(b.select(*sorted(a.columns)))


def equality(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows found more often on the left and on the right; both zero when the multisets are equal."""
    sides = a.select(*keys, F.lit(1).alias("__s")).unionByName(b.select(*keys, F.lit(-1).alias("__s")))
    net = sides.groupBy(*keys).agg(F.sum("__s").alias("__n"))
    return net.agg(
        F.coalesce(F.sum(F.greatest("__n", F.lit(0))), F.lit(0)).alias("left_surplus"), F.coalesce(F.sum(F.greatest(-F.col("__n"), F.lit(0))), F.lit(0)).alias("right_surplus")
    )


def overlap_count(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Number of distinct keys in both tables (0: disjoint)."""
    return a.select(*keys).intersect(b.select(*keys)).agg(F.count(F.lit(1)).alias("shared"))


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key repeats; the counts join back, so a very common key is not gathered in one task."""
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return df.join(copies, keys, "left_semi")


def without_duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows whose key is unique."""
    copies = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return df.join(copies, keys, "left_anti")


def pinned_or_capped(df: DataFrame, key: str, size: str, cap: float, splits: list, split: str, flag: str, pinned: DataFrame) -> DataFrame:
    """Rows of the given splits with the flag set whose size is within the cap or whose key is pinned."""
    marked = df.join(pinned.select(key).distinct().withColumn("__pin", F.lit(True)), key, "left")
    return marked.where(F.col(split).isin(splits) & F.col(flag) & ((F.col(size) <= cap) | F.col("__pin"))).drop("__pin")
