"""Sinks: partitioned panels, ordered tables, fold predictions, day exports and fixed-decimal CSV."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelspark.operators.ordered import join_keys


def write_panel(df: DataFrame, path: str, by: str = "year") -> str:
    """Parquet by `by`, refusing to overwrite; `stored.store` replaces a table as a whole.

    Rows are dealt by the partition column and rebalanced by size, so a large year is
    written by as many tasks as its size asks for.
    """
    df.hint("rebalance", by).write.mode("errorifexists").partitionBy(by).parquet(path)
    return path


def write_ordered(df: DataFrame, path: str, keys: list[str], force: bool = False) -> str:
    """Parquet whose files hold disjoint key ranges, each sorted by key."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite" if force else "errorifexists").parquet(path)
    return path


def parameter_id(parameters: dict) -> str:
    """Short stable id of a parameter set; key order does not matter."""
    import hashlib

    return hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:16]


def write_predictions(df: DataFrame, path: str, parameters: dict, fold: str = "fold") -> str:
    """Append the folds of one parameter set under its own id."""
    df.withColumn("parameter_id", F.lit(parameter_id(parameters))).write.mode("append").partitionBy("parameter_id", fold).parquet(path)
    return path


def read_predictions(spark: SparkSession, path: str, parameters: dict, labels: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Stored predictions of one parameter set; the job fails where labels differ, rows are missing or a score leaves [0, 1]."""
    stored = spark.read.parquet(path).where(F.col("parameter_id") == parameter_id(parameters)).drop("parameter_id")
    joined = join_keys(stored, labels.select(*keys, F.col(y).alias("__y")).withColumn("__want", F.lit(True)), keys, "full")
    ok = F.coalesce((F.col(y) == F.col("__y")) & F.col(p).between(0.0, 1.0), F.lit(False))
    proof = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("stored predictions do not match the labels")).cast("boolean"))
    return joined.where(proof).drop("__y", "__want")


def export_day(predictions: DataFrame, cells: DataFrame, cell: str, day: str, value) -> DataFrame:
    """One day's key, place, score, label and quality columns, ready to write as CSV."""
    chosen = predictions.where(F.col(day) == value)
    return chosen.join(cells.select(cell, "lon", "lat"), cell, "left")


def write_csv(df: DataFrame, path: str, decimals: dict[str, int] | None = None, compression: str = "gzip", force: bool = False) -> str:
    """CSV with a header, fixed decimals for the named columns, and compression."""
    rounded = df.withColumns({c: F.round(F.col(c), n) for c, n in decimals.items()}) if decimals else df
    rounded.write.mode("overwrite" if force else "errorifexists").option("header", True).option("compression", compression).csv(path)
    return path

