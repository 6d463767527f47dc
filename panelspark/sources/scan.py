"""Scans of delimited, JSON and GeoJSON files with enforced schemas, and source gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from panelspark.contracts import ContractError, assert_columns
from panelspark.functions.clean import strip_byte_order_mark


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, exact: bool = True) -> DataFrame:
    """Delimited scan. `exact`: the header must equal the schema in order, or reading fails; else the schema is a required subset."""
    if exact:
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    text = strip_byte_order_mark(spark.read.option("header", True).csv(path))
    assert_columns(text, schema.fieldNames(), exact=False)
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


def scan_text(spark: SparkSession, path: str | list[str], required: list[str] = ()) -> DataFrame:
    """Every column as text, whatever the codec (by extension); a byte-order mark is stripped and required columns are checked.

    A gzip file is one task; bzip2 and plain files split. Repartition after a
    gzip scan before heavy work.
    """
    return assert_columns(strip_byte_order_mark(spark.read.option("header", True).csv(path)), list(required), exact=False)


def scan_detections(spark: SparkSession, pattern: str) -> DataFrame:
    """All sensor-year files of a glob: vegetation fires of nominal or high confidence, with a UTC clock from date and HHMM."""
    schema = "latitude double, longitude double, acq_date string, acq_time string, satellite string, confidence string, frp double, daynight string, type int"
    rows = spark.read.schema(schema).option("header", True).csv(pattern).where((F.col("type") == 0) & (F.col("confidence") != "l"))
    clock = F.concat_ws(" ", "acq_date", F.lpad("acq_time", 4, "0"))
    return rows.withColumn("time_utc", F.to_timestamp_ntz(clock, F.lit("yyyy-MM-dd HHmm")))


HOURLY = "struct<time:array<string>,temperature_2m:array<double>,relative_humidity_2m:array<double>,precipitation:array<double>,wind_speed_10m:array<double>,wind_direction_10m:array<double>>"


def scan_hourly_json(spark: SparkSession, path: str, key: str = "entity") -> DataFrame:
    """Parallel hourly arrays of each document as rows."""
    docs = spark.read.schema(f"{key} string, hourly {HOURLY}").json(path)
    zipped = F.arrays_zip(*[F.col(f"hourly.{c}").alias(c) for c in ("time", "temperature_2m", "relative_humidity_2m", "precipitation", "wind_speed_10m", "wind_direction_10m")])
    rows = docs.select(key, F.explode(zipped).alias("h")).select(key, "h.*")
    names = {"temperature_2m": "temp", "relative_humidity_2m": "rh", "precipitation": "rain", "wind_speed_10m": "speed", "wind_direction_10m": "direction"}
    return rows.withColumnsRenamed(names).withColumn("time", F.to_timestamp_ntz(F.col("time"), F.lit("yyyy-MM-dd'T'HH:mm")))


def scan_geojson(spark: SparkSession, path: str, properties: str, *, lines: bool = False) -> DataFrame:
    """Features with their properties, geometry type and coordinates as text. `properties` is a struct DDL.

    A FeatureCollection is one document and so one task; use `lines` for
    newline-delimited features at scale.
    """
    feature = f"struct<type:string,properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>"
    if lines:
        rows = spark.read.schema(f"properties struct<{properties}>, geometry struct<type:string,coordinates:string>").json(path)
    else:
        rows = spark.read.schema(f"features array<{feature}>").option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.*")
    return rows.select("properties.*", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("coordinates"))


def epoch_day(milliseconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(milliseconds / 86400000).cast("int"))


def ring_edges(features: DataFrame, key: str) -> DataFrame:
    """Directed edges (key, part, ring, edge, x1, y1, x2, y2) of polygon and multipolygon features; ring 0 is the outer one."""
    ring = "array<array<double>>"
    parts = F.when(F.col("geometry_type") == "Polygon", F.array(F.from_json("coordinates", f"array<{ring}>"))).when(
        F.col("geometry_type") == "MultiPolygon", F.from_json("coordinates", f"array<array<{ring}>>")
    ).otherwise(F.raise_error(F.concat(F.lit("unsupported geometry: "), F.coalesce("geometry_type", F.lit("none")))).cast(f"array<array<{ring}>>"))
    rings = features.select(key, F.posexplode(parts).alias("part", "__p")).select(key, "part", F.posexplode("__p").alias("ring", "__r"))
    edges = rings.withColumn("edge", F.explode(F.sequence(F.lit(0), F.size("__r") - 2)))
    at = lambda i, j: F.get(F.get(F.col("__r"), i), j)
    i = F.col("edge")
    return edges.select(
        key, "part", "ring", "edge", at(i, F.lit(0)).alias("x1"), at(i, F.lit(1)).alias("y1"), at(i + 1, F.lit(0)).alias("x2"), at(i + 1, F.lit(1)).alias("y2")
    )


def year_slice(df: DataFrame, first: int, last: int, year: str = "year") -> DataFrame:
    """Rows of the years [first, last] (partition pruning when stored by year); an empty range raises."""
    kept = df.where(F.col(year).between(first, last))
    if kept.limit(1).isEmpty():
        raise ContractError(f"no rows in {first}-{last}")
    return kept


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) per file; each file must be under 2 GiB."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint_gate(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """The fingerprints, but the job fails on any file that differs from or is missing in the manifest (file, sha256)."""
    both = found.join(manifest.withColumnRenamed("sha256", "__want"), "file", "full")
    ok = F.coalesce(F.col("sha256") == F.col("__want"), F.lit(False))
    return both.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("checksum differs: "), "file")).cast("boolean"))).drop("__want")

