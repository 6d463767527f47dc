"""Tables that are replaced as a whole, with a manifest and an audit beside them, and the gate that reads those.

A table's folder holds one folder per version and a pointer to the current one. A version is
written in full, counted by its checks, fingerprinted and audited before the pointer is
swapped, so a job that dies at any point leaves the table as it was.

    <path>/CURRENT                  name of the current version
    <path>/<version>/data           parquet files
    <path>/<version>/manifest       (file, bytes, sha256) of each
    <path>/<version>/audit.json     status, version, counts, columns, checksum of the manifest
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelspark.contracts import ContractError

POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _read_text(spark: SparkSession, path: str) -> str | None:
    files, place = _files(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    files, place = _files(spark, path)
    stream = files.create(place, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _swap(spark: SparkSession, path: str, name: str) -> None:
    """Make `name` the current version: a written file takes the pointer's place in one rename."""
    fresh, old = f"{path}/.{POINTER}-{uuid.uuid4().hex}", f"{path}/{POINTER}"
    _write_text(spark, fresh, name)
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    source, target = fs.Path(fresh), fs.Path(old)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(source), files.makeQualified(target), how)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the data files below `path`, by their place in it; each is read in one task (2 GiB at most)."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    inside = F.substring_index(F.col("path"), "/data/", -1)
    return found.select(inside.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def differences(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file, same) for each file of either side; a file that is missing, new or changed is not the same."""
    want = manifest.select("file", F.col("sha256").alias("__want"))
    both = found.select("file", "sha256").join(want, "file", "full")
    return both.select("file", F.coalesce(F.col("sha256") == F.col("__want"), F.lit(False)).alias("same"))


def _checksum(manifest: DataFrame):
    """Files, bytes and an order-free checksum of a manifest, as one row."""
    return manifest.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.hex(F.coalesce(F.bit_xor(F.xxhash64("file", "bytes", "sha256")), F.lit(0))).alias("checksum")).first()


def store(df: DataFrame, path: str, version: str, checks: dict[str, Column] | None = None, *, by: list[str] | None = None, replace: bool = False) -> dict:
    """Write `df` as the current table of `path` and return its audit.

    `checks` are conditions that no row may meet, counted on the written rows. The audit
    fails if one does, which `load` refuses. An existing table is refused unless `replace`.
    """
    spark, checks = df.sparkSession, checks or {}
    if not replace and _read_text(spark, f"{path}/{POINTER}") is not None:
        raise ContractError(f"there is a table in {path}")
    name = uuid.uuid4().hex
    data = f"{path}/{name}/data"
    (df.write.partitionBy(*by) if by else df.write).parquet(data)
    # Counted on what was written, by one scan of the columns that the checks read.
    written = spark.read.schema(df.schema).parquet(data)
    found = written.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(c, 1)).alias(f"check {n}") for n, c in checks.items()]).first()
    fingerprints(spark, data).write.parquet(f"{path}/{name}/manifest")
    whole = _checksum(spark.read.parquet(f"{path}/{name}/manifest"))
    counts = {n: found[f"check {n}"] for n in checks}
    audit = {
        "status": "FAIL" if any(counts.values()) else "PASS", "version": version, "rows": found["rows"], "violations": counts,
        "columns": df.columns, "files": whole["files"], "bytes": whole["bytes"], "checksum": whole["checksum"],
    }
    _write_text(spark, f"{path}/{name}/audit.json", json.dumps(audit))
    _swap(spark, path, name)
    return audit


def current(spark: SparkSession, path: str) -> tuple[str, dict]:
    """The current version's folder and audit."""
    name = _read_text(spark, f"{path}/{POINTER}")
    audit = name and _read_text(spark, f"{path}/{name}/audit.json")
    if not audit:
        raise ContractError(f"no audited table in {path}")
    return f"{path}/{name}", json.loads(audit)


def gate(spark: SparkSession, path: str, version: str, columns: list[str] | None = None) -> str:
    """The folder of the current table's data, if its stored audit passed for this version and columns and no file has changed since."""
    folder, audit = current(spark, path)
    if audit["status"] != "PASS":
        raise ContractError(f"the audit failed: {audit['violations']}")
    if audit["version"] != version:
        raise ContractError(f"version {audit['version']} is stored, not {version}")
    if columns is not None and audit["columns"] != list(columns):
        raise ContractError(f"columns {audit['columns']} are stored, not {columns}")
    manifest = spark.read.parquet(f"{folder}/manifest")
    whole = _checksum(manifest)
    if (whole["files"], whole["bytes"], whole["checksum"]) != (audit["files"], audit["bytes"], audit["checksum"]):
        raise ContractError("the manifest is not the audited one")
    changed = [r.file for r in differences(fingerprints(spark, f"{folder}/data"), manifest).where("not same").select("file").limit(5).collect()]
    if changed:
        raise ContractError(f"files differ from the manifest: {changed}")
    return f"{folder}/data"


def load(spark: SparkSession, path: str, version: str, columns: list[str] | None = None) -> DataFrame:
    """The current table, through the gate."""
    data = gate(spark, path, version, columns)
    _, audit = current(spark, path)
    return spark.read.parquet(data).select(*audit["columns"])


def spoil(spark: SparkSession, path: str) -> None:
    """Overwrite one file with other bytes: a fault to try a gate with."""
    files, place = _files(spark, path)
    stream = files.create(place, True)
    stream.write(bytearray(b"spoilt"))
    stream.close()


def prune(spark: SparkSession, path: str) -> int:
    """Delete all versions but the current one (no reader may still use them); how many went."""
    files, place = _files(spark, path)
    keep, gone = _read_text(spark, f"{path}/{POINTER}"), 0
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if status.isDirectory() and name != keep:
            gone += bool(files.delete(status.getPath(), True))
    return gone
