"""Stored tables: all-or-nothing replacement, and gates that can refuse."""

import os

import pytest
from pyspark.sql import functions as F

from panelspark.contracts import ContractError
from panelspark.sources import stored


def table(spark, n=20):
    return spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("part"), (F.col("id") * 2).alias("v"))


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture()
def path(spark, tmp_path):
    where = str(tmp_path / "table")
    stored.store(table(spark), where, "v1", {"negative": F.col("v") < 0}, by=["part"])
    return where


def test_round_trip_and_audit(spark, path):
    back = stored.load(spark, path, "v1", ["id", "part", "v"])
    assert back.columns == ["id", "part", "v"] and ids(back) == list(range(20))
    folder, audit = stored.current(spark, path)
    assert audit["rows"] == 20 and audit["violations"] == {"negative": 0} and audit["status"] == "PASS"
    assert audit["files"] == spark.read.parquet(f"{folder}/manifest").count() > 0
    assert "part=1" in back.where("part = 1")._jdf.queryExecution().toString() or "PartitionFilters" in back.where("part = 1")._jdf.queryExecution().toString()


def test_replace_and_prune(spark, path):
    with pytest.raises(ContractError, match="there is a table"):
        stored.store(table(spark, 5), path, "v2")
    reader = stored.load(spark, path, "v1")
    stored.store(table(spark, 5), path, "v2", replace=True)
    assert ids(stored.load(spark, path, "v2")) == list(range(5))
    assert ids(reader) == list(range(20))  # who had opened the old version still reads it
    assert stored.prune(spark, path) == 1 and stored.prune(spark, path) == 0
    assert ids(stored.load(spark, path, "v2")) == list(range(5))


def test_a_write_that_dies_leaves_the_old_table(spark, path):
    """The second write fails in a task after others have written their files."""
    broken = table(spark, 1000).repartition(4).withColumn("v", F.when(F.col("id") == 999, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        stored.store(broken, path, "v2", replace=True)
    assert ids(stored.load(spark, path, "v1")) == list(range(20))


@pytest.mark.parametrize("step", ["fingerprints", "_checksum", "_swap"])
def test_a_driver_that_dies_before_the_swap_leaves_the_old_table(spark, path, step, monkeypatch):
    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(stored, step, killed)
        with pytest.raises(KeyboardInterrupt):
            stored.store(table(spark, 3), path, "v2", replace=True)
    assert ids(stored.load(spark, path, "v1")) == list(range(20))
    stored.store(table(spark, 3), path, "v2", replace=True)
    assert ids(stored.load(spark, path, "v2")) == [0, 1, 2]


def test_gate_refuses(spark, path, tmp_path):
    with pytest.raises(ContractError, match="version v1 is stored"):
        stored.load(spark, path, "v2")
    with pytest.raises(ContractError, match="columns"):
        stored.load(spark, path, "v1", ["part", "id", "v"])
    with pytest.raises(ContractError, match="no audited table"):
        stored.load(spark, str(tmp_path / "none"), "v1")
    failed = str(tmp_path / "failed")
    assert stored.store(table(spark), failed, "v1", {"large": F.col("v") > 30, "null": F.col("v").isNull()})["violations"] == {"large": 4, "null": 0}
    with pytest.raises(ContractError, match="'large': 4"):
        stored.load(spark, failed, "v1")


@pytest.mark.parametrize("fault", ["changed", "missing", "added", "manifest"])
def test_gate_refuses_other_files(spark, path, fault):
    data = stored.gate(spark, path, "v1")
    one = os.path.join(data, stored.fingerprints(spark, data).agg(F.min("file")).first()[0])
    if fault == "changed":
        stored.spoil(spark, one)
    elif fault == "missing":
        os.remove(one)
    elif fault == "added":
        table(spark, 1).write.mode("append").partitionBy("part").parquet(data)
    else:  # the manifest follows a changed file, the audit does not
        stored.spoil(spark, one)
        folder = stored.current(spark, path)[0]
        stored.fingerprints(spark, data).write.mode("overwrite").parquet(f"{folder}/manifest")
    with pytest.raises(ContractError, match="manifest"):
        stored.load(spark, path, "v1")


def test_empty_table(spark, tmp_path):
    where = str(tmp_path / "empty")
    assert stored.store(table(spark, 0), where, "v1", {"any": F.lit(True)})["rows"] == 0
    assert stored.load(spark, where, "v1").columns == ["id", "part", "v"]
