"""Session settings and the shared folder used to cut long lineages."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benchmarks; a cluster supplies its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config(CHECKPOINT_CONF, tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the one the cluster names in ``spark.checkpoint.dir``.

    A local session, whose only machine is this one, gets a temporary folder where the
    setting is missing; on a cluster a missing setting is an error, as executors would
    each write to a disk of their own.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back: a short lineage that outlives lost executors.

    A written table is used rather than `DataFrame.checkpoint`, which computes its
    last stage twice, and it keeps column pruning and size estimates.
    """
    path = shared_folder(df.sparkSession, "checkpoint")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame) -> int:
    """How many pieces to cut one large ordered group into."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
