"""Streaming forms of the incremental operators: sessions, past-only history, first-valid records, as-of registry.

Event time is a timestamp column; lateness is bounded by its watermark. State per
key is bounded: a history holds at most one count per day of its lookback, a
record holds one row per station and day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY_MS = 86_400_000


def gap_sessions(stream: DataFrame, entity: str, time: str, gap: str = "90 minutes", late: str = "1 hour") -> DataFrame:
    """Closed sessions per entity; a step of exactly the gap does not split one. Append mode."""
    counted = stream.withWatermark(time, late).groupBy(entity, F.session_window(time, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )
    return counted.select(entity, "first_time", "last_time", "rows")


HISTORY = "cell long, day long, past_events long, days_since long"
HISTORY_STATE = "days array<long>, counts array<long>, last long, pending array<long>"


def past_history(stream: DataFrame, lookback: int, late: str = "1 day") -> DataFrame:
    """Events in [t - lookback, t - 1] and days since the last earlier event, for every issue row.

    Input rows: cell, day (whole day number), kind ('event' or 'issue'), ts (the
    row's clock). An issue is answered once the watermark has passed the start of
    its day, so that every event of the earlier days has been seen; counts older
    than the lookback of every open issue are dropped from the state.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, counts, last, pending = state.get if state.exists else ([], [], None, [])
        seen, waiting = dict(zip(days, counts)), set(pending)
        for batch in batches:
            events = batch.loc[batch["kind"] == "event", "day"].value_counts()
            for day, n in events.items():
                seen[int(day)] = seen.get(int(day), 0) + int(n)
            waiting |= {int(d) for d in batch.loc[batch["kind"] == "issue", "day"]}
        watermark = state.getCurrentWatermarkMs()
        ready = sorted(d for d in waiting if d * DAY_MS <= watermark)
        rows = []
        for issue in ready:
            earlier = [d for d in seen if d < issue]
            newest = max([*earlier, *([last] if last is not None and last < issue else [])], default=None)
            rows.append((key[0], issue, sum(seen[d] for d in earlier if d >= issue - lookback), None if newest is None else issue - newest))
        waiting -= set(ready)
        # Later issues start after the watermark's day, so older counts can only matter through `last`.
        horizon = min([*waiting, watermark // DAY_MS]) - lookback
        gone = [d for d in seen if d < horizon]
        last = max([*gone, *([last] if last is not None else [])], default=None)
        kept = sorted(d for d in seen if d >= horizon)
        state.update((kept, [seen[d] for d in kept], last, sorted(waiting)))
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting) * DAY_MS, watermark + 1))
        frame = pd.DataFrame(rows, columns=["cell", "day", "past_events", "days_since"])
        yield frame.astype({"cell": "int64", "day": "int64", "past_events": "int64", "days_since": "Int64"})

    timed = stream.withWatermark("ts", late)
    return timed.groupBy("cell").applyInPandasWithState(update, HISTORY, HISTORY_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def first_valid_records(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """One record per (station, day): the first in source order, replaced once by the first valid one; emitted when its day is closed. Append mode.

    Input rows: station, day, seq, valid (nullable; NaN is not valid), ts (a time within the day). A day is
    closed by the first trigger that starts with the watermark past its end; rows that arrive later are dropped, which is the
    lateness policy. State is one record per open (station, day), kept and merged by Spark's own aggregate, so no station is in one task's hands.
    """
    valid = F.nanvl("valid", F.lit(None).cast("double"))
    best = F.min(F.struct(valid.isNull().alias("missing"), F.col("seq").cast("long").alias("seq"), valid.alias("valid")))
    # `day` is the window's day; as a key it only comes along.
    kept = stream.withWatermark("ts", late).groupBy("station", F.col("day").cast("long").alias("day"), F.window("ts", "1 day")).agg(best.alias("r"))
    return kept.select(F.col("station").cast("long").alias("station"), "day", "r.seq", "r.valid")


def registry_sink(spark: SparkSession, folder: str, station: str = "station", day: str = "day") -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function that keeps first-seen days in a folder of versions.

    Each batch writes one new version merged from the previous one, named by its
    batch id, so a batch replayed after a failure writes the same version again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        arrivals = batch.groupBy(station).agg(F.min(day).alias("first_seen"))
        known = read_registry(spark, folder, before=batch_id)
        merged = arrivals if known is None else known.unionByName(arrivals).groupBy(station).agg(F.min("first_seen").alias("first_seen"))
        merged.write.mode("overwrite").parquet(f"{folder}/version={batch_id}")

    return merge


def read_registry(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest registry version (older than `before`, when given)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    names = [s.getPath().getName() for s in files.listStatus(path)]
    versions = [int(n.split("=")[1]) for n in names if n.startswith("version=")]
    usable = [v for v in versions if before is None or v < before]
    return spark.read.parquet(f"{folder}/version={max(usable)}") if usable else None


def eligible(stream: DataFrame, registry: DataFrame, station: str = "station", day: str = "day") -> DataFrame:
    """Stream-static join: rows of stations already seen on or before the row's day."""
    return stream.join(registry, station).where(F.col("first_seen") <= F.col(day))


STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, folder: str, checkpoint_folder: str) -> DataFrame:
    """Process everything available into parquet files and read them back. State beyond memory goes to the executors' disks, unless the session names a store."""
    conf = stream.sparkSession.conf
    named = STORE in conf.getAll
    if not named:
        conf.set(STORE, ON_DISK)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint_folder).trigger(availableNow=True).start()
    finally:
        if not named:
            conf.unset(STORE)
    query.awaitTermination()
    return stream.sparkSession.read.parquet(folder)
