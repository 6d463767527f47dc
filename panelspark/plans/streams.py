"""Streaming queries over the events, orders and line items, drained to files and compared with batch SQL.

A watermark closes everything but the newest data, so each source gets one closing
row after everything else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelspark.plans import adapters as A
from panelspark.plans.registry import Tables, query
from panelspark.session import shared_folder
from panelspark.streaming import incremental as N


def _stream(t: Tables, rows: DataFrame, closing: dict[str, Column], name: str) -> DataFrame:
    """The rows and one closing row - the column maxima with `closing` applied - as a file stream."""
    last = rows.agg(*[F.max(c).alias(c) for c in rows.columns]).withColumns(closing)
    last = last.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in rows.schema.fields])
    folder = shared_folder(t.spark, name)
    rows.unionByName(last).write.parquet(folder)
    return t.spark.readStream.schema(rows.schema).parquet(folder)


def _drain(t: Tables, stream: DataFrame) -> DataFrame:
    return N.drain(stream, shared_folder(t.spark, "out"), shared_folder(t.spark, "state"))


@query("N1", lambda d: f"""{A.with_views(d, det=A.detections)}, s as (select *, case when t - lag(t) over (partition by entity order by t, id) <= 5400 then 0 else 1 end as f from det),
      g as (select *, sum(f) over (partition by entity order by t, id) as n from s) select entity, count(*) as "rows", min(t) as first_t, max(t) as last_t from g group by entity, n""")
def stream_gap_sessions(t: Tables):
    rows = t.sql(A.detections).select("entity", F.timestamp_seconds("t").alias("ts"))
    source = _stream(t, rows, {"entity": F.lit(-1), "ts": F.col("ts") + F.expr("interval 30 days")}, "sessions")
    done = _drain(t, N.gap_sessions(source, "entity", "ts"))  # dropping the closing row earlier would drop its watermark
    return done.where("entity <> -1").select("entity", "rows", F.unix_timestamp("first_time").alias("first_t"), F.unix_timestamp("last_time").alias("last_t"))


@query("N2", lambda d: f"""{A.with_views(d, ev=A.ignitions)}, c as (select cell, day, count(*) as n from ev group by cell, day)
      select cell, day, cast(coalesce(sum(n) over (partition by cell order by day range between 30 preceding and 1 preceding), 0) as bigint) as past_events, day - lag(day) over (partition by cell order by day) as days_since from c""")
def stream_past_history(t: Tables):
    """Every event day is also an issue day: the answer must not see its own day."""
    ev = t.sql(A.ignitions)
    clock = F.timestamp_seconds(F.col("day") * 86400)
    rows = ev.select("cell", "day", F.lit("event").alias("kind"), clock.alias("ts")).union(ev.select("cell", "day", F.lit("issue"), clock).distinct())
    source = _stream(t, rows, {"cell": F.lit(-1), "kind": F.lit("event"), "day": F.col("day") + 60, "ts": F.col("ts") + F.expr("interval 60 days")}, "history")
    return _drain(t, N.past_history(source, 30)).where("cell <> -1")


@query("N3 F5", lambda d: f"""{A.with_views(d, obs=A.observations)}
      select station, day, arg_min(seq, case when fwi is null then seq + 4000000000000000000 else seq end) as seq, cast(arg_min(struct_pack(v := fwi), case when fwi is null then seq + 4000000000000000000 else seq end).v as double) as valid from obs group by station, day""")
def stream_first_valid_records(t: Tables):
    rows = t.sql(A.observations).select("station", "day", "seq", F.col("fwi").cast("double").alias("valid"), F.timestamp_seconds(F.col("day") * 86400).alias("ts"))
    source = _stream(t, rows, {"station": F.lit(-1), "day": F.col("day") + 60, "ts": F.col("ts") + F.expr("interval 60 days")}, "records")
    return _drain(t, N.first_valid_records(source)).where("station <> -1")


@query("N4", lambda d: f"""{A.with_views(d, obs=A.observations)}, reg as (select station, min(day) as first_seen from obs where flag <> 'N' group by station)
      select station, day, seq, first_seen from obs join reg using (station) where first_seen <= day""")
def stream_station_registry(t: Tables):
    """Registry kept by a stream of accepted records, then joined to the stream of all records."""
    obs = t.sql(A.observations).select("station", "day", "seq", "flag")
    folder = shared_folder(t.spark, "obs")
    obs.write.parquet(folder)
    stream = t.spark.readStream.schema(obs.schema).parquet(folder)
    registry = shared_folder(t.spark, "registry")
    keeper = stream.where("flag <> 'N'").writeStream.foreachBatch(N.registry_sink(t.spark, registry)).option("checkpointLocation", shared_folder(t.spark, "state")).trigger(availableNow=True).start()
    keeper.awaitTermination()
    return _drain(t, N.eligible(stream, N.read_registry(t.spark, registry))).select("station", "day", "seq", "first_seen")
