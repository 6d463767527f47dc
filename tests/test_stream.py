"""Streaming operators: lateness and replay; equality with batch is checked by the registered queries."""

import datetime as dt

from pyspark.sql import functions as F

from panelspark.streaming import incremental as N


def files(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_history_over_several_triggers_ignores_its_own_day_and_the_future(spark, tmp_path):
    day = lambda d: dt.datetime(1970, 1, 1) + dt.timedelta(days=d)
    row = lambda d, kind: (1, d, kind, day(d))
    batches = [[row(1, "event"), row(2, "event"), row(2, "issue")], [row(3, "issue"), row(4, "event"), row(5, "issue")], [row(40, "issue"), row(90, "event")], [row(91, "event")]]
    stream = files(spark, tmp_path / "in", batches, "cell long, day long, kind string, ts timestamp")
    done = N.drain(N.past_history(stream, 30), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.day: (r.past_events, r.days_since) for r in done.collect()}
    assert got == {2: (1, 1), 3: (2, 1), 5: (3, 1), 40: (0, 36)}


def test_registry_keeps_first_day_and_survives_a_replayed_batch(spark, tmp_path):
    folder = str(tmp_path / "registry")
    merge = N.registry_sink(spark, folder)
    batch = lambda rows: spark.createDataFrame(rows, "station long, day long")
    merge(batch([(1, 5), (2, 9)]), 0)
    merge(batch([(1, 3), (3, 7)]), 1)
    merge(batch([(1, 3), (3, 7)]), 1)
    assert {r.station: r.first_seen for r in N.read_registry(spark, folder).collect()} == {1: 3, 2: 9, 3: 7}
    rows = batch([(1, 2), (1, 4), (9, 9)])
    assert [(r.station, r.day) for r in N.eligible(rows, N.read_registry(spark, folder)).collect()] == [(1, 4)]


def test_sessions_close_behind_the_watermark_and_drop_late_rows(spark, tmp_path):
    at = lambda minute: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)
    batches = [[("f", at(0)), ("f", at(90))], [("f", at(2000))], [("g", at(6000))], [("f", at(10))], [("f", at(9000))]]
    stream = files(spark, tmp_path / "in", batches, "entity string, ts timestamp")
    done = N.drain(N.gap_sessions(stream, "entity", "ts", "90 minutes", "10 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(r["rows"] for r in done.where(F.col("first_time") < F.lit(at(5000))).collect()) == [1, 2]


def test_first_valid_records_keep_the_first_valid_row_of_a_closed_day_in_one_aggregate(spark, tmp_path):
    at = lambda d, hour=0: dt.datetime(1970, 1, 1) + dt.timedelta(days=d, hours=hour)
    row = lambda station, d, seq, valid, hour=0: (station, d, seq, valid, at(d, hour))
    batches = [
        [row(1, 5, 3, 2.0), row(1, 5, 2, None), row(2, 5, 9, None), row(2, 5, 8, float("nan"), 7)], [row(1, 5, 4, 1.0, 3), row(1, 6, 1, 4.0)],
        [row(3, 40, 1, 1.0)], [row(3, 41, 1, 2.0)], [row(1, 5, 1, 9.0), row(3, 40, 0, 5.0)], [row(9, 90, 1, 1.0)],
    ]
    stream = files(spark, tmp_path / "in", batches, "station long, day long, seq long, valid double, ts timestamp")
    found = N.first_valid_records(stream)
    assert "InPandas" not in found._jdf.queryExecution().analyzed().toString()
    done = N.drain(found, str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted(map(tuple, done.collect())) == [(1, 5, 3, 2.0), (1, 6, 1, 4.0), (2, 5, 8, None), (3, 40, 0, 5.0), (3, 41, 1, 2.0)]
    assert N.STORE not in spark.conf.getAll
