"""Station-record queries: dedup, nearest and as-of nearest stations, weighted weather."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.clean import matches
from panelspark.operators import panel as P, stations as S
from panelspark.plans import adapters as A
from panelspark.plans.registry import Tables, micro, micro_sql, query
from panelspark.session import checkpoint

KEYS = ["station", "day"]


@query(
    "F5",
    lambda d: f"""{A.with_views(d, obs=A.observations)}
      select station, day, arg_min(seq, case when fwi is null then seq + 4000000000000000000 else seq end) as seq,
        arg_min(temp, case when fwi is null then seq + 4000000000000000000 else seq end) as temp from obs group by station, day""",
)
def first_valid_records(t: Tables):
    return S.first_valid(t.sql(A.observations), KEYS, "seq", "fwi").select(*KEYS, "seq", "temp")


@query(
    "F5",
    lambda d: f"""{A.with_views(d, obs=A.observations)},
      seen as (select station, day, seq, fwi, row_number() over w as rn, first_value(fwi ignore nulls) over
          (partition by station, day order by seq rows between unbounded preceding and 1 preceding) as before
        from obs window w as (partition by station, day order by seq))
      select station, day, count(*) - 1 as duplicates, count(case when rn > 1 and before is distinct from fwi then 1 end) as conflicts
      from seen group by station, day""",
)
def duplicate_conflicts(t: Tables):
    return S.duplicate_counts(t.sql(A.observations), KEYS, "seq", "fwi")


@query(
    "G9",
    lambda d: f"""{A.with_views(d, obs=A.observations)}, l as (select seq, day, lag(day) over (order by seq) as previous_day from obs)
      select seq, day, previous_day from l where day < previous_day""",
)
def backward_date_transitions(t: Tables):
    return S.backward_dates(t.sql(A.observations), "seq", "day")


@query(
    "F4 B5",
    lambda d: f"""{A.with_views(d, obs=A.observations, st=A.stations, cells=A.cells)}
      select o.station, min(o.day) as first_seen from obs o join st using (station)
      where lon between (select min(lon) - 25e-2 from cells) and (select max(lon) + 25e-2 from cells)
        and lat between (select min(lat) - 25e-2 from cells) and (select max(lat) + 25e-2 from cells) group by o.station""",
)
def station_registry(t: Tables):
    near = S.buffered_extent_filter(t.sql(A.stations), t.sql(A.cells), buffer=0.25)
    return S.registry(t.sql(A.observations).join(near.select("station"), "station", "left_semi"), "station", "day")


_DIST = """2 * 6371.0088e0 * asin(sqrt(greatest(0e0, least(1e0, pow(sin(radians(s.lat - c.lat) / 2), 2)
      + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))))"""


@query(
    "E4 C5",
    lambda d: f"""{A.with_views(d, st=A.stations, cells=A.cells)},
      pairs as (select c.cell, s.station, {_DIST} as km from cells c cross join st s),
      ranked as (select *, row_number() over (partition by cell order by km, station) as rn from pairs)
      select cell, station, {micro_sql('km')} as km_micro, cast(rn as bigint) as rn from ranked where rn <= 4""",
)
def nearest_stations(t: Tables):
    found = S.nearest(t.sql(A.cells), t.sql(A.stations), 4, "cell", "station", "station")
    return found.select("cell", "station", micro("distance_km").alias("km_micro"), F.col("rank").cast("long").alias("rn"))


def _first_seen(t: Tables):
    """The station registry, written once: several steps read it and it is small next to the records."""
    return checkpoint(t.sql(A.stations).join(S.registry(t.sql(A.observations), "station", "day"), "station"))


def _as_of(t: Tables, k: int = 4):
    stations = _first_seen(t)
    first_day = stations.agg(F.min("first_seen")).first()[0]
    return S.as_of_nearest(t.sql(A.cells), stations, k, "cell", "station", first_day), stations


_AS_OF = f"""reg as (select s.station, s.lon, s.lat, r.first_seen from st s join (select station, min(day) as first_seen from obs group by station) r using (station)),
      dates as (select distinct day from obs),
      cand as (select c.cell, d.day, s.station, {_DIST} as km, s.first_seen from cells c cross join dates d join reg s on s.first_seen <= d.day),
      chosen as (select *, row_number() over (partition by cell, day order by km, first_seen, station) as rn from cand)"""


@query(
    "E5",
    lambda d: f"""{A.with_views(d, st=A.stations, cells=A.cells, obs=A.observations)}, {_AS_OF}
      select cell, station, count(*) as days, min(day) as first_day, max(day) as last_day from chosen where rn <= 4 group by cell, station""",
)
def as_of_nearest_stations(t: Tables):
    """Days served per cell and station, expanded from the validity intervals."""
    validity, _ = _as_of(t)
    inside = S.served_days(validity, t.sql(A.observations).select("day").distinct(), "day")
    return inside.groupBy("cell", "station").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def daily_weather(t: Tables):
    """Corrected daily weather of every cell on every observed day: as-of stations, first-valid records, weighted means; a day without a record is missing."""
    validity, stations = _as_of(t)
    records = S.first_valid(t.sql(A.observations), KEYS, "seq", "fwi").withColumn("imputed", matches(F.col("flag"), "R|N"))
    chosen = S.served_days(validity, t.sql(A.observations).select("day").distinct(), "day")
    served = chosen.join(records, ["station", "day"], "left")
    daily = S.weighted_day(served, ["cell", "day"], ["temp", "fwi", "rain"], "fwi", "imputed", "calcstatus")
    choices = S.eligible_counts(stations, daily, "day", 4)
    return daily.join(choices, "day").withColumn("coverage_fraction", F.col("station_count") / F.col("choices"))


_DAILY = f"""{_AS_OF},
      rec as (select station, day, arg_min(struct_pack(temp := temp, fwi := fwi, rain := rain, calcstatus := calcstatus, flag := flag),
          case when fwi is null then seq + 4000000000000000000 else seq end) as r from obs group by station, day),
      got as (select c.cell, c.day, c.km, rec.r.temp as temp, rec.r.fwi as fwi, rec.r.rain as rain, rec.r.calcstatus as calcstatus, rec.r.flag as flag,
          1 / pow(greatest(c.km, 1), 2) as w from chosen c left join rec on rec.station = c.station and rec.day = c.day where c.rn <= 4),
      daily as (select cell, day, count(fwi) as station_count, min(case when fwi is not null then km end) as nearest_km,
          avg(case when fwi is not null then case when flag in ('R', 'N') then 1e0 else 0e0 end end) as imputed_fraction,
          avg(case when fwi is not null then case when calcstatus <> 0 then 1e0 else 0e0 end end) as status_fraction,
          case when count(fwi) = 0 then 1 else 0 end as missing,
          sum(case when fwi is not null then w * temp end) / sum(case when fwi is not null then w end) as temp,
          sum(w * fwi) / sum(case when fwi is not null then w end) as fwi,
          sum(case when fwi is not null then w * rain end) / sum(case when fwi is not null and rain is not null then w end) as rain
        from got group by cell, day),
      choices as (select d.day, least(4, (select count(*) from reg where first_seen <= d.day)) as choices from dates d)"""


@query(
    "E5 F2 F3 F5 B10",
    lambda d: f"""{A.with_views(d, st=A.stations, cells=A.cells, obs=A.observations)}, {_DAILY}
      select cell, day, station_count, {micro_sql('nearest_km')} as nearest_micro, {micro_sql('station_count / cast(choices as double)')} as coverage_micro,
        {micro_sql('imputed_fraction')} as imputed_micro, {micro_sql('status_fraction')} as status_micro, missing,
        {micro_sql('temp')} as temp_micro, {micro_sql('fwi')} as fwi_micro, {micro_sql('rain')} as rain_micro from daily join choices using (day)""",
)
def weighted_daily_weather(t: Tables):
    w = daily_weather(t)
    return w.select(
        "cell", "day", "station_count", micro("nearest_km").alias("nearest_micro"), micro("coverage_fraction").alias("coverage_micro"),
        micro("imputed_fraction").alias("imputed_micro"), micro("status_fraction").alias("status_micro"), "missing",
        micro("temp").alias("temp_micro"), micro("fwi").alias("fwi_micro"), micro("rain").alias("rain_micro"),
    )


@query("D7 E13", lambda d: f"""{A.with_views(d, obs=A.observations)}, need as (select distinct day - k as day from obs, unnest([1, 2, 3, 4, 5, 6, 7]) as u(k) where flag = 'A') select station, day, seq from obs where day in (select day from need)""")
def required_records(t: Tables):
    """Records dated on a day that some accepted issue day looks back on."""
    obs = t.sql(A.observations)
    return obs.join(P.required_days(obs.where("flag = 'A'"), "day", 7), "day", "left_semi").select("station", "day", "seq")


@query(
    "E6 G4",
    lambda d: f"""{A.with_views(d, obs=A.observations)},
      daily as (select station, day, arg_min(struct_pack(v := rain), case when fwi is null then seq + 4000000000000000000 else seq end).v as rain from obs group by station, day),
      issue as (select distinct station, day from obs)
      select i.station, i.day, count(p.rain) as coverage_days, cast(case when count(p.rain) = 7 then sum(p.rain) end as bigint) as rain_7d
      from issue i left join daily p on p.station = i.station and p.day between i.day - 7 and i.day - 1 group by i.station, i.day""",
)
def complete_rain_window(t: Tables):
    """Rain of the seven days before each issue day, only when all seven are present."""
    obs = t.sql(A.observations)
    daily = S.first_valid(obs, KEYS, "seq", "fwi").select(*KEYS, "rain")
    return P.complete_window_sum(daily, ["station"], "day", "rain", 7, obs.select(*KEYS).distinct())


@query(
    "E6",
    lambda d: f"""{A.with_views(d, obs=A.observations)}, rec as (select distinct station, day from obs)
      select count(case when i.station % 10 = 0 and p.day is not null then 1 end) as violations, count(p.day) as available, count(*) as "rows"
      from rec i left join rec p on p.station = i.station and p.day = i.day - 1""",
)
def prior_day_leakage(t: Tables):
    """Features dated the day before, but for planted stations whose feature carries the issue day's own date."""
    records = t.sql(A.observations).select(*KEYS).distinct()
    joined = P.prior_day(records, records, ["station"], "day")
    leaking = (F.col("station") % 10 == 0) & F.col("observation_day").isNotNull()
    return P.leakage_violations(joined.withColumn("observation_day", F.when(leaking, F.col("day")).otherwise(F.col("observation_day"))), "day")


@query(
    "A10",
    lambda d: f"{A.with_views(d, obs=A.observations)} select count(*) as \"rows\", min(day) as first_day, max(day) as last_day from obs",
)
def source_profile(t: Tables):
    return t.sql(A.observations).agg(F.count(F.lit(1)).alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
