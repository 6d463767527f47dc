"""Interval weather, trailing windows, recurrences and fire-weather formula queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import fire, geo
from panelspark.operators import intervals as I, recurrence as R, spatial as G
from panelspark.plans import adapters as A
from panelspark.plans.registry import Tables, micro, micro_sql, query


def milli(column):
    column = F.col(column) if isinstance(column, str) else column
    return F.floor(column * 1000 + 0.5).cast("bigint")


def milli_sql(expression: str) -> str:
    return f"cast(floor(({expression}) * 1000 + 0.5) as bigint)"


def _intervals(t: Tables):
    return I.consecutive(t.sql(A.detections), "entity", "t").withColumn("site", F.col("entity") % 5)


def _hours(t: Tables):
    u, v = geo.wind_vector(F.col("speed"), F.col("direction"))
    return t.sql(A.site_hours).withColumns({"u": u, "v": v})


_IV = """iv as (select entity, entity % 5 as site, lag(t) over (partition by entity order by t) as start, t as stop from (select distinct entity, t from det))"""
_UV = "-speed * sin(radians(direction)) as u, -speed * cos(radians(direction)) as v"


@query(
    "E10 D7",
    lambda d: f"""{A.with_views(d, det=A.detections, hrs=A.site_hours)}, {_IV}
      select entity, start, stop, h.t as hour, h.temp from iv join hrs h on h.site = iv.site and h.t > iv.start and h.t <= iv.stop""",
)
def interval_rows(t: Tables):
    met = I.interval_join(_intervals(t), _hours(t), ["site"], "t", 86400)
    return met.select("entity", "start", F.col("end").alias("stop"), F.col("t").alias("hour"), "temp")


@query(
    "E10 F13 C9 C10",
    lambda d: f"""{A.with_views(d, det=A.detections, hrs=A.site_hours)}, {_IV}, w as (select *, {_UV} from hrs),
      s as (select entity, stop, count(*) as hours, avg(u) as u, avg(v) as v, avg(speed) as speed, max(speed) as speed_max, avg(temp) as temp, max(temp) as temp_max,
        avg(rh) as rh, min(rh) as rh_min, sum(rain) as rain from iv join w on w.site = iv.site and w.t > iv.start and w.t <= iv.stop group by entity, stop)
      select entity, stop, hours, {micro_sql('u')} as u_micro, {micro_sql('v')} as v_micro, {micro_sql('speed')} as speed_micro, cast(speed_max as bigint) as speed_max,
        {micro_sql('temp')} as temp_micro, temp_max, {micro_sql('rh')} as rh_micro, rh_min, cast(rain as bigint) as rain,
        {micro_sql('sqrt(u * u + v * v) / nullif(speed, 0)')} as steady_micro,
        case when sqrt(u * u + v * v) >= 1e-9 then {micro_sql('degrees(atan2(-u, -v)) + case when atan2(-u, -v) < 0 then 360 else 0 end')} end as direction_micro
      from s""",
)
def interval_weather(t: Tables):
    met = I.interval_join(_intervals(t), _hours(t), ["site"], "t", 86400)
    more = {"temp": F.avg("temp"), "temp_max": F.max("temp"), "rh": F.avg("rh"), "rh_min": F.min("rh"), "rain": F.sum("rain")}
    w = I.wind_summary(met, ["entity", "end"], "u", "v", "speed", more)
    return w.select(
        "entity", F.col("end").alias("stop"), "hours", micro("wind_u").alias("u_micro"), micro("wind_v").alias("v_micro"), micro("speed_mean").alias("speed_micro"),
        F.col("speed_max").cast("bigint").alias("speed_max"), micro("temp").alias("temp_micro"), "temp_max", micro("rh").alias("rh_micro"), "rh_min",
        F.col("rain").cast("bigint").alias("rain"), micro("steadiness").alias("steady_micro"), micro("direction").alias("direction_micro"),
    )


@query(
    "E11",
    lambda d: f"""{A.with_views(d, det=A.detections, hrs=A.hourly)},
      st as (select distinct entity, cast(floor(t / 3600e0) as bigint) * 3600 + 3600 as start, cast(floor(t / 3600e0) as bigint) * 3600 + 18000 as stop from det),
      ins as (select st.entity, st.start, st.stop, h.t as hour, h.temp from st join hrs h on h.entity = st.entity and h.t >= st.start and h.t < st.stop),
      emp as (select * from st where not exists (select 1 from ins where ins.entity = st.entity and ins.start = st.start)),
      nxt as (select emp.entity, emp.start, emp.stop, h.t as hour, h.temp, row_number() over (partition by emp.entity, emp.start
          order by case when h.t >= emp.start then 0 else 1 end, case when h.t >= emp.start then h.t else -h.t end) as rn from emp join hrs h using (entity))
      select entity, start, stop, hour, temp from ins union all select entity, start, stop, hour, temp from nxt where rn = 1""",
)
def step_hours_with_fallback(t: Tables):
    """Four-hour windows after each detection hour; an empty one takes the next hour on record, else the last."""
    hour = F.floor(F.col("t") / 3600).cast("long") * 3600
    steps = t.sql(A.detections).select("entity", (hour + 3600).alias("start"), (hour + 18000).alias("end")).distinct()
    rows = I.step_rows(steps, t.sql(A.hourly), ["entity"], "t", 86400, ["temp"])
    return rows.select("entity", "start", F.col("end").alias("stop"), F.col("t").alias("hour"), "temp")


def _lookup_sql(order: str) -> str:
    return f"""q as (select distinct entity, cast(floor(t / 86400e0) as bigint) * 86400 + 43200 as t from det),
      c as (select q.entity, q.t, h.temp, h.t as found_at, row_number() over (partition by q.entity, q.t order by {order}) as rn from q join hrs h using (entity))
      select entity, t, temp, found_at from c where rn = 1"""


@query(
    "E17",
    lambda d: f"""{A.with_views(d, det=A.detections, hrs=A.hourly)},
      {_lookup_sql('case when h.t >= q.t then 0 else 1 end, case when h.t >= q.t then h.t else -h.t end')}""",
)
def lookup_next_or_last(t: Tables):
    noon = t.sql(A.detections).select("entity", (F.floor(F.col("t") / 86400).cast("long") * 86400 + 43200).alias("t")).distinct()
    return I.as_of(noon, t.sql(A.hourly), ["entity"], "t", ["temp"], "next_or_last").select("entity", "t", "temp", "found_at")


@query(
    "E17",
    lambda d: f"""{A.with_views(d, det=A.detections, hrs=A.hourly)},
      {_lookup_sql('case when h.t <= q.t then 0 else 1 end, case when h.t <= q.t then -h.t else h.t end')}""",
)
def lookup_last_or_first(t: Tables):
    noon = t.sql(A.detections).select("entity", (F.floor(F.col("t") / 86400).cast("long") * 86400 + 43200).alias("t")).distinct()
    return I.as_of(noon, t.sql(A.hourly), ["entity"], "t", ["temp"], "last_or_first").select("entity", "t", "temp", "found_at")


@query(
    "G5",
    lambda d: f"""{A.with_views(d, hrs=A.site_hours)},
      s as (select site, t, sum(rain) over w as rain_24h, count(rain) over w as n from hrs window w as (partition by site order by t range between 82800 preceding and current row))
      select site, t, cast(rain_24h as bigint) as rain_24h from s where n = 24 and t % 86400 = 43200""",
)
def trailing_rain_at_noon(t: Tables):
    return I.trailing_sum_at(t.sql(A.site_hours), "site", "t", "rain", 24, 12, "rain_24h").select("site", "t", F.col("rain_24h").cast("long").alias("rain_24h"))


def _bounds(t: Tables):
    return t.sql(A.detections).where("power > 5000").groupBy("entity").agg(F.min("t").alias("first_time"), F.max("t").alias("last_time"))


@query(
    "B17",
    lambda d: f"""{A.with_views(d, det=A.detections, hrs=A.hourly)},
      b as (select entity, cast(floor(min(t) / 86400e0) as bigint) * 86400 as lo, cast(floor(max(t) / 86400e0) as bigint) * 86400 as hi from det where power > 5000 group by entity)
      select h.entity, h.t, h.temp from hrs h join b using (entity) where h.t >= lo - 86400 and h.t < hi + 172800""",
)
def clipped_hours(t: Tables):
    """Hours around each entity's strong detections only."""
    return I.clip_to_entity(t.sql(A.hourly).select("entity", "t", "temp"), _bounds(t), "entity", "t")


@query(
    "B17",
    lambda d: f"""{A.with_views(d, det=A.detections)},
      m as (select entity, min(cast(floor(t / 86400e0) as bigint) - 19722) as c from det group by entity)
      select count(*) as entities, count(case when c < 3 then 1 end) as short from m""",
)
def short_spinup(t: Tables):
    daily = t.sql(A.detections).withColumn("c", F.floor(F.col("t") / 86400) - 19722)
    return I.short_spinup(daily, "entity", "c", 3)


_SPINE = """spine as (select native, start from (select distinct native from b) as x,
        unnest(generate_series((select min(start) from b), (select max(start) from b), 10800)) as g(start)),
      full_ as (select s.native, s.start, case when b.native is null then 0 else b.n end as n from spine s left join b on b.native = s.native and b.start = s.start)"""


@query(
    "G11",
    lambda d: f"""{A.with_views(d, b=A.bins)}, {_SPINE}
      select native, start, cast(case when count(n) over w8 = 8 then sum(n) over w8 end as bigint) as n_8, cast(case when count(n) over w56 = 56 then sum(n) over w56 end as bigint) as n_56
      from full_ window w8 as (partition by native order by start rows between 7 preceding and current row), w56 as (partition by native order by start rows between 55 preceding and current row)""",
)
def trailing_bin_sums(t: Tables):
    spine = I.complete_spine(t.sql(A.bins), ["native"], "start", 10800)
    return I.trailing_bins(spine, ["native"], "start", "n", [8, 56]).select("native", "start", "n_8", "n_56")


@query(
    "G12",
    lambda d: f"""{A.with_views(d, b=A.bins)},
      i as (select distinct cast(floor(start / 86400e0) as bigint) * 86400 + 18000 + cast(floor(start / 86400e0) as bigint) % 5 * 2000 as issue from b)
      select issue, max(start + 10800) as bin_end, issue - max(start + 10800) as lag_seconds from i left join b on start + 10800 <= issue group by issue""",
)
def last_complete_bin(t: Tables):
    day = F.floor(F.col("start") / 86400).cast("long")
    bins = t.sql(A.bins)
    issues = bins.select((day * 86400 + 18000 + day % 5 * 2000).alias("issue")).distinct()
    return I.last_complete_bin(issues, bins.select((F.col("start") + 10800).alias("bin_end")), "issue", "bin_end")


@query(
    "E15",
    lambda d: f"""{A.with_views(d, b=A.bins, c=A.cells)},
      w as (select cell as target, native, (cell * 7 + native * 3) % 5 as w from c, (select distinct native from b) where (cell + native) % 3 = 0)
      select target, start, cast(case when max(case when w > 0 and n is null then 1 else 0 end) = 1 then null else sum(w * n) end as bigint) as n
      from w join b using (native) group by target, start""",
)
def area_weighted_regrid(t: Tables):
    bins = t.sql(A.bins)
    natives = F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))
    weights = t.sql(A.cells).select(F.col("cell").alias("target"), F.explode(natives).alias("native")).where((F.col("target") + F.col("native")) % 3 == 0)
    weights = weights.withColumn("w", (F.col("target") * 7 + F.col("native") * 3) % 5)
    return G.regrid(bins, weights, ["start"], "target", "native", "n")


_CODES = """d as (select *, row_number() over (partition by site, season order by day) as i,
        case when month in (1) then 6.5 when month = 2 then 7.5 when month = 3 then 9 when month = 4 then 12.8 when month in (5, 6) then 13.9 when month = 7 then 12.4
          when month = 8 then 10.9 when month = 9 then 9.4 when month = 10 then 8 when month = 11 then 7 else 6 end :: double as le,
        case when month in (11, 12, 1, 2, 3) then -1.6 when month = 4 then 0.9 when month = 5 then 3.8 when month = 6 then 5.8 when month = 7 then 6.4
          when month = 8 then 5.0 when month = 9 then 2.4 else 0.4 end :: double as lf from w),
      e as (select *, least(rh, 100) as h, 0.942 * pow(least(rh, 100), 0.679) + 11 * exp((least(rh, 100) - 100) / 10) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * least(rh, 100))) as ed,
        0.618 * pow(least(rh, 100), 0.753) + 10 * exp((least(rh, 100) - 100) / 10) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * least(rh, 100))) as ew from d),
      rec as (
        select site, season, day, cast(0 as bigint) as i, 85.0::double as ffmc, 6.0::double as dmc, 15.0::double as dc, 0.0::double as wind from e where i = 1
        union all
        select site, season, day, i, greatest(0, least(101, 59.5 * (250 - m2) / (147.2 + m2))) as ffmc,
          dmc2 + 1.894 * (greatest(temp, -1.1) + 1.1) * (100 - h) * le * 1e-4 as dmc,
          dc2 + greatest((0.36 * (greatest(temp, -2.8) + 2.8) + lf) / 2, 0) as dc, wind
        from (select *, case
              when mo > ed then ed + (mo - ed) * pow(10, -0.581 * exp(0.0365 * temp) * (0.424 * (1 - pow(h / 100, 1.7)) + 0.0694 * sqrt(wind) * (1 - pow(h / 100, 8))))
              when mo < ew then ew - (ew - mo) * pow(10, -0.581 * exp(0.0365 * temp) * (0.424 * (1 - pow((100 - h) / 100, 1.7)) + 0.0694 * sqrt(wind) * (1 - pow((100 - h) / 100, 8))))
              else mo end as m2
          from (select *, case when rain > 0.5 then least(250, m1 + 42.5 * (rain - 0.5) * exp(-100 / (251 - m1)) * (1 - exp(-6.93 / (rain - 0.5)))
                + case when m1 > 150 then 0.0015 * pow(m1 - 150, 2) * sqrt(rain - 0.5) else 0 end) else m1 end as mo,
              case when rain > 1.5 then greatest(0, 244.72 - 43.43 * ln(exp(5.6348 - dmc1 / 43.43) + 1000 * (0.92 * rain - 1.27) / (48.77 + sl * (0.92 * rain - 1.27)))) else dmc1 end as dmc2,
              case when rain > 2.8 then greatest(0, 400 * ln(800 / (800 * exp(-dc1 / 400) + 3.937 * (0.83 * rain - 1.27)))) else dc1 end as dc2
            from (select e.*, r.dmc as dmc1, r.dc as dc1, 147.2 * (101 - r.ffmc) / (59.5 + r.ffmc) as m1,
                case when r.dmc <= 33 then 100 / (0.5 + 0.3 * r.dmc) when r.dmc <= 65 then 14 - 1.3 * ln(r.dmc) else 6.2 * ln(r.dmc) - 17.2 end as sl
              from rec r join e on e.site = r.site and e.season = r.season and e.i = r.i + 1))))"""


@query(
    "G13 C18",
    lambda d: f"""{A.with_views(d, w=A.season_weather).replace('with w', 'with recursive w')}, {_CODES},
      i as (select *, 0.208 * exp(0.05039 * wind) * 91.9 * exp(-0.1386 * mf) * (1 + pow(mf, 5.31) / 4.93e7) as isi,
          case when dmc = 0 and dc = 0 then 0 when dmc <= 0.4 * dc then greatest(0, 0.8 * dmc * dc / (dmc + 0.4 * dc))
            else greatest(0, dmc - (1 - 0.8 * dc / (dmc + 0.4 * dc)) * (0.92 + pow(0.0114 * dmc, 1.7))) end as bui
        from (select *, 147.2 * (101 - ffmc) / (59.5 + ffmc) as mf from rec where i > 0)),
      f as (select *, 0.1 * isi * case when bui <= 80 then 0.626 * pow(bui, 0.809) + 2 else 1000 / (25 + 108.64 * exp(-0.023 * bui)) end as b from i)
      select site, season, day, {milli_sql('ffmc')} as ffmc_milli, {milli_sql('dmc')} as dmc_milli, {milli_sql('dc')} as dc_milli, {milli_sql('isi')} as isi_milli,
        {milli_sql('bui')} as bui_milli, {milli_sql('case when b > 1 then exp(2.72 * pow(0.434 * ln(b), 0.647)) else b end')} as fwi_milli, i as days_since_startup from f""",
)
def daily_fire_codes(t: Tables):
    """Daily moisture codes and indices per site and season (recursive CTE as the oracle)."""
    c = R.daily_codes(t.sql(A.season_weather), ["site", "season"], "day")
    return c.select("site", "season", "day", *[milli(n).alias(f"{n}_milli") for n in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")], "days_since_startup")


@query(
    "G14",
    lambda d: f"""{A.with_views(d, h=A.site_hours).replace('with h', 'with recursive h')},
      b as (select site, t, temp, rh, speed as wind, cast(rain as double) as rain, (t // 3600) % 24 as hour, cast(60 + (t // 86400) % 30 as double) as code, row_number() over (partition by site order by t) as i from h),
      e as (select *, 0.942 * pow(rh, 0.679) + 11 * exp((rh - 100) / 10.0::double) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * rh)) as ed,
        0.618 * pow(rh, 0.753) + 10 * exp((rh - 100) / 10.0::double) + 0.18 * (21.1 - temp) * (1 - exp(-0.115 * rh)) as ew from b),
      rec as (
        select site, t, cast(0 as bigint) as i, code as ffmc from b where i = 1
        union all
        select site, t, i, case when hour = 16 then code else greatest(0, least(101, 59.5 * (250 - m2) / (147.2 + m2))) end as ffmc
        from (select *, case
              when mo > ed then ed + (mo - ed) * pow(10, -0.0579 * exp(0.0365 * temp) * (0.424 * (1 - pow(rh / 100.0::double, 1.7)) + 0.0694 * sqrt(wind) * (1 - pow(rh / 100.0::double, 8))))
              when mo < ew then ew - (ew - mo) * pow(10, -0.0579 * exp(0.0365 * temp) * (0.424 * (1 - pow((100 - rh) / 100.0::double, 1.7)) + 0.0694 * sqrt(wind) * (1 - pow((100 - rh) / 100.0::double, 8))))
              else mo end as m2
          from (select *, case when rain > 0 then least(250, m1 + 42.5 * rain * exp(-100 / (251 - m1)) * (1 - exp(-6.93 / rain)) + case when m1 > 150 then 0.0015 * pow(m1 - 150, 2) * sqrt(rain) else 0 end) else m1 end as mo
            from (select e.*, 147.2 * (101 - r.ffmc) / (59.5 + r.ffmc) as m1 from rec r join e on e.site = r.site and e.i = r.i + 1))))
      select site, t, {milli_sql('ffmc')} as ffmc_milli from rec where i > 0""",
)
def hourly_fire_moisture(t: Tables):
    """Hourly moisture code re-seeded at 16:00 (recursive CTE as the oracle)."""
    hours = t.sql(A.site_hours).select("site", "t", "temp", "rh", F.col("speed").alias("wind"), "rain").withColumns(
        {"hour": F.floor(F.col("t") / 3600) % 24, "code": 60.0 + F.floor(F.col("t") / 86400) % 30}
    )
    return R.hourly_ffmc(hours, ["site"], "t", "hour", "code").select("site", "t", milli("ffmc").alias("ffmc_milli"))



def _ros_sql(isi: str) -> str:
    rate = lambda a, b, c: f"({a} * pow(1 - exp(-({b}) * {isi}), {c}))"
    be = lambda q, b0: f"(case when bui > 0 then exp(50 * ln({q}) * (1 / bui - 1 / {b0})) else 1 end)"
    aspen, c2 = rate("30.0", "0.0232", "1.6"), rate("110.0", "0.0282", "1.5")
    green = "doy between 152 and 258"
    mixed = lambda s: f"({s} * {c2} + case when {green} then 0.2 else 1 end * (1 - {s}) * {aspen}) * {be('0.8', '50.0')}"
    cured = "case when doy < 152 then 0.176 + 0.02 * (90 - 58.8) when doy <= 258 then 0.005 * (exp(0.061 * 50) - 1) else 0.176 + 0.02 * (75 - 58.8) end"
    return f"""case code when 2 then {c2} * {be('0.7', '64.0')} when 3 then {rate('110.0', '0.0444', '3.0')} * {be('0.75', '62.0')}
      when 31 then {rate('190.0', '0.0310', '1.4')} * {cured}
      when 13 then case when not ({green}) then {aspen} * {be('0.9', '32.0')} when bui >= 70 then 0.2 * {aspen} * {be('0.9', '32.0')} else 0 end
      when 650 then {mixed('0.5')} when 625 then {mixed('0.25')} else 0 end"""


@query(
    "C19 C20 B7",
    lambda d: f"""{A.with_views(d, px=A.pixels)},
      i as (select *, cast(70 + elevation % 30 as double) as ffmc, cast(elevation % 120 as double) as bui, cast(elevation * 7 % 55 as double) as wind, 100 + elevation * 3 % 200 as doy from px),
      m as (select *, 147.2 * (101 - ffmc) / (59.5 + ffmc) as mf from i),
      f as (select *, 0.208 * 91.9 * exp(-0.1386 * mf) * (1 + pow(mf, 5.31) / 4.93e7) as ff from m),
      s as (select *, ff * case when wind <= 40 then exp(0.05039 * wind) else 12 * (1 - exp(-0.0818 * (wind - 28))) end as hisi, ff * exp(-0.05039 * wind) as bisi from f),
      r as (select win, r, c, wind, {_ros_sql('hisi')} as head, {_ros_sql('bisi')} as back from s),
      g as (select *, (head + back) / (2 * (1 + 8.729 * pow(1 - exp(-0.03 * wind), 2.155))) as flank from r),
      h as (select *, (head + back) / 2 as a, (head - back) / 2 as o, flank * flank as ff from g)
      select win, r, c, {micro_sql('head')} as head_micro, {micro_sql('back')} as back_micro, {micro_sql('flank')} as flank_micro,
        {micro_sql("case when head > 0 then (o * ff * cos(radians(40)) + a * flank * sqrt(greatest(0, ff * cos(radians(40)) * cos(radians(40)) + (a * a - o * o) * sin(radians(40)) * sin(radians(40))))) / (ff * cos(radians(40)) * cos(radians(40)) + a * a * sin(radians(40)) * sin(radians(40))) else 0 end")} as at_40_micro from h""",
)
def fuel_spread_rates(t: Tables):
    """Head, back and flank rates per pixel, and the rate 40 degrees off the head."""
    e = F.col("elevation")
    p = t.sql(A.pixels).withColumns({"ffmc": (70 + e % 30).cast("double"), "bui": (e % 120).cast("double"), "wind": (e * 7 % 55).cast("double"), "doy": 100 + e * 3 % 200})
    for name, backing in (("head", False), ("back", True)):
        p = fire.with_spread_rate(p, "code", fire.wind_spread_index(F.col("ffmc"), F.col("wind"), backing), F.col("bui"), F.col("doy"), name)
    p = p.withColumn("flank", fire.flank_rate(F.col("head"), F.col("back"), F.col("wind")))
    p = p.withColumn("at_40", fire.directional_rate(F.col("head"), F.col("back"), F.col("flank"), F.lit(40.0)))
    return p.select("win", "r", "c", *[micro(n).alias(f"{n}_micro") for n in ("head", "back", "flank", "at_40")])
