"""Cleaning, calendar, set, quality, profile and file queries."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F, types as T

from panelspark import contracts as C
from panelspark.functions import calendar as CAL, clean
from panelspark.operators import ordered as O, panel as P, profile as R, quality as Q, sets as S
from panelspark.plans import adapters as A
from panelspark.plans.panel import _history_sql, _neighbour_sql, _panel, _panel_sql
from panelspark.plans.stations import _DAILY, daily_weather
from panelspark.plans.registry import Tables, micro, micro_sql, query
from panelspark.session import checkpoint, shared_folder
from panelspark.sources import scan, sinks, stored



def _from_day(column):
    return F.date_add(F.lit("1970-01-01").cast("date"), column.cast("int"))


def _dates(t: Tables):
    return t.sql(A.ignitions).select("event_id", "cell", "day", _from_day(F.col("day")).alias("date"), "size", "large", "cause", "status")


_EV = lambda d: f"{A.with_views(d, ev=A.ignitions)}, dt as (select *, date '1970-01-01' + cast(day as integer) as date from ev)"


# --- cleaning -------------------------------------------------------------

_RAW = "raw as (select p_partkey as id, case p_partkey % 7 when 0 then '' when 1 then ' 12 ' when 2 then 'NA' when 3 then 'x1' when 4 then cast(p_size as varchar) when 5 then '-' || cast(p_size as varchar) else '1e3' end as v from part)"


def _raw(t: Tables):
    k, size = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    v = F.when(k == 0, "").when(k == 1, " 12 ").when(k == 2, "NA").when(k == 3, "x1").when(k == 4, size).when(k == 5, F.concat(F.lit("-"), size)).otherwise("1e3")
    return t.read("part").select(F.col("p_partkey").alias("id"), v.alias("v"))


@query("B1 B9", lambda d: f"with {_RAW} select id, try_cast(nullif(trim(v), '') as double) as number, case when v not in ('', 'NA', 'N/A', 'NULL', 'NaN', 'nan', 'null') then v end as kept from raw")
def tolerant_numbers(t: Tables):
    return _raw(t).select("id", clean.number(F.col("v")).alias("number"), clean.missing_to_null(F.col("v")).alias("kept"))


@query("B2", lambda d: f"{_EV(d)} select event_id, date from dt")
def strict_dates(t: Tables):
    return _dates(t).select("event_id", clean.strict_date(F.col("date").cast("string"), "event").alias("date"))


_YMD = "ymd as (select p_partkey as id, 2010 + p_partkey % 4 as y, p_partkey % 14 as m, p_partkey % 33 as d, p_size - 3 as lat from part)"


def _ymd(t: Tables):
    k = F.col("p_partkey")
    return t.read("part").select(k.alias("id"), (2010 + k % 4).alias("y"), (k % 14).alias("m"), (k % 33).alias("d"), (F.col("p_size") - 3).alias("lat"))


@query("B3", lambda d: f"with {_YMD} select id, try_cast(cast(y as varchar) || '-' || lpad(cast(m as varchar), 2, '0') || '-' || lpad(cast(d as varchar), 2, '0') as date) as date from ymd")
def calendar_dates(t: Tables):
    return _ymd(t).select("id", clean.calendar_date(F.col("y"), F.col("m"), F.col("d")).alias("date"))


_REASON = f"""{_YMD}, r as (select id, case when try_cast(cast(y as varchar) || '-' || lpad(cast(m as varchar), 2, '0') || '-' || lpad(cast(d as varchar), 2, '0') as date) is null then 'invalid_date'
        when y > 2012 then 'outside_years' when lat < 0 or lat > 40 then 'outside_range' else 'included' end as reason from ymd)"""


def _reasons(t: Tables):
    rules = [("invalid_date", clean.calendar_date(F.col("y"), F.col("m"), F.col("d")).isNull()), ("outside_years", F.col("y") > 2012), ("outside_range", (F.col("lat") < 0) | (F.col("lat") > 40))]
    return _ymd(t).withColumn("reason", clean.first_failing(rules))


@query("B4 F6", lambda d: f"with {_REASON} select reason, count(*) as \"rows\" from r group by reason")
def reject_waterfall(t: Tables):
    return _reasons(t).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query("B4", lambda d: f"with {_REASON}, n as (select *, row_number() over (partition by reason order by id) as rn from r where reason <> 'included') select reason, id from n where rn <= 10")
def reject_examples(t: Tables):
    from pyspark.sql import Window

    ranked = _reasons(t).where("reason <> 'included'").withColumn("rn", F.row_number().over(Window.partitionBy("reason").orderBy("id")))
    return ranked.where("rn <= 10").select("reason", "id")  # the rank limit is applied inside each task first


@query("B6", lambda d: f"{_EV(d)} select event_id, day from dt where month(date) * 100 + day(date) between 501 and 1031")
def season_events(t: Tables):
    return _dates(t).where(clean.in_season(F.col("date"))).select("event_id", "day")


@query("B7", lambda d: f"{_EV(d)} select event_id, case cause when 1 then 'lightning' when 2 then 'human' when 3 then 'human' else 'unknown' end as cause_group from ev")
def cause_groups(t: Tables):
    return _dates(t).select("event_id", clean.recode(F.col("cause"), {1: "lightning", 2: "human", 3: "human"}, "unknown").alias("cause_group"))


@query("B8", lambda d: f"""{_EV(d)} select event_id, case when size < 1000 then null when size < 50000 then 'small' when size < 200000 then 'middle' when size < 1000000 then 'large' end as band from ev""")
def size_bands(t: Tables):
    return _dates(t).select("event_id", clean.banded(F.col("size"), [1000.0, 50000.0, 200000.0, 1000000.0], ["small", "middle", "large"]).alias("band"))


@query("B10 B11", lambda d: "select p_partkey as id, case when regexp_matches(p_name, 'ring|blue') then 1 else 0 end as flag, regexp_replace(p_brand, '[^A-Za-z]', '', 'g') as letters from part")
def pattern_flags(t: Tables):
    return t.read("part").select(F.col("p_partkey").alias("id"), clean.matches(F.col("p_name"), "ring|blue").alias("flag"), clean.letters(F.col("p_brand")).alias("letters"))


@query("B12", lambda d: f"""{A.with_views(d, st=A.stations)} select station, '["' || cast(station % 7 as varchar) || '","' || cast(station as varchar) || '","' || printf('%.5f', lon) || '","' || printf('%.5f', lat) || '"]' as key from st""")
def station_keys(t: Tables):
    s = F.col("station")
    return t.sql(A.stations).select("station", clean.station_key(F.concat(F.lit(" "), (s % 7).cast("string")), s.cast("string"), F.col("lon"), F.col("lat")).alias("key"))


@query("B15", lambda d: "select c_custkey as id, cast(floor(c_custkey / 8e0 * 4) as bigint) as exact, case when (c_custkey % 2) = 1 and (cast(floor(c_custkey / 2) as bigint)) % 2 = 0 then cast(floor(c_custkey / 2) as bigint) when c_custkey % 2 = 1 then cast(floor(c_custkey / 2) as bigint) + 1 else cast(c_custkey / 2 as bigint) end as half_even, cast(floor(c_custkey / 2e0 + 5e-1) as bigint) as half_up from customer")
def rounded_halves(t: Tables):
    """Half-even and half-up rounding of exact halves."""
    k = F.col("c_custkey")
    return t.read("customer").select(k.alias("id"), F.floor(k / 8 * 4).cast("bigint").alias("exact"), clean.half_even(k / 2.0, 0).cast("bigint").alias("half_even"), clean.half_up(k / 2.0, 0).cast("bigint").alias("half_up"))


@query("B13 B16 A7", lambda d: f"{_EV(d)} select cell, day, size as event_size, large as event_large from ev")
def contract_projection(t: Tables):
    """Ordered allowlist with prefixed names; the scan reads only the columns it needs."""
    contract = C.Contract("v1", "label", ("event_size", "event_large"), metadata=("status",), forbidden=frozenset({"cause"}))
    renamed = _dates(t).withColumnsRenamed({"size": "event_size", "large": "event_large"})
    return contract.features(renamed, ["cell", "day"])


@query("B18", lambda d: f"{_EV(d)} select event_id, size from ev where status in ('O', 'F') and large = 0 and (size <= 100000 or event_id in (select event_id from ev where event_id % 10 = 0))")
def pinned_or_capped(t: Tables):
    e = _dates(t).withColumn("ok", F.col("large") == 0)
    return S.pinned_or_capped(e, "event_id", "size", 100000.0, ["O", "F"], "status", "ok", e.where("event_id % 10 = 0")).select("event_id", "size")


# --- calendar -------------------------------------------------------------

@query("C11 C12 C13", lambda d: f"""{_EV(d)}, u as (select distinct date from dt), c as (select cell, lat from ({A.cells(d)})),
      p as (select *, 2 * pi() * dayofyear(date) / case when year(date) % 4 = 0 then 366 else 365 end as phase, radians(-23.44) * cos(2 * pi() * (dayofyear(date) + 10) / 365.2422) as decl from u, c)
      select cell, date, {micro_sql('sin(phase)')} as sin_micro, {micro_sql('cos(phase)')} as cos_micro, case when isodow(date) >= 6 then 1 else 0 end as weekend,
        {micro_sql('acos(greatest(-1, least(1, -tan(radians(lat)) * tan(decl)))) * 24 / pi()')} as length_micro from p""")
def calendar_features(t: Tables):
    days = _dates(t).select("date").distinct()
    cells = t.sql(A.cells).select("cell", "lat")
    span = _dates(t).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = P.date_spine(cells, span.select("a").scalar(), span.select("b").scalar(), "date").join(days, "date", "left_semi")
    s, c = CAL.year_cycle(F.col("date"))
    return grid.select("cell", "date", micro(s).alias("sin_micro"), micro(c).alias("cos_micro"), CAL.is_weekend(F.col("date")).alias("weekend"), micro(CAL.day_length_hours(F.col("date"), F.col("lat"))).alias("length_micro"))


@query("C14", lambda d: f"{_EV(d)} select distinct date, strftime(timezone('UTC', timezone('America/Toronto', cast(date as timestamp))), '%Y-%m-%d %H:%M:%S') as issue_time_utc from dt")
def issue_instants(t: Tables):
    """UTC instant of local midnight for every event day."""
    return _dates(t).select("date").distinct().select("date", F.date_format(CAL.issue_instant(F.col("date")), "yyyy-MM-dd HH:mm:ss").alias("issue_time_utc"))


@query("D1", lambda d: f"{_EV(d)}, s as (select cast(unnest(generate_series((select min(date) from dt), (select max(date) from dt), interval 1 day)) as date) as date) select date from s where month(date) * 100 + day(date) between 501 and 1031")
def season_spine(t: Tables):
    span = _dates(t).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return P.date_spine(span, F.col("a"), F.col("b"), "date", ((5, 1), (10, 31))).select("date")


# --- joins and sets -------------------------------------------------------

@query("E2", lambda d: f"{A.with_views(d, ev=A.ignitions, c=A.cells)} select event_id, x, y from ev join c using (cell)")
def dimension_join(t: Tables):
    return P.dimension_join(t.sql(A.ignitions), t.sql(A.cells).select("cell", "x", "y"), ["cell"]).select("event_id", "x", "y")


@query("E2 E14", lambda d: """select (select count(*) from (select distinct o_custkey from orders) where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')) as missing,
      (select count(*) from customer where c_mktsegment <> 'BUILDING' and c_custkey not in (select o_custkey from orders)) as extra""")
def key_alignment(t: Tables):
    left = t.read("orders").select(F.col("o_custkey").alias("cust"))
    return P.alignment(left, t.read("customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("cust")), ["cust"])


@query("E12", lambda d: "select o_orderkey as id, c_mktsegment as segment from orders join customer on o_custkey = c_custkey")
def validated_many_to_one(t: Tables):
    left = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"))
    right = t.read("customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment"))
    return Q.validated_join(left, right, ["cust"], "many_to_one").select("id", "segment")


@query("E13", lambda d: f"{A.with_views(d, obs=A.observations)} select station, day, seq from obs where exists (select 1 from supplier where s_suppkey = station and s_acctbal > 0)")
def allowed_station_records(t: Tables):
    allowed = t.read("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("station"))
    return t.sql(A.observations).join(allowed, "station", "left_semi").select("station", "day", "seq")


@query("E18", lambda d: f"{A.with_views(d, cells=A.cells, ev=A.ignitions)}, {_panel_sql(d)} select count(*) as keys_compared, count(case when (cell + day) % 101 = 0 then 1 end) as mismatches from panel")
def label_reproduction(t: Tables):
    """Labels rebuilt from the events, against a panel with wrong labels planted."""
    wrong = (F.col("cell") + F.col("day")) % 101 == 0
    panel = _panel(t).withColumn("label", F.when(wrong, 1 - F.col("label")).otherwise(F.col("label")))
    return P.label_reproduction(t.sql(A.ignitions), panel, "cell", "day")


@query("I1", lambda d: "select r_regionkey as k, 'region' as kind from region union all select n_nationkey, 'nation' from nation union all select c_nationkey, 'customer' from customer")
def union_of_sources(t: Tables):
    part = lambda n, c, k: t.read(n).select(F.col(c).alias("k"), F.lit(k).alias("kind"))
    return S.union_all(part("region", "r_regionkey", "region"), part("nation", "n_nationkey", "nation"), part("customer", "c_nationkey", "customer"))


@query("I2", lambda d: """select (select count(*) from (select o_custkey from orders except all select c_custkey from customer)) as left_surplus, (select count(*) from (select c_custkey from customer except all select o_custkey from orders)) as right_surplus""")
def key_set_equality(t: Tables):
    return S.equality(t.read("orders").select(F.col("o_custkey").alias("k")), t.read("customer").select(F.col("c_custkey").alias("k")), ["k"])


@query("I2", lambda d: "select s_nationkey as k from supplier except all select n_nationkey from nation")
def key_difference(t: Tables):
    return S.difference(t.read("supplier").select(F.col("s_nationkey").alias("k")), t.read("nation").select(F.col("n_nationkey").alias("k")))


@query("I3", lambda d: "select count(*) as shared from (select year(o_orderdate) from orders where o_orderdate < timestamp '1998-01-01' intersect select year(o_orderdate) from orders where o_orderdate >= timestamp '1998-01-01')")
def split_disjointness(t: Tables):
    o = t.read("orders").select(F.year("o_orderdate").alias("y"), (F.year("o_orderdate") < 1998).alias("early"))
    return S.overlap_count(o.where("early"), o.where("not early"), ["y"])


@query("I4", lambda d: f"{A.with_views(d, ev=A.ignitions)} select event_id, cell, day from ev qualify count(*) over (partition by cell, day) > 1")
def duplicated_rows(t: Tables):
    return S.duplicated(t.sql(A.ignitions).select("event_id", "cell", "day"), ["cell", "day"])


@query("I4", lambda d: f"{A.with_views(d, ev=A.ignitions)} select event_id, cell, day from ev qualify count(*) over (partition by cell, day) = 1")
def unambiguous_rows(t: Tables):
    return S.without_duplicated(t.sql(A.ignitions).select("event_id", "cell", "day"), ["cell", "day"])


# --- quality --------------------------------------------------------------

@query("L2", lambda d: f"""with {_RAW}, v as (select *, case when v not in ('', 'NA', 'N/A', 'NULL', 'NaN', 'nan', 'null') then v end as k, try_cast(trim(case when v not in ('', 'NA') then v end) as double) as n from raw)
      select 'not_numeric:v' as "check", count(case when k is not null and n is null then 1 end) as violations from v union all select 'infinite:v', 0 union all select 'float32_overflow:v', 0
      union all select 'not_whole:v', count(case when n <> floor(n) then 1 end) from v union all select 'beyond_exact_float32:v', 0
      union all select 'outside_range:v', count(case when n < 0 or n > 40 then 1 end) from v union all select 'negative:v', count(case when n < 0 then 1 end) from v""")
def numeric_checks(t: Tables):
    return Q.violations(_raw(t), Q.numeric_checks(["v"], {"v"}, {"v": (0, 40)}, {"v"}))


@query("L1 L14", lambda d: f"""{A.with_views(d, pr=A.predictions)} select 'probability_missing' as "check", 0 as violations union all select 'probability_range', count(case when p < 0 or p > 1 then 1 end) from pr
      union all select 'label_not_binary', 0 union all select 'large_without_label', count(case when size >= 400000 and y = 0 then 1 end) from pr""")
def panel_checks(t: Tables):
    rows = t.sql(A.predictions)
    return Q.violations(rows, [*Q.probability_checks("y", "p"), ("large_without_label", (F.col("size") >= 400000) & (F.col("y") == 0))])


@query("L1", lambda d: f"{A.with_views(d, pr=A.predictions)} select case when a + b + c > 0 then 'FAIL' else 'PASS' end as status, 3 as checks, a + b + c as failed from (select cast(coalesce(max(case when y not in (0, 1) then 1 end), 0) as bigint) as a, cast(coalesce(max(case when p > 3e-1 then 1 end), 0) as bigint) as b, cast(coalesce(max(case when day % 13 = 0 then 1 end), 0) as bigint) as c from pr)")
def panel_verdict(t: Tables):
    return Q.verdict(Q.violations(t.sql(A.predictions), [("label", ~F.col("y").isin(0, 1)), ("score", F.col("p") > 0.3), ("day", F.col("day") % 13 == 0)]))


@query("L12", lambda d: f"""{A.with_views(d, obs=A.observations)} select 'fwi_range' as "check", count(case when fwi < 0 or fwi > 101 then 1 end) as violations from obs union all select 'rain_negative', count(case when rain < 0 then 1 end) from obs""")
def weather_invariants(t: Tables):
    """Fails the job instead of reporting when an invariant is broken."""
    return Q.require(Q.violations(t.sql(A.observations), [("fwi_range", (F.col("fwi") < 0) | (F.col("fwi") > 101)), ("rain_negative", F.col("rain") < 0)]))


_CORRECTED = {
    "count_range": "station_count < 0 or station_count > 4", "fraction": "coverage_fraction is distinct from station_count / cast(choices as double)", "missing_flag": "(station_count = 0) <> (missing = 1)",
    "fwi_without_station": "station_count = 0 and fwi is not null", "fwi_missing": "station_count > 0 and fwi is null", "nearest_pattern": "(nearest_km is null) <> (station_count = 0)", "imputed_range": "imputed_fraction < 0 or imputed_fraction > 1",
}


@query("L12", lambda d: f"""{A.with_views(d, cells=A.cells, st=A.stations, obs=A.observations)}, {_DAILY},
      f as (select cell, day, case when (cell + day) % 89 = 0 then 9 else station_count end as station_count, choices, station_count / cast(choices as double) as coverage_fraction, nearest_km, imputed_fraction,
        case when (cell + day) % 71 = 0 then 1 - missing else missing end as missing, case when (cell + day) % 61 = 0 then null else fwi end as fwi from daily join choices using (day))
      {" union all ".join(f"""select '{n}' as "check", count(case when {c} then 1 end) as violations from f""" for n, c in _CORRECTED.items())}""")
def corrected_weather_checks(t: Tables):
    """Invariants of the completed daily weather, with faults planted in three columns."""
    place, count = F.col("cell") + F.col("day"), F.col("station_count")
    faulty = daily_weather(t).withColumns({
        "station_count": F.when(place % 89 == 0, F.lit(9)).otherwise(count), "missing": F.when(place % 71 == 0, 1 - F.col("missing")).otherwise(F.col("missing")), "fwi": F.when(place % 61 == 0, F.lit(None)).otherwise(F.col("fwi")),
    })
    checks = [
        ("count_range", (count < 0) | (count > 4)), ("fraction", ~F.col("coverage_fraction").eqNullSafe(count / F.col("choices"))), ("missing_flag", (count == 0) != (F.col("missing") == 1)),
        ("fwi_without_station", (count == 0) & F.col("fwi").isNotNull()), ("fwi_missing", (count > 0) & F.col("fwi").isNull()), ("nearest_pattern", F.col("nearest_km").isNull() != (count == 0)),
        ("imputed_range", (F.col("imputed_fraction") < 0) | (F.col("imputed_fraction") > 1)),
    ]
    return Q.violations(faulty, checks)


@query("L3", lambda d: f"""{A.with_views(d, cells=A.cells, ev=A.ignitions)}, days as (select unnest(generate_series((select min(day) from ev), (select max(day) from ev))) as day),
      w as (select cell, day from cells, days), h as (select cell, day, count(*) as n from ev group by cell, day), b as (select coalesce(h.cell, w.cell) as cell, coalesce(h.day, w.day) as day, coalesce(n, 0) as n, case when w.cell is null then 0 else 1 end as w from w full join h on h.cell = w.cell and h.day = w.day)
      select cast(sum(greatest(n - 1, 0)) as bigint) as duplicate_excess, count(case when w = 1 and n = 0 then 1 end) as missing_keys, count(case when w = 0 then 1 end) as unknown_keys, cast(sum(n) as bigint) as "rows", cast(sum(w) as bigint) as expected_rows,
        (select count(*) from (select cell from b group by cell having sum(n) <> sum(w))) as uneven_cells, (select count(*) from (select day from b group by day having sum(n) <> sum(w))) as uneven_days from b""")
def universe_completeness(t: Tables):
    """Raw events held against the full cell x day universe."""
    return Q.completeness(t.sql(A.ignitions).select("cell", "day"), _panel(t).select("cell", "day"), ["cell", "day"], "cell", "day")


_PLANTED = f"""f as (select same_30d + case when (cell * 7 + day) % 97 = 0 then 1000 else 0 end as s30, same_365d as s365, around_30d as a30, around_365d as a365,
        case when (cell * 7 + day) % 89 = 0 then 0 else same_days_since end as ds, case when (same_days_since is null) <> ((cell * 7 + day) % 83 = 0) then 1 else 0 end as ce from hist join nb using (cell, day))"""
_RELATIONS = {
    "same_exceeds_around:30": "s30 > a30", "same_exceeds_around:365": "s365 > a365", "window_order:same_30d": "s30 > s365", "window_order:around_30d": "a30 > a365", "days_since_not_positive": "ds <= 0",
    "censor_flag": "(ds is null) <> (ce = 1)", "days_since_window:30": "(s30 > 0) <> coalesce(ds <= 30, false)", "days_since_window:365": "(s365 > 0) <> coalesce(ds <= 365, false)",
}


@query("L4 L5", lambda d: f"""{A.with_views(d, cells=A.cells, ev=A.ignitions)}, {_panel_sql(d)}, {_history_sql(d)}, {_neighbour_sql(d)}, {_PLANTED} {" union all ".join(f"""select '{n}' as "check", count(case when {c} then 1 end) as violations from f""" for n, c in _RELATIONS.items())}""")
def history_consistency(t: Tables):
    """Order relations of the past-only panel, with faults planted in three columns for the checks to find."""
    from panelspark.plans.panel import past_only_panel

    place = F.col("cell") * 7 + F.col("day")
    faulty = past_only_panel(t).withColumns({
        "same_30d": F.col("same_30d") + F.when(place % 97 == 0, 1000).otherwise(0),
        "same_censored": (F.col("same_days_since").isNull() != (place % 83 == 0)).cast("int"),
        "same_days_since": F.when(place % 89 == 0, F.lit(0)).otherwise(F.col("same_days_since")),
    })
    checks = Q.history_checks({30: "same_30d", 365: "same_365d"}, {30: "around_30d", 365: "around_365d"}, "same_days_since", "same_censored")
    return Q.violations(faulty, checks)


@query("L6", lambda d: f"""{A.with_views(d, ev=A.ignitions)}, k as (select cell, max(size) - min(size) > 1e-5 as a, max(cell * 2) - min(cell * 2) > 1e-5 as b from ev group by cell)
      select count(case when a then 1 end) as size_varies, count(case when b then 1 end) as twice_varies from k""")
def static_within_cell(t: Tables):
    return Q.static_violations(t.sql(A.ignitions).withColumn("twice", F.col("cell") * 2), "cell", ["size", "twice"])


@query("L7 C4 C11", lambda d: f"""{_EV(d)} select 'cycle' as "check", 0 as violations union all select 'centre', count(case when cell % 6 = 0 then 1 end) from ev""")
def recomputed_values(t: Tables):
    """Stored values against recomputed ones: the cycle agrees, one centre in six was stored wrong."""
    s, _ = CAL.year_cycle(F.col("date"))
    stored = _dates(t).withColumns({"stored": F.bround(s, 6), "centre": F.when(F.col("cell") % 6 == 0, F.col("cell") * 10000).otherwise(F.col("cell") * 10000 + 5000)})
    return Q.violations(stored, [("cycle", F.abs(F.col("stored") - s) > 2e-6), ("centre", F.col("centre") != F.col("cell") * 10000 + 5000)])


@query("L8 F17", lambda d: f"""{A.with_views(d, pr=A.predictions)} select year, count(*) as "rows", cast(sum(y) as bigint) as positives, cast(sum(missing) as bigint) as flagged, {micro_sql('sum(y) / cast(count(*) as double)')} as rate_micro from pr group by year""")
def annual_totals(t: Tables):
    return _rates(R.rollup_rates(t.sql(A.predictions), {"year": F.col("year")}, "y", "missing"), "year")


def _rates(table, *keys):
    return table.select(*keys, "rows", "positives", "flagged", micro("rate").alias("rate_micro"))


@query("L11", lambda d: f"""{A.with_views(d, ev=A.ignitions)} select count(case when event_id % 50 = 0 then 1 end) as only_old, cast(0 as bigint) as only_new, count(case when event_id % 50 <> 0 and event_id % 9 = 0 then 1 end) as size_changed, cast(0 as bigint) as large_changed from ev""")
def table_diff(t: Tables):
    old = t.sql(A.ignitions).select("event_id", "size", "large")
    new = old.where("event_id % 50 <> 0").withColumn("size", F.when(F.col("event_id") % 9 == 0, F.col("size") + 1).otherwise(F.col("size") + 1e-8))
    return Q.table_diff(old, new, ["event_id"], ["size", "large"])


@query("L13", lambda d: f"{A.with_views(d, pr=A.predictions)} select count(*) as \"rows\", count(case when p <> p2 then 1 end) as different, {micro_sql('max(abs(p - p2))')} as largest_micro from pr")
def prediction_parity(t: Tables):
    rows = t.sql(A.predictions)
    r = Q.prediction_parity(rows.select("id", "p"), rows.select("id", F.col("p2").alias("p")), ["id"], "p")
    return r.select("rows", "different", micro("largest").alias("largest_micro"))


_SEQ = """sq as (select entity, row_number() over (partition by entity order by t, id) as n, t, power, sum(power) over (partition by entity order by t, id) as total from det)"""


@query("L9", lambda d: f"""{A.with_views(d, det=A.detections)}, {_SEQ}, e as (select entity, case when n % 40 = 0 then n + 1 else n end as n, t, power, case when n % 33 = 0 then total - 1 else total end as total from sq),
      p as (select e.*, b.t as bt, b.total as bc from e left join e b on b.entity = e.entity and b.n + 1 = e.n where not exists (select 1 from e x where x.entity = e.entity and x.n = e.n and (x.t < e.t or (x.t = e.t and x.total < e.total))))
      select 'gap' as "check", count(case when n <> 1 and bt is null then 1 end) as violations from p union all select 'backward', count(case when t < bt then 1 end) from p
      union all select 'falling', count(case when total < bc - 1e-6 then 1 end) from p union all select 'unequal', count(case when abs(total - coalesce(bc, 0) - power) > 2e-2 then 1 end) from p
      union all select 'power_negative', count(case when power < 0 then 1 end) from p""")
def sequence_checks(t: Tables):
    """Numbering, monotone time and cumulative totals of each entity, with planted faults."""
    det = t.sql(A.detections)
    rows = O.running(det.withColumn("one", F.lit(1)), ["entity"], "t", {"n": "one", "total": "power"}, ties=["id"])
    rows = rows.withColumns({"total": F.when(F.col("n") % 33 == 0, F.col("total") - 1).otherwise(F.col("total")), "n": F.when(F.col("n") % 40 == 0, F.col("n") + 1).otherwise(F.col("n"))})
    rows = rows.groupBy("entity", "n").agg(F.min_by(F.struct("t", "power", "total"), F.struct("t", "total")).alias("v")).select("entity", "n", "v.*")
    flagged = Q.sequence_checks(rows, "entity", "n", "t", "total", "power", 0.02)
    return Q.violations(flagged, [*[(c, F.col(c)) for c in ("gap", "backward", "falling", "unequal")], ("power_negative", F.col("power") < 0)])


_SUITE = ("entity_repeats observation_repeats arrival_repeats entity_unknown arrivals_match_final_count split_years_shared numbering time_order cumulative_falls increment_differs "
          "hours_not_positive before_window bearing_range vector_mean_exceeds_speed components_differ_from_speed implausible_weather shares_total").split()


@query("L9", lambda d: f"""{A.with_views(d, det=A.detections, h=A.site_hours)}, z as (select (select count(*) from det) * 0 as nothing, (select count(case when temp > 20 then 1 end) from h) as warm, (select count(distinct entity) from det where entity % 7 = 0) as short)
      select c as "check", cast(case c when 'implausible_weather' then warm when 'shares_total' then short else nothing end as bigint) as violations from z, unnest([{', '.join(f"'{c}'" for c in _SUITE)}]) as u(c)""")
def spread_validation_suite(t: Tables):
    """All structural checks over sessions, arrival cells, interval weather and hours, with two planted faults."""
    from panelspark.functions.geo import wind_vector
    from panelspark.operators import intervals as I, sessions as SE
    from panelspark.plans.sessions import sessions
    from panelspark.session import checkpoint

    found = checkpoint(sessions(t).withColumn("site", F.col("entity") % 5))
    u, v = wind_vector(F.col("speed"), F.col("direction"))
    hours = checkpoint(t.sql(A.site_hours).withColumns({"u": u, "v": v}))
    table = checkpoint(SE.session_summary(found, "entity", "session", "t", "power", "daynight", "satellite", written=True).withColumn("site", F.col("entity") % 5))
    before = table.select("entity", (F.col("session") + 1).alias("session"), F.col("middle_time").alias("start"))
    spans = table.join(before, ["entity", "session"], "left").select("entity", "session", "site", F.coalesce("start", F.col("middle_time") - 43200).alias("start"), F.col("middle_time").alias("end"))
    wind = I.wind_summary(I.interval_join(spans, hours.select("site", "t", "u", "v", "speed"), ["site"], "t", 86400), ["entity", "session"], "u", "v", "speed")
    observations = checkpoint(table.join(wind, ["entity", "session"], "left").select(  # the checks read each table several times
        "entity", "session", F.col("middle_time").alias("time"), "new_cells", "cumulative_cells", F.col("hours_since_previous"), F.lit(None).cast("double").alias("bearing"),
        "direction", "wind_u", "wind_v", F.col("speed_mean").alias("speed")))
    entities = checkpoint(found.groupBy("entity").agg(F.min("t").alias("window_start"))).select(
        "entity", "window_start", (F.col("entity") % 12 + 2012).alias("year"), F.when(F.col("entity") % 12 >= 9, "holdout").otherwise("calibration").alias("split"),
        F.when(F.col("entity") % 7 == 0, 0.5).otherwise(1.0).alias("shares_total"))
    planted = hours.withColumn("temp", F.when(F.col("temp") > 20, F.col("temp") + 50).otherwise(F.col("temp")))
    return Q.observation_suite(entities, observations, checkpoint(SE.arrival_cells(found, "entity", "session")), planted, "entity", "session")


@query("L10 F21 F23", lambda d: f"""{A.with_views(d, pr=A.predictions)}, r as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2e0 as a, rank() over (order by p2) + (count(*) over (partition by p2) - 1) / 2e0 as b from pr)
      select {micro_sql('corr(a, b)')} as rank_micro, {micro_sql('corr(p, p2)')} as r_micro, {micro_sql('median(p)')} as median_micro, {micro_sql('avg(case when p <= 2e-1 then 1e0 else 0e0 end)')} as share_micro from r""")
def sanity_block(t: Tables):
    from panelspark.operators.metrics import rank_correlation

    rows = t.sql(A.predictions)
    base = rows.agg(F.corr("p", "p2").alias("r"), F.avg((F.col("p") <= 0.2).cast("double")).alias("share"))
    return base.select(
        micro(rank_correlation(rows, [], "p", "p2").scalar()).alias("rank_micro"), micro("r").alias("r_micro"),
        micro(O.quantiles(rows, [], "p", {"m": 0.5}).scalar()).alias("median_micro"), micro("share").alias("share_micro"),
    )


@query("K3", lambda d: f"""{A.with_views(d, ev=A.ignitions)} select '{{"version":"v1","counts":{{"rows":' || count(*) || ',"cells":' || count(distinct cell) || ',"large":' || sum(large) || '}},"validation":{{"leakage_violations":0}},"semantics":{{"day":"calendar day of the event"}}}}' as audit from ev""")
def build_audit(t: Tables):
    ev = t.sql(A.ignitions)
    measures = {"rows": F.count(F.lit(1)), "cells": F.countDistinct("cell"), "large": F.sum("large")}
    return Q.audit(ev, "v1", measures, F.col("day") < 0, {"day": "calendar day of the event"})


@query("L15 B14", lambda d: f"{A.with_views(d, ev=A.ignitions)} select cell, day, size, large from ev")
def gated_features(t: Tables):
    """Features released only where the stored table's audit, version, columns and files allow it and the allowlist holds no outcome."""
    ev, path = t.sql(A.ignitions), shared_folder(t.spark, "gated")
    stored.store(ev, path, "v1", {"size is not positive": F.coalesce(F.col("size") <= 0, F.lit(True))})
    C.guard(["size", "large"], {"cause", "status"})
    return stored.load(t.spark, path, "v1", ev.columns).select("cell", "day", "size", "large")


FAULTS = ("none", "failed audit", "wrong version", "wrong columns", "changed file", "added file", "missing table", "second table", "forbidden feature", "broken boundary")


@query("L15 B14 A11 K3", lambda d: f"{A.with_views(d, pr=A.predictions)} select f as fault, f <> 'none' and (select count(*) from pr where y = 1) > 0 as refused from unnest([{', '.join(repr(f) for f in FAULTS)}]) as u(f)")
def gate_refusals(t: Tables):
    """Faults planted in stored tables, and whether the gate refuses each; a table without one is released."""
    rows = t.sql(A.predictions).select("id", "year", "y", "p")
    folder = lambda: shared_folder(t.spark, "fault")
    good, bad, changed, added = folder(), folder(), folder(), folder()
    for path in (good, changed, added):
        stored.store(rows, path, "v1", {"score out of range": ~F.col("p").between(0, 1)}, by=["year"])
    stored.store(rows, bad, "v1", {"label is set": F.col("y") == 1})
    part = f"{stored.gate(t.spark, changed, 'v1')}/" + stored.fingerprints(t.spark, stored.gate(t.spark, changed, "v1")).agg(F.min("file")).first()[0]
    stored.spoil(t.spark, part)
    rows.limit(1).write.mode("append").partitionBy("year").parquet(stored.gate(t.spark, added, "v1"))
    attempts = {
        "none": lambda: stored.gate(t.spark, good, "v1", rows.columns), "failed audit": lambda: stored.gate(t.spark, bad, "v1"),
        "wrong version": lambda: stored.gate(t.spark, good, "v2"), "wrong columns": lambda: stored.gate(t.spark, good, "v1", rows.columns[::-1]),
        "changed file": lambda: stored.gate(t.spark, changed, "v1"), "added file": lambda: stored.gate(t.spark, added, "v1"),
        "missing table": lambda: stored.gate(t.spark, folder(), "v1"), "second table": lambda: stored.store(rows, good, "v1"),
        "forbidden feature": lambda: C.guard(["p", "y"], {"y"}),
        "broken boundary": lambda: Q.audit(rows, "v1", {"rows": F.count(F.lit(1))}, F.col("y") == 1, {}).collect(),
    }

    def refused(attempt) -> bool:
        try:
            attempt()
        except (C.ContractError, PySparkException) as error:
            if isinstance(error, PySparkException) and "boundary broken" not in str(error):
                raise
            return True
        return False

    return t.spark.createDataFrame([(f, refused(attempts[f])) for f in FAULTS], "fault string, refused boolean")


@query("A11", lambda d: f"{A.with_views(d, pr=A.predictions)} select distinct year, year <> 1996 as same from pr")
def manifest_differences(t: Tables):
    """Files of a table by year against its stored manifest, after one year was written again with other scores."""
    rows, path = t.sql(A.predictions).select("id", "year", "p"), shared_folder(t.spark, "manifest")
    stored.store(rows.repartition("year"), path, "v1", by=["year"])
    data = stored.gate(t.spark, path, "v1")
    rows.where("year = 1996").select("id", F.col("p") + 1).write.mode("overwrite").parquet(f"{data}/year=1996")
    found = stored.differences(stored.fingerprints(t.spark, data), t.spark.read.parquet(f"{stored.current(t.spark, path)[0]}/manifest"))
    year = F.regexp_extract("file", r"year=(\d+)/", 1).cast("bigint")
    return found.groupBy(year.alias("year")).agg(F.every("same").alias("same"))


@query("B13", lambda d: f"{A.with_views(d, ev=A.ignitions)} select event_id, size, cell, large, cause, status from ev")
def contract_parts(t: Tables):
    """Predictors, labels and metadata of a contract as tables of their own, met again by key."""
    contract = C.Contract("v1", "large", ("size", "cell"), ("cause",), ("status",))
    predictors, labels, metadata = contract.split(t.sql(A.ignitions), ["event_id"])
    return predictors.join(labels, "event_id").join(metadata, "event_id")


# --- profile --------------------------------------------------------------

@query("F15", lambda d: f"""{A.with_views(d, pr=A.predictions)}, l as (select c as "column", k as class, case when c = 'p' then p else size end as v from pr, unnest(['p', 'size']) as a(c), unnest(['all', case when y = 1 then 'positive' else 'negative' end]) as b(k))
      select "column", class, count(v) as observed, {micro_sql('avg(v)')} as mean_micro, cast(floor(stddev_samp(v) * 1000 + 5e-1) as bigint) as deviation_milli, {micro_sql('min(v)')} as min_micro, {micro_sql('max(v)')} as max_micro from l group by 1, 2""")
def class_moments(t: Tables):
    m = R.class_moments(t.sql(A.predictions), ["p", "size"], F.col("y") == 1)
    return m.select("column", "class", "observed", micro("mean").alias("mean_micro"), F.floor(F.col("deviation") * 1000 + 0.5).cast("bigint").alias("deviation_milli"), micro("min").alias("min_micro"), micro("max").alias("max_micro"))


@query("F16", lambda d: f"""{A.with_views(d, obs=A.observations)} select c as "column", count(*) as "rows", count(case when c = 'fwi' and fwi is null or c = 'rain' and rain is null then 1 end) as missing from obs, unnest(['station', 'fwi', 'rain', 'temp']) as u(c) group by c""")
def null_profile(t: Tables):
    return Q.null_profile(t.sql(A.observations), ["station", "fwi", "rain", "temp"])


@query("F17", lambda d: f"""{_EV(d)}, pr as ({A.predictions(d)}) select month(date '1970-01-01' + cast(day as integer)) as month, count(*) as "rows", cast(sum(y) as bigint) as positives, cast(sum(missing) as bigint) as flagged, {micro_sql('sum(y) / cast(count(*) as double)')} as rate_micro from pr group by 1""")
def monthly_rollup(t: Tables):
    """Daily totals rolled up to months without another pass over the rows."""
    daily = R.rollup_rates(t.sql(A.predictions), {"day": F.col("day")}, "y", "missing")
    return _rates(R.coarser(daily, {"month": F.month(_from_day(F.col("day"))).cast("bigint")}), "month")


@query("F18", lambda d: f"""{A.with_views(d, pr=A.predictions, c=A.cells)} select c.cell, count(pr.id) as "rows", cast(coalesce(sum(pr.y), 0) as bigint) as positives, cast(coalesce(sum(missing), 0) as bigint) as flagged from c left join pr on pr.cell = c.cell group by c.cell""")
def cell_summary(t: Tables):
    return R.per_cell(t.sql(A.cells), t.sql(A.predictions), "cell", "y", "missing").select("cell", "rows", "positives", "flagged")


@query("F19", lambda d: f"{A.with_views(d, pr=A.predictions)} select y, missing, count(*) as \"rows\" from pr group by y, missing")
def label_by_missing(t: Tables):
    return R.cross_tab(t.sql(A.predictions), "y", "missing")


@query("F20", lambda d: "select distinct 'status' as \"column\", o_orderstatus as value from orders union select distinct 'priority', o_orderpriority from orders")
def distinct_metadata(t: Tables):
    return R.distinct_values(t.read("orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")), ["status", "priority"])


_QS = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


@query("F21", lambda d: f"""{A.with_views(d, pr=A.predictions)}, l as (select c as "column", case c when 'p' then p when 'p2' then p2 else size end as v from pr, unnest(['p', 'p2', 'size']) as u(c))
      select "column", {', '.join(f"{micro_sql(f'quantile_cont(v, {q})')} as {n}" for n, q in _QS.items())} from l group by "column" """)
def exact_quantiles(t: Tables):
    return R.quantile_table(t.sql(A.predictions), ["p", "p2", "size"], _QS).select("column", *[micro(n).alias(n) for n in _QS])


@query("F22", lambda d: f"""{A.with_views(d, obs=A.observations)} select 'fwi' as a, 'rain' as b, count(case when fwi is not null and rain is not null then 1 end) as pairs, {micro_sql('corr(fwi, rain)')} as r_micro from obs
      union all select 'fwi', 'temp', count(fwi), {micro_sql('corr(fwi, temp)')} from obs union all select 'rain', 'temp', count(rain), {micro_sql('corr(rain, temp)')} from obs""")
def pairwise_correlations(t: Tables):
    return R.pairwise_correlations(t.sql(A.observations), ["fwi", "rain", "temp"]).select("a", "b", "pairs", micro("r").alias("r_micro"))


@query("F22", lambda d: f"{A.with_views(d, obs=A.observations)} select 'fwi' as a, 'temp' as b from obs having corr(fwi, temp) > 0.9")
def strong_correlations(t: Tables):
    return R.strong_pairs(R.pairwise_correlations(t.sql(A.observations), ["fwi", "rain", "temp"])).select("a", "b")


@query("F24 B8", lambda d: f"""{A.with_views(d, pr=A.predictions)}, b as (select *, case when p < 0 or p >= 1 then null when p < 1e-1 then 'low' when p < 3e-1 then 'middle' else 'high' end as band from pr)
      select band, count(size) as observations, {micro_sql('quantile_cont(size, 0.25)')} as p25, {micro_sql('median(size)')} as median_, {micro_sql('quantile_cont(size, 0.75)')} as p75 from b where band is not null group by band""")
def binned_quartiles(t: Tables):
    b = R.binned_quartiles(t.sql(A.predictions), clean.banded(F.col("p"), [0.0, 0.1, 0.3, 1.0], ["low", "middle", "high"]), "size")
    return b.select("band", "observations", micro("p25").alias("p25"), micro("median").alias("median_"), micro("p75").alias("p75"))


_EDGES = [0.0, 10.0, 100.0, 1000.0, 10000.0, 100000.0, 600000.0]


@query("F25", lambda d: f"""{A.with_views(d, pr=A.predictions)}, e(bin, low, high) as (values {', '.join(f'({i}, {a!r}::double, {b!r}::double)' for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))}),
      c as (select y, bin, count(*) as n from pr join e on size >= low and (size < high or (high = 600000 and size = high)) group by y, bin), t as (select y, count(*) as n from pr group by y)
      select t.y, cast(e.bin as bigint) as bin, coalesce(c.n, 0) as "count", {micro_sql('coalesce(c.n, 0) / cast(t.n as double)')} as share_micro from t cross join e left join c on c.y = t.y and c.bin = e.bin""")
def log_histogram(t: Tables):
    h = R.histogram_shares(t.sql(A.predictions), "size", _EDGES, ["y"])
    return h.select("y", F.col("bin").cast("long").alias("bin"), "count", micro("share").alias("share_micro"))


@query("F26", lambda d: f"""{A.with_views(d, ev=A.ignitions)} select cause, count(*) as "rows", {micro_sql('sum(size) / (select sum(size) from ev)')} as share_micro from ev group by cause""")
def cause_share_of_size(t: Tables):
    return R.group_shares(t.sql(A.ignitions), "cause", "size").select("cause", "rows", micro("share").alias("share_micro"))


@query("F27", lambda d: f"{A.with_views(d, ev=A.ignitions)} select cell, count(*) as \"rows\" from ev group by cell order by 2 desc, 1 limit 6")
def top_cells(t: Tables):
    return R.top_categories(t.sql(A.ignitions), "cell", 6)


@query("F28", lambda d: f"""{_EV(d)} select cell, count(case when cause = 1 then 1 end) as "1", count(case when cause = 2 then 1 end) as "2", count(case when cause = 9 then 1 end) as "9" from ev group by cell""")
def cell_by_cause(t: Tables):
    return R.category_counts(t.sql(A.ignitions), "cell", "cause", [1, 2, 9])


@query("F29", lambda d: f"""{A.with_views(d, det=A.detections)}, a as (select *, abs((x % 360 - y % 360 + 540) % 360 - 180) as angle from det where power >= 1000)
      select count(*) as steps, {micro_sql('avg(case when angle <= 45 then 1e0 else 0e0 end)')} as share_micro, {micro_sql('median(angle)')} as median_micro from a""")
def wind_coherence(t: Tables):
    from panelspark.functions.geo import angle_between

    det = t.sql(A.detections).withColumn("angle", angle_between((F.col("x") % 360).cast("double"), (F.col("y") % 360).cast("double")))
    return R.coherence(det, "angle", F.col("power") >= 1000).select("steps", micro("share_within").alias("share_micro"), micro("median_angle").alias("median_micro"))


_MASK = "mk as (select cell, day, bit_or(case cause when 1 then 1 when 2 then 2 when 3 then 4 else 0 end) as mask, count(*) as events from ev group by cell, day)"


@query("F30", lambda d: f"""{A.with_views(d, ev=A.ignitions)}, {_MASK} select cell, day, mask, events, case when mask >= 4 then 'unknown_involved' when mask = 3 then 'mixed' when mask = 2 then 'human_only' when mask = 1 then 'natural_only' end as partition_,
      mask & 1 <> 0 as natural_containing, mask & 2 <> 0 as human_containing from mk""")
def cause_partition(t: Tables):
    return R.cause_masks(t.sql(A.ignitions), ["cell", "day"], "cause", {1: 1, 2: 2, 3: 4}).withColumnRenamed("partition", "partition_")


@query("F31", lambda d: f"""{A.with_views(d, obs=A.observations)}, s as (select flag, case when fwi is null or rain is null then 'unknown' when rain > 4 then 'day_and_week' when fwi > 25 then 'week_only' else 'neither' end as st from obs)
      select flag, count(*) as "rows", count(case when st = 'unknown' then 1 end) as unknown, count(case when st = 'day_and_week' then 1 end) as detected_day, count(case when st = 'week_only' then 1 end) as week_only, count(case when st = 'neither' then 1 end) as neither,
        {micro_sql("count(case when st = 'day_and_week' then 1 end) / cast(count(*) as double)")} as day_micro, {micro_sql("count(case when st in ('day_and_week', 'week_only') then 1 end) / cast(count(case when st <> 'unknown' then 1 end) as double)")} as week_covered_micro from s group by flag""")
def exposure_states(t: Tables):
    obs = t.sql(A.observations)
    day = F.when(F.col("rain").isNotNull(), F.when(F.col("rain") > 4, 1).otherwise(0))
    week = F.when(F.col("fwi").isNotNull(), F.when(F.col("fwi") > 25, 1).otherwise(0))
    e = R.exposure_summary(obs.withColumn("state", R.exposure_state(day, week)), ["flag"], "state")
    return e.select("flag", "rows", "unknown", "detected_day", "week_only", "neither", micro("day_fraction").alias("day_micro"), micro("week_fraction_covered").alias("week_covered_micro"))


# --- files ----------------------------------------------------------------

_PLAIN = ["event_id", "cell", "day", "size"]
_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("cell", T.LongType()), T.StructField("day", T.LongType()), T.StructField("size", T.DoubleType())])


def _csv(t: Tables, codec: str = "none") -> str:
    return sinks.write_csv(t.sql(A.ignitions).select(*_PLAIN), shared_folder(t.spark, "events"), compression=codec)


def _plain_sql(d):
    return f"{A.with_views(d, ev=A.ignitions)} select event_id, cell, day, size from ev"


@query("A1", _plain_sql)
def scan_exact_csv(t: Tables):
    return scan.scan_csv(t.spark, _csv(t), _SCHEMA)


@query("A2 A3 K6", _plain_sql)
def scan_compressed_text(t: Tables):
    text = scan.scan_text(t.spark, _csv(t, "bzip2"), ["event_id", "day"])
    return text.select(*[clean.number(F.col(f.name), f.dataType.simpleString()).alias(f.name) for f in _SCHEMA.fields])


@query("A3", lambda d: f"{A.with_views(d, ev=A.ignitions)} select event_id, size from ev")
def scan_required_subset(t: Tables):
    return scan.scan_csv(t.spark, _csv(t), T.StructType([_SCHEMA["event_id"], _SCHEMA["size"]]), exact=False)


@query("A4", lambda d: f"""{A.with_views(d, det=A.detections)} select cast(floor(t / 86400e0) as bigint) as day, cast(floor(t % 86400 / 60e0) as bigint) as minute, count(*) as n from det where id % 5 <> 0 and id % 3 <> 0 group by 1, 2""")
def scan_yearly_detections(t: Tables):
    """Sensor files written from the events, scanned by glob with the quality filter and a clock from date and HHMM."""
    e = t.read("events")
    k = F.col("event_id")
    rows = e.select(
        F.col("value").alias("latitude"), F.col("value").alias("longitude"), F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), F.regexp_replace(F.date_format("ts", "HHmm"), "^0+(?=.)", "").alias("acq_time"),
        F.col("event_type").alias("satellite"), F.when(k % 3 == 0, "l").otherwise("n").alias("confidence"), F.col("value").alias("frp"), F.lit("D").alias("daynight"), F.when(k % 5 == 0, 2).otherwise(0).alias("type"))
    folder = shared_folder(t.spark, "firms")
    sinks.write_csv(rows.where("satellite < 'm'"), f"{folder}/viirs-a_2024")
    sinks.write_csv(rows.where("satellite >= 'm'"), f"{folder}/viirs-b_2024")
    found = scan.scan_detections(t.spark, f"{folder}/viirs-*_2024")
    clock = F.col("time_utc")
    return found.groupBy(F.unix_date(clock.cast("date")).cast("long").alias("day"), (F.hour(clock) * 60 + F.minute(clock)).cast("long").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query("A5", lambda d: f"{A.with_views(d, h=A.site_hours)} select cast(site as varchar) as entity, cast(t as bigint) as t, cast(temp as double) as temp, cast(rh as double) as rh, speed from h")
def scan_nested_hours(t: Tables):
    """Hourly rows packed into one document per site and day, then unpacked by the scan."""
    h = t.sql(A.site_hours).withColumn("time", F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm"))
    parts = {"time": "time", "temperature_2m": "temp", "relative_humidity_2m": "rh", "precipitation": "rain", "wind_speed_10m": "speed", "wind_direction_10m": "direction"}
    rows = h.groupBy(F.col("site").cast("string").alias("entity"), F.floor(F.col("t") / 86400).alias("d")).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(n) for n, c in parts.items()]))).alias("r"))
    docs = rows.select("entity", F.struct(*[F.col(f"r.{n}").alias(n) for n in parts]).alias("hourly"))
    folder = shared_folder(t.spark, "hourly")
    docs.write.json(folder)
    zone = F.to_timestamp(F.col("time"))
    return scan.scan_hourly_json(t.spark, folder).select("entity", F.unix_timestamp(zone).alias("t"), "temp", "rh", "speed")


@query("A6 C22", lambda d: f"{A.with_views(d, e=A.polygon_edges)} select poly, date '2020-01-01' + cast(poly as integer) as start_date, ring, edge, x1, y1, x2, y2 from e")
def scan_geojson_edges(t: Tables):
    """Features written as GeoJSON lines from the polygon table, scanned back to ring edges."""
    e = t.sql(A.polygon_edges)
    point = lambda x, y: F.array(F.col(x), F.col(y))
    ordered = e.groupBy("poly", "ring").agg(F.array_sort(F.collect_list(F.struct("edge", point("x1", "y1").alias("p")))).alias("s"))
    ring = F.concat(F.col("s.p"), F.slice("s.p", 1, 1))
    rings = ordered.select("poly", "ring", ring.alias("c")).groupBy("poly").agg(F.array_sort(F.collect_list(F.struct("ring", "c"))).alias("r"))
    ms = F.lit(1577836800000) + F.col("poly") * 86400000 + 3600000
    doc = rings.select(F.struct(F.col("poly"), ms.alias("started")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.col("r.c").alias("coordinates")).alias("geometry"))
    folder = shared_folder(t.spark, "geojson")
    doc.write.json(folder)
    features = scan.scan_geojson(t.spark, folder, "poly:bigint,started:bigint", lines=True).withColumn("start_date", scan.epoch_day(F.col("started")))
    edges = scan.ring_edges(features, "poly")
    return edges.join(features.select("poly", "start_date"), "poly").select("poly", "start_date", *[F.col(c).cast("long").alias(c) for c in ("ring", "edge")], "x1", "y1", "x2", "y2")


@query("A8 K1", lambda d: f"{A.with_views(d, pr=A.predictions)} select id, year, y from pr where year between 1997 and 1998")
def year_partitioned_panel(t: Tables):
    """Panel written by year, read back with partition pruning."""
    path = sinks.write_panel(t.sql(A.predictions).select("id", "year", "y"), shared_folder(t.spark, "panel"))
    return scan.year_slice(t.spark.read.parquet(path), 1997, 1998).select("id", F.col("year").cast("long").alias("year"), "y")


@query("K1 K3 L15", lambda d: f"{A.with_views(d, pr=A.predictions)} select id, year, y from pr")
def replaced_panel(t: Tables):
    """A stored table replaced as a whole by its next version, loaded through the gate."""
    rows, path = t.sql(A.predictions).select("id", "year", "y"), shared_folder(t.spark, "replaced")
    stored.store(rows.where("year < 1997"), path, "v1", by=["year"])
    stored.store(rows, path, "v2", {"label is not binary": ~F.col("y").isin(0, 1)}, by=["year"], replace=True)
    return stored.load(t.spark, path, "v2", ["id", "year", "y"]).select("id", F.col("year").cast("long").alias("year"), "y")


@query("K2", lambda d: f"{A.with_views(d, det=A.detections)} select entity, t, id from det")
def ordered_table(t: Tables):
    path = sinks.write_ordered(t.sql(A.detections).select("entity", "t", "id"), shared_folder(t.spark, "ordered"), ["entity", "t", "id"])
    return t.spark.read.parquet(path)


@query("K4", lambda d: f"{A.with_views(d, pr=A.predictions)} select id, y, p, year as fold from pr")
def stored_fold_predictions(t: Tables):
    rows = t.sql(A.predictions).select("id", "y", "p", F.col("year").alias("fold"))
    parameters = {"depth": 4, "rate": 0.1}
    path = sinks.write_predictions(rows, shared_folder(t.spark, "folds"), parameters)
    back = sinks.read_predictions(t.spark, path, parameters, rows, ["id"])
    return back.select("id", "y", "p", F.col("fold").cast("long").alias("fold"))


@query("K5 J20", lambda d: f"{A.with_views(d, pr=A.predictions, c=A.cells)} select cell, id, p, pr.y, missing, {micro_sql('lon')} as lon_micro, {micro_sql('lat')} as lat_micro from pr join c using (cell) where day = 10000")
def day_export(t: Tables):
    e = sinks.export_day(t.sql(A.predictions), t.sql(A.cells), "cell", "day", 10000)
    return e.select("cell", "id", "p", "y", "missing", micro("lon").alias("lon_micro"), micro("lat").alias("lat_micro"))


@query("A11", lambda d: f"select 'orders.parquet' as file, true as same where (select count(*) from orders) > 0")
def source_fingerprint(t: Tables):
    """Checksums of a source file against a manifest written beforehand; the job fails on a difference."""
    manifest = checkpoint(scan.fingerprint(t.spark, f"{t.folder}/orders.parquet").select("file", "sha256"))
    found = scan.fingerprint(t.spark, f"{t.folder}/orders.parquet")
    return scan.fingerprint_gate(found, manifest).select("file", (F.col("bytes") > 0).alias("same"))
