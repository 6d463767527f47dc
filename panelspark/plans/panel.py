"""Panel construction and past-only history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import panel as P
from panelspark.plans import adapters as A
from panelspark.plans.registry import Tables, micro, micro_sql, query
from panelspark.plans.stations import _DAILY, daily_weather
from panelspark.session import checkpoint

DAY = "day"


def _counts(t: Tables):
    return P.cell_day_labels(t.sql(A.ignitions), "cell", DAY, F.col("large"))


def _panel(t: Tables):
    """Cells x days between the first and the last event (day numbers)."""
    events = t.sql(A.ignitions)
    span = events.agg(F.min(DAY).alias("lo"), F.max(DAY).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    return P.dense_panel(t.sql(A.cells), _counts(t), "cell", DAY, lo, hi)


def _labels_sql(d):
    return "select cell, day, 1 as label, count(*) as event_count, max(large) as large_label from ev group by cell, day"


def _panel_sql(d):
    return f"""lab as ({_labels_sql(d)}),
      days as (select unnest(generate_series((select min(day) from ev), (select max(day) from ev))) as day),
      panel as (select c.cell, c.x, c.y, c.lat, d.day, coalesce(l.label, 0) as label, coalesce(l.event_count, 0) as event_count,
        coalesce(l.large_label, 0) as large_label from cells c cross join days d left join lab l on l.cell = c.cell and l.day = d.day)"""


def _with(d):
    return f"{A.with_views(d, cells=A.cells, ev=A.ignitions)}, {_panel_sql(d)}"


@query("F1", lambda d: f"{A.with_views(d, ev=A.ignitions)} {_labels_sql(d)}")
def cell_day_labels(t: Tables):
    return _counts(t)


@query("D4 E1", lambda d: f"{_with(d)} select cell, day, label, event_count, large_label from panel")
def dense_label_panel(t: Tables):
    return _panel(t).select("cell", DAY, "label", "event_count", "large_label")


def _history_sql(d):
    return f"""hist as (select cell, day, label,
        coalesce(sum(event_count) over (partition by cell order by day range between 30 preceding and 1 preceding), 0) as same_30d,
        coalesce(sum(event_count) over (partition by cell order by day range between 365 preceding and 1 preceding), 0) as same_365d,
        day - max(case when event_count > 0 then day end) over (partition by cell order by day range between unbounded preceding and 1 preceding) as same_days_since
        from panel)"""


def _neighbour_sql(d):
    return """nbday as (select a.cell, p.day, sum(p.event_count) as n from cells a join cells b
          on abs(a.x - b.x) <= 10000 and abs(a.y - b.y) <= 10000 join panel p on p.cell = b.cell group by a.cell, p.day),
      nb as (select cell, day, coalesce(sum(n) over (partition by cell order by day range between 30 preceding and 1 preceding), 0) as around_30d,
        coalesce(sum(n) over (partition by cell order by day range between 365 preceding and 1 preceding), 0) as around_365d from nbday)"""


@query(
    "D4 D6 E1 F1 G1 G2 G3",
    lambda d: f"""{_with(d)}, {_history_sql(d)}, {_neighbour_sql(d)}
      select cell, day, h.label, cast(same_30d as bigint) as same_30d, cast(same_365d as bigint) as same_365d, same_days_since,
        case when same_days_since is null then 1 else 0 end as same_censored,
        cast(around_30d as bigint) as around_30d, cast(around_365d as bigint) as around_365d from hist h join nb using (cell, day)""",
)
def past_only_panel(t: Tables):
    """Flagship: dense labels with strictly-past own-cell and 3x3 history."""
    counts = _counts(t)
    around = P.neighbourhood_counts(counts, t.sql(A.cells), "cell", DAY, "event_count", 10000)
    panel = _panel(t).select("cell", DAY, "label")
    return P.past_histories(panel, {"same": (counts, [30, 365]), "around": (around, [30, 365])}, "cell", DAY, "event_count", ("same",))


@query(
    "G1 G2",
    lambda d: f"""{_with(d)}, nbday as (select a.cell, p.day, sum(p.event_count) as n from cells a join cells b
          on abs(a.x - b.x) <= 10000 and abs(a.y - b.y) <= 10000 join panel p on p.cell = b.cell group by a.cell, p.day)
      select cell, day, cast(coalesce(sum(n) over (partition by cell order by day range between 1 preceding and 1 preceding), 0) as bigint) as around_1d,
        cast(coalesce(sum(n) over (partition by cell order by day range between 7 preceding and 1 preceding), 0) as bigint) as around_7d from nbday""",
)
def recent_neighbourhood(t: Tables):
    around = P.neighbourhood_counts(_counts(t), t.sql(A.cells), "cell", DAY, "event_count", 10000)
    return P.past_history(_panel(t).select("cell", DAY), around, "cell", DAY, "event_count", [1, 7], "around")


@query(
    "D4 D6 E1 E6 F1 F2 G1 G2 G3 G4 C11",
    lambda d: f"""{A.with_views(d, cells=A.cells, ev=A.ignitions, st=A.stations, obs=A.observations)}, {_panel_sql(d)}, {_history_sql(d)}, {_neighbour_sql(d)}, {_DAILY},
      rained as (select p.cell, p.day, count(w.rain) as coverage_days, case when count(w.rain) = 7 then sum(w.rain) end as rain_7d
        from panel p left join daily w on w.cell = p.cell and w.day between p.day - 7 and p.day - 1 group by p.cell, p.day)
      select h.cell, h.day, h.label, c.x, c.y, month(date '1970-01-01' + cast(h.day as integer)) as month, dayofyear(date '1970-01-01' + cast(h.day as integer)) as day_of_year,
        cast(same_30d as bigint) as same_30d, cast(same_365d as bigint) as same_365d, same_days_since, case when same_days_since is null then 1 else 0 end as same_censored,
        cast(around_30d as bigint) as around_30d, cast(around_365d as bigint) as around_365d, coalesce(w.missing, 1) as missing, w.station_count,
        {micro_sql('w.temp')} as temp_micro, {micro_sql('w.fwi')} as fwi_micro, r.coverage_days, {micro_sql('r.rain_7d')} as rain_micro
      from hist h join nb using (cell, day) join cells c on c.cell = h.cell left join daily w on w.cell = h.cell and w.day = h.day - 1
        join rained r on r.cell = h.cell and r.day = h.day""",
)
def feature_panel(t: Tables):
    """The panel end to end: calendar, place, prior-day weather, seven-day rain and past-only history in one row per cell and day."""
    history = past_only_panel(t)
    weather = checkpoint(daily_weather(t).select("cell", DAY, "missing", "station_count", "temp", "fwi", "rain"))
    panel = P.dimension_join(history, t.sql(A.cells).select("cell", "x", "y"), ["cell"])
    panel = P.prior_day(panel, weather.drop("rain"), ["cell"], DAY)
    rain = P.complete_window_sum(weather, ["cell"], DAY, "rain", 7, history)
    date = F.date_add(F.lit("1970-01-01").cast("date"), F.col(DAY).cast("int"))
    table = panel.join(rain, ["cell", DAY]).withColumns({"month": F.month(date), "day_of_year": F.dayofyear(date), "missing": F.coalesce("missing", F.lit(1))})
    kept = ["cell", DAY, "label", "x", "y", "month", "day_of_year", "same_30d", "same_365d", "same_days_since", "same_censored", "around_30d", "around_365d", "missing", "station_count", "coverage_days"]
    return table.select(*kept, micro("temp").alias("temp_micro"), micro("fwi").alias("fwi_micro"), micro("rain_7d").alias("rain_micro"))
