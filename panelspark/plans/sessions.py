"""Session, growth and polygon queries over detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.geo import cell_index
from panelspark.operators import sessions as S, spatial as G
from panelspark.plans import adapters as A
from panelspark.plans.registry import Tables, micro, micro_sql, query

GAP = 6 * 3600


def sessions(t: Tables, gap: int = GAP):
    found = S.sessionise(t.sql(A.detections), "entity", "t", gap)
    return found.withColumns({"cx": cell_index(F.col("x"), 375), "cy": cell_index(F.col("y"), 375)})


def _sql(d, gap=GAP):
    return f"""{A.with_views(d, det=A.detections)},
      step as (select *, case when t - lag(t) over w <= {gap} then 0 else 1 end as fresh from det window w as (partition by entity order by t, id)),
      ses as (select *, sum(fresh) over (partition by entity order by t, id) as session, cast(floor(x / 375e0) as bigint) as cx,
        cast(floor(y / 375e0) as bigint) as cy from step)"""


def _arr(d):
    return f"{_sql(d)}, arr as (select entity, cx, cy, min(session) as first_session from ses group by entity, cx, cy)"


@query("G6", lambda d: f"{_sql(d, 5400)} select id, entity, cast(session as bigint) as session from ses")
def gap_sessions_90_minutes(t: Tables):
    return sessions(t, 5400).select("id", "entity", "session")


@query("G6 C3", lambda d: f"{_sql(d)} select id, entity, cast(session as bigint) as session, cx, cy from ses")
def gap_sessions_6_hours(t: Tables):
    return sessions(t).select("id", "entity", "session", "cx", "cy")


@query("G7", lambda d: f"{_arr(d)} select entity, cx as x, cy as y, cast(first_session as bigint) as first_session from arr")
def arrival_cells(t: Tables):
    return S.arrival_cells(sessions(t), "entity", "session")


@query(
    "F7 G7 G8",
    lambda d: f"""{_arr(d)},
      mode as (select entity, session, daynight, row_number() over (partition by entity, session order by count(*) desc, daynight) as rn
        from ses group by entity, session, daynight),
      mid as (select entity, session, t, row_number() over (partition by entity, session order by t, id) - 1 as i, count(*) over (partition by entity, session) as n from ses),
      lab as (select entity, session, string_agg(satellite, '+' order by satellite) as labels from (select distinct entity, session, satellite from ses) group by entity, session),
      new as (select entity, first_session as session, count(*) as new_cells from arr group by entity, first_session),
      base as (select entity, session, count(*) as detections, count(distinct cx * 1000 + cy) as cells_detected, sum(power) as power_total, max(power) as power_max
        from ses group by entity, session),
      tab as (select b.*, coalesce(new_cells, 0) as new_cells, m.daynight as category, labels, mid.t as middle_time from base b
        left join new using (entity, session) join mode m on m.entity = b.entity and m.session = b.session and m.rn = 1
        join lab on lab.entity = b.entity and lab.session = b.session
        join mid on mid.entity = b.entity and mid.session = b.session and mid.i = cast(floor(mid.n / 2e0) as bigint))
      select entity, cast(session as bigint) as session, detections, cells_detected, cast(power_total as bigint) as power_total, power_max, new_cells,
        category, labels, middle_time, cast(sum(new_cells) over w as bigint) as cumulative_cells,
        {micro_sql('(middle_time - lag(middle_time) over w) / 3600e0')} as hours_previous_micro,
        {micro_sql('(middle_time - first_value(middle_time) over w) / 3600e0')} as hours_first_micro
      from tab window w as (partition by entity order by session)""",
)
def session_summary(t: Tables):
    table = S.session_summary(sessions(t), "entity", "session", "t", "power", "daynight", "satellite")
    return table.withColumns({"hours_previous_micro": micro("hours_since_previous"), "hours_first_micro": micro("hours_since_first")}).drop(
        "hours_since_previous", "hours_since_first"
    )


def _offsets_sql(d):
    return f"""{_arr(d)},
      near as (select a.entity, a.first_session as session, a.cx, a.cy, b.cx as qx, b.cy as qy, row_number() over (partition by a.entity, a.cx, a.cy
          order by (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy), b.cx, b.cy) as rn
        from arr a join arr b on a.entity = b.entity and b.first_session < a.first_session),
      off as (select entity, session, cx as x, cy as y, cast(cx - qx as double) as dx, cast(cy - qy as double) as dy from near where rn = 1)"""


@query("E9", lambda d: f"{_offsets_sql(d)} select entity, cast(session as bigint) as session, x, y, dx, dy from off")
def nearest_earlier_cells(t: Tables):
    return S.growth_offsets(sessions(t), "entity", "session").select("entity", "session", "x", "y", "dx", "dy")


@query(
    "E9",
    lambda d: f"""{_offsets_sql(d)}, first as (select entity, cx, cy from arr where first_session = 1)
      select entity, cx as x, cy as y, {micro_sql('cx + 5e-1 - (entity % 20)')} as dx_micro, {micro_sql('cy + 5e-1 - (entity % 17)')} as dy_micro,
        'reported_origin' as reference from first""",
)
def growth_from_reported_origin(t: Tables):
    """First-session cells measured from a reported origin point per entity."""
    found = sessions(t)
    origin = found.select("entity").distinct().select("entity", (F.col("entity") % 20).alias("ox"), (F.col("entity") % 17).alias("oy"))
    offsets = S.growth_offsets(found, "entity", "session", origin).where("reference = 'reported_origin'")
    return offsets.select("entity", "x", "y", micro("dx").alias("dx_micro"), micro("dy").alias("dy_micro"), "reference")


@query(
    "F9 C6",
    lambda d: f"""{_offsets_sql(d)},
      m as (select *, sqrt(dx * dx + dy * dy) * 375 as dist from off), q as (select entity, session, quantile_cont(dist, 0.9) as p90 from m group by entity, session),
      g as (select entity, session, avg(dist) as dmean, max(p90) as p90, max(dist) as dmax, avg(dx) as gx, avg(dy) as gy,
        avg(case when dist >= p90 then dx end) as hx, avg(case when dist >= p90 then dy end) as hy from m join q using (entity, session) group by entity, session)
      select entity, cast(session as bigint) as session, {micro_sql('dmean')} as mean_micro, {micro_sql('p90')} as p90_micro, {micro_sql('dmax')} as max_micro,
        case when sqrt(gx * gx + gy * gy) >= 1e-9 then {micro_sql('degrees(atan2(gx, gy)) + case when atan2(gx, gy) < 0 then 360 else 0 end')} end as bearing_micro,
        case when sqrt(hx * hx + hy * hy) >= 1e-9 then {micro_sql('degrees(atan2(hx, hy)) + case when atan2(hx, hy) < 0 then 360 else 0 end')} end as head_micro,
        {micro_sql('sqrt(gx * gx + gy * gy) * 375 / dmean')} as directionality_micro from g""",
)
def growth_geometry(t: Tables):
    g = S.growth_geometry(S.growth_offsets(sessions(t), "entity", "session"), ["entity", "session"], 375.0)
    return g.select(
        "entity", "session", micro("distance_mean").alias("mean_micro"), micro("distance_p90").alias("p90_micro"), micro("distance_max").alias("max_micro"),
        micro("bearing").alias("bearing_micro"), micro("head_bearing").alias("head_micro"), micro("directionality").alias("directionality_micro"),
    )


_REPORTED = "select distinct entity, 19723 + entity % 5 as start_day, cast(40 + entity % 60 as double) as area from det"


def entities(t: Tables):
    """Entity summary with growth steps and the trackable flag."""
    found = sessions(t)
    reported = found.select("entity").distinct().select(
        "entity", (F.lit(19723) + F.col("entity") % 5).alias("start_day"), (F.lit(40) + F.col("entity") % 60).cast("double").alias("area"))
    summary = S.entity_summary(found, "entity", "session", "t", reported, "start_day", "area")
    steps = S.arrival_cells(found, "entity", "session").where("first_session > 1").groupBy("entity").agg(F.countDistinct("first_session").alias("growth_steps"))
    return S.trackable(summary, steps, "entity")


@query(
    "F8 F10",
    lambda d: f"""{_arr(d)}, rep as ({_REPORTED}),
      s as (select entity, min(t) as first_time, max(t) as last_time, arg_min(x, t * 1000000 + id) as first_x, arg_min(y, t * 1000000 + id) as first_y,
        count(*) as detections, cast(max(session) as bigint) as sessions from ses group by entity),
      c as (select entity, count(*) as cells, count(distinct case when first_session > 1 then first_session end) as growth_steps from arr group by entity)
      select entity, first_time, last_time, first_x, first_y, detections, sessions, cells, {micro_sql('cells / area')} as share_micro,
        cast(floor(first_time / 86400e0) as bigint) - start_day as lag_days, growth_steps, growth_steps >= 3 and cells / area >= 2e-1 as trackable
      from s join c using (entity) join rep using (entity)""",
)
def entity_summary(t: Tables):
    return entities(t).withColumn("share_micro", micro("detected_share")).drop("detected_share")


_COVER = """hit as (select point, poly, sum(case when (y1 > py) <> (y2 > py) and px < (x2 - x1) * (py - y1) / nullif(y2 - y1, 0) + x1 then 1 else 0 end) as hits,
        min(sqrt(pow(px - (x1 + a * (x2 - x1)), 2) + pow(py - (y1 + a * (y2 - y1)), 2))) as dist
      from (select p.point, px, py, e.poly, x1, y1, x2, y2,
          greatest(0, least(1, ((px - x1) * (x2 - x1) + (py - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) as a from pts p, edges e) group by point, poly)"""


@query("E3 C22", lambda d: f"{A.with_views(d, pts=A.points, edges=A.polygon_edges)}, {_COVER} select point, poly from hit where hits % 2 = 1 or dist <= 1e-9")
def covered_points(t: Tables):
    return G.covered_points(t.sql(A.points), t.sql(A.polygon_edges), "point", "poly", 5000.0)


_WINDOWS = "select distinct poly, (poly % 4) * 50 as start, 200 + poly * 60 as end_ from edges"


@query(
    "E8",
    lambda d: f"""{A.with_views(d, pts=A.points, edges=A.polygon_edges)}, {_COVER}, win as ({_WINDOWS}),
      ok as (select c.point, c.poly, case when hits % 2 = 1 then 0 else dist end as gap from hit c join win w using (poly)
        where (hits % 2 = 1 or dist <= 750) and c.point % 997 >= w.start and c.point % 997 < w.end_)
      select point, arg_min(poly, gap * 1000 + poly / 1000e0) as poly, {micro_sql('min(gap)')} as gap_micro, count(*) as claims from ok group by point""",
)
def owned_points(t: Tables):
    edges = t.sql(A.polygon_edges)
    windows = edges.select("poly").distinct().select("poly", (F.col("poly") % 4 * 50).alias("start"), (F.lit(200) + F.col("poly") * 60).alias("end"))
    points = t.sql(A.points).withColumn("t", F.col("point") % 997)
    return G.owned_points(points, edges, windows, "point", "poly", "t", 5000.0, 750.0).select("point", "poly", micro("gap").alias("gap_micro"), "claims")


@query(
    "E19",
    lambda d: f"""{A.with_views(d, pts=A.points, edges=A.polygon_edges)}, {_COVER}
      select c.point, c.hits % 2 = 1 or c.dist <= 1e-9 as inside, {micro_sql('case when hits % 2 = 1 then 0 else dist end')} as distance_micro
      from hit c join pts p using (point) where c.poly = p.point % 25""",
)
def polygon_relation(t: Tables):
    assigned = t.sql(A.points).withColumn("poly", F.col("point") % 25)
    r = G.polygon_relation(assigned, t.sql(A.polygon_edges), "point", "poly")
    return r.select("point", "inside", micro("distance").alias("distance_micro"))


@query(
    "C22",
    lambda d: f"""{A.with_views(d, edges=A.polygon_edges)} select poly, ring, {micro_sql('sum(x1 * y2 - x2 * y1) / 2')} as area_micro from edges group by poly, ring""",
)
def ring_areas(t: Tables):
    return G.ring_area(t.sql(A.polygon_edges), ["poly", "ring"]).select("poly", "ring", micro("signed_area").alias("area_micro"))


@query(
    "C23",
    lambda d: f"""{A.with_views(d, edges=A.polygon_edges)},
      r as (select poly, ring, sum(x1 * y2 - x2 * y1) as a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) as sx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) as sy,
        min(x1) as west, min(y1) as south, max(x1) as east, max(y1) as north from edges group by poly, ring),
      s as (select *, sign(a) * case when ring = 0 then 1 else -1 end as g from r)
      select poly, {micro_sql('min(west)')} as west, {micro_sql('min(south)')} as south, {micro_sql('max(east)')} as east, {micro_sql('max(north)')} as north,
        {micro_sql('sum(g * a) / 2')} as area, {micro_sql('sum(g * sx) / (3 * sum(g * a))')} as centroid_x, {micro_sql('sum(g * sy) / (3 * sum(g * a))')} as centroid_y,
        count(*) as rings, {micro_sql('sum(g * a) / 2 / 7e7')} as ratio from s group by poly""",
)
def polygon_summary(t: Tables):
    p = G.polygon_summary(t.sql(A.polygon_edges), "poly", "ring").withColumn("ratio", F.col("area") / 7e7)
    return p.select("poly", "rings", *[micro(c).alias(c) for c in ("west", "south", "east", "north", "area", "centroid_x", "centroid_y", "ratio")])


@query(
    "E7",
    lambda d: f"""{A.with_views(d, ev=A.ignitions)}, cu as (select c_custkey as cust, c_acctbal * 30 as balance, cast(c_nationkey as bigint) as cell from customer),
      o as (select cell, max(size) as size from ev group by cell),
      r as (select o.cell, o.size, c.cust, c.balance, count(c.balance) over (partition by o.cell) as candidates,
        row_number() over (partition by o.cell order by abs(o.size - c.balance), c.cust) as rn from o left join cu c using (cell))
      select cell, size, candidates, cust, balance from r where rn = 1""",
)
def best_size_match(t: Tables):
    """Per cell, the customer whose scaled balance is closest to the largest order."""
    left = t.sql(A.ignitions).groupBy("cell").agg(F.max("size").alias("size"))
    right = t.read("customer").select(F.col("c_nationkey").cast("long").alias("cell"), F.col("c_custkey").alias("cust"), (F.col("c_acctbal") * 30).alias("balance"))
    return S.best_match(left, right, ["cell"], "size", "balance", "cust")


@query(
    "D3 D2",
    lambda d: f"""{A.with_views(d, pts=A.points, edges=A.polygon_edges)},
      box as (select min(x1) as w, max(x1) as e, min(y1) as s, max(y1) as n from edges),
      cand as (select gx * 1000 as x, gy * 1000 as y from box, unnest(generate_series(cast(floor(w / 1000) as bigint), cast(floor(e / 1000) as bigint))) as a(gx),
        unnest(generate_series(cast(floor(s / 1000) as bigint), cast(floor(n / 1000) as bigint))) as b(gy)),
      hit as (select x, y, poly, sum(case when (y1 > y + 500) <> (y2 > y + 500) and x + 500 < (x2 - x1) * (y + 500 - y1) / nullif(y2 - y1, 0) + x1 then 1 else 0 end) as hits
        from cand, edges group by x, y, poly)
      select x, y from hit where hits % 2 = 1
      union select cast(floor(px / 1000) * 1000 as bigint), cast(floor(py / 1000) * 1000 as bigint) from pts""",
)
def grid_membership(t: Tables):
    """Cells whose centre is covered by any polygon, plus the cells that hold a point."""
    from panelspark.operators.panel import candidate_grid, grid_membership as member

    edges = t.sql(A.polygon_edges)
    extent = edges.agg(F.min("x1").alias("min_x"), F.max("x1").alias("max_x"), F.min("y1").alias("min_y"), F.max("y1").alias("max_y"))
    grid = candidate_grid(extent, 1000).select("x", "y")
    centres = grid.select(F.struct("x", "y").alias("cell"), (F.col("x") + 500.0).alias("px"), (F.col("y") + 500.0).alias("py"))
    covered = G.covered_points(centres, edges, "cell", "poly", 5000.0).select("cell.x", "cell.y").distinct()
    holding = t.sql(A.points).select(*[(F.floor(F.col(c) / 1000) * 1000).cast("long").alias(n) for c, n in (("px", "x"), ("py", "y"))])
    return member(grid, covered, holding, ["x", "y"])
