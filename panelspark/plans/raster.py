"""Raster-window, terrain and step queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions import geo
from panelspark.operators import nearest as N, raster as R, spatial as G, steps as T
from panelspark.plans import adapters as A
from panelspark.plans.registry import Tables, micro, micro_sql, query
from panelspark.session import checkpoint

# Fuel map code, group, conifer percent (NULL: does not burn).
CODES = (
    (1, "conifer", 100), (2, "conifer", 100), (3, "conifer", 100), (4, "conifer", 100), (5, "conifer", 100), (7, "conifer", 100),
    (11, "deciduous", 0), (13, "deciduous", 0), (31, "open", 0), (101, "non_fuel", None), (102, "water", None), (105, "non_fuel", None),
    (415, "mixedwood", 15), (625, "mixedwood", 25), (650, "mixedwood", 50), (675, "mixedwood", 75),
)
GROUPS = ["conifer", "mixedwood", "deciduous", "open", "non_fuel", "water"]
KEYS = ["entity", "observation"]
KEYS_SQL = ", ".join(KEYS)
#: Candidates are unburned cells within 6 km of the burned area, in cells of 375 m.
RADIUS = 16


def _codes(t: Tables):
    return t.spark.createDataFrame(list(CODES), "code int, `group` string, percent int")


@query("A9", lambda d: f"{A.with_views(d, px=A.pixels)} select win, r, c, 1000e0 + win * 5000 + (c + 5e-1) * 90 as px, 9000e0 - (r + 5e-1) * 90 as py from px")
def pixel_centres(t: Tables):
    return R.pixel_centres(t.sql(A.pixels), "r", "c", 1000.0 + F.col("win") * 5000, F.lit(9000.0), 90.0).select("win", "r", "c", "px", "py")


_GRAD = """n as (select *, lag(elevation) over wr as up, lead(elevation) over wr as dn, lag(elevation) over wc as lf, lead(elevation) over wc as rt from px
        window wr as (partition by win, c order by r), wc as (partition by win, r order by c)),
      g as (select *, case when up is null then (dn - elevation) / 90e0 when dn is null then (elevation - up) / 90e0 else (dn - up) / 180e0 end as ds,
        case when lf is null then (rt - elevation) / 90e0 when rt is null then (elevation - lf) / 90e0 else (rt - lf) / 180e0 end as de from n),
      s as (select *, 100 * sqrt(ds * ds + de * de) as slope, case when degrees(atan2(-de, ds)) < 0 then degrees(atan2(-de, ds)) + 360 else degrees(atan2(-de, ds)) end as aspect from g)"""


def _slopes(t: Tables):
    return R.slope_aspect(t.sql(A.pixels), ["win"], "r", "c", "elevation", 90.0)


@query("C17", lambda d: f"{A.with_views(d, px=A.pixels)}, {_GRAD} select win, r, c, {micro_sql('slope')} as slope_micro, {micro_sql('aspect % 360')} as aspect_micro from s")
def slope_and_aspect(t: Tables):
    return _slopes(t).select("win", "r", "c", micro("slope_pct").alias("slope_micro"), micro("aspect_deg").alias("aspect_micro"))


@query(
    "F12",
    lambda d: f"""{A.with_views(d, px=A.pixels)}, {_GRAD}, z as (select *, r between 5 and 14 and c between 5 and 14 as inside from s)
      select win, inside, {micro_sql('avg(elevation)')} as mean_micro, max(elevation) - min(elevation) as range_, {micro_sql('avg(slope)')} as slope_micro,
        {micro_sql('quantile_cont(slope, 0.9)')} as p90_micro, {micro_sql('avg(degrees(atan(slope / 100)))')} as deg_micro,
        {micro_sql('sum(sin(radians(aspect)) * slope) / sum(slope)')} as sin_micro, {micro_sql('sum(cos(radians(aspect)) * slope) / sum(slope)')} as cos_micro from z group by win, inside""",
)
def zone_terrain(t: Tables):
    """Terrain inside and outside a zone of each window."""
    zoned = _slopes(t).withColumn("inside", F.col("r").between(5, 14) & F.col("c").between(5, 14))
    z = R.zone_terrain(zoned, ["win", "inside"], "elevation")
    return z.select(
        "win", "inside", micro("mean").alias("mean_micro"), F.col("range").alias("range_"), micro("slope_mean").alias("slope_micro"), micro("slope_p90").alias("p90_micro"),
        micro("slope_mean_deg").alias("deg_micro"), micro("aspect_sin").alias("sin_micro"), micro("aspect_cos").alias("cos_micro"),
    )


@query(
    "F11 B7",
    lambda d: f"""{A.with_views(d, px=A.pixels)}, k(code, grp, pct) as (values {', '.join(f"({c}, '{g}', {'null' if p is None else p})" for c, g, p in CODES)}),
      j as (select win, px.code, grp, pct, count(*) as n from px left join k on k.code = px.code group by win, px.code, grp, pct)
      select win, cast(sum(n) as bigint) as cells, {', '.join(f"{micro_sql(f'''sum(case when grp = '{g}' then n else 0 end) / cast(sum(n) as double)''')} as {g}_micro" for g in GROUPS)},
        {micro_sql('sum(case when grp is null then n else 0 end) / cast(sum(n) as double)')} as unknown_micro,
        {micro_sql('sum(case when pct is not null then n * pct end) / cast(sum(case when pct is not null then n end) as double)')} as percent_micro,
        arg_max(code, case when pct is not null then n * 1000 + code end) as dominant_code from j group by win""",
)
def category_shares(t: Tables):
    s = R.category_shares(t.sql(A.pixels), ["win"], "code", _codes(t), GROUPS)
    return s.select("win", "cells", *[micro(f"{g}_share").alias(f"{g}_micro") for g in GROUPS], micro("unknown_share").alias("unknown_micro"),
                    micro("weighted_percent").alias("percent_micro"), "dominant_code")


@query(
    "F14",
    lambda d: f"""{A.with_views(d, px=A.pixels)}, p as (select *, (c + 5e-1) * 90 as x, 9000 - (r + 5e-1) * 90 as y from px)
      select win, cast(floor(x / 375) as bigint) as x, cast(floor(y / 375) as bigint) as y, {micro_sql('avg(elevation)')} as elevation_micro,
        {micro_sql('avg(case when code in (2, 3) then 1e0 else 0e0 end)')} as conifer_micro from p group by win, cast(floor(x / 375) as bigint), cast(floor(y / 375) as bigint)""",
)
def block_means(t: Tables):
    centred = R.pixel_centres(t.sql(A.pixels), "r", "c", F.lit(0.0), F.lit(9000.0), 90.0)
    b = R.block_mean(centred, ["win"], 375.0, {"elevation": F.col("elevation"), "conifer": F.col("code").isin(2, 3).cast("double")})
    return b.select("win", "x", "y", micro("elevation").alias("elevation_micro"), micro("conifer").alias("conifer_micro"))


_SMP = """o as (select * from unnest(generate_series(0, 8)) as g(sample)),
      s as (select p.c_custkey as cell, o.sample, case when (p.c_custkey + o.sample) % 41 = 0 then null else (p.c_custkey * (o.sample + 3) * 17) % 500 end as z from customer p, o)"""


@query(
    "C16 D5",
    lambda d: f"""with {_SMP},
      a as (select cell, avg(z) as mean, stddev_pop(z) as rug, count(z) as n,
        (avg(case when sample % 3 = 2 then z end) - avg(case when sample % 3 = 0 then z end)) / (2e4 / 3) as dx,
        (avg(case when sample >= 6 then z end) - avg(case when sample < 3 then z end)) / (2e4 / 3) as dy from s group by cell)
      select cell, {micro_sql('mean')} as mean_micro, {micro_sql('rug')} as rug_micro, n as sample_count, {micro_sql('n / 9e0')} as coverage_micro,
        case when n = 9 then {micro_sql('degrees(atan(sqrt(dx * dx + dy * dy)))')} end as slope_micro,
        case when n = 9 then {micro_sql('sin(atan2(-dx, -dy))')} end as sin_micro, case when n = 9 then {micro_sql('cos(atan2(-dx, -dy))')} end as cos_micro from a""",
)
def sample_terrain(t: Tables):
    """Nine samples per customer cell with some gaps."""
    cells = t.read("customer").select(F.col("c_custkey").alias("cell"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    samples = G.quadrature(cells, 10000.0)
    value = F.when((F.col("cell") + F.col("sample")) % 41 != 0, (F.col("cell") * (F.col("sample") + 3) * 17) % 500)
    s = R.sample_terrain(samples.withColumn("z", value), "cell", "sample", "z", 10000.0)
    names = {"elevation_mean": "mean", "ruggedness": "rug", "coverage_fraction": "coverage", "slope_deg": "slope", "aspect_sin": "sin", "aspect_cos": "cos"}
    return s.select("cell", "sample_count", *[micro(c).alias(f"{n}_micro") for c, n in names.items()])


@query(
    "D5 C2",
    lambda d: f"""{A.with_views(d, cells=A.cells)}, o as (select * from unnest(generate_series(0, 8)) as g(sample))
      select cell, cast(sample as bigint) as sample, {micro_sql('x + 5000 + (sample % 3 - 1) * 1e4 / 3')} as sx_micro, {micro_sql('y + 5000 + (floor(sample / 3) - 1) * 1e4 / 3')} as sy_micro from cells, o""",
)
def quadrature_points(t: Tables):
    q = G.quadrature(t.sql(A.cells), 10000.0)
    return q.select("cell", F.col("sample").cast("long").alias("sample"), micro("sx").alias("sx_micro"), micro("sy").alias("sy_micro"))


_LCC = geo.ConformalConic()


def _project_sql() -> str:
    e, n = _LCC.eccentricity, _LCC.cone
    iso = f"tan(radians((90 - lat) / 2)) * pow((1 + {e!r} * sin(radians(lat))) / (1 - {e!r} * sin(radians(lat))), {e / 2!r})"
    return f"""r as (select *, {_LCC.scale!r} * pow({iso}, {n!r}) as rho, {n!r} * radians(lon + 95) as theta from pts),
      xy as (select *, rho * sin(theta) as x, {_LCC.origin_radius!r} - rho * cos(theta) as y from r)"""


_LONLAT = "with pts as (select c_custkey as point, -96e0 + c_custkey * 131 % 2000 / 1e2 as lon, 42e0 + c_custkey * 977 % 1500 / 1e2 as lat from customer)"


def _lonlat(t: Tables):
    k = F.col("c_custkey")
    return t.read("customer").select(k.alias("point"), (k * 131 % 2000 / 100.0 - 96.0).alias("lon"), (k * 977 % 1500 / 100.0 + 42.0).alias("lat"))


@query("C1 C3 C4 C7", lambda d: f"""{_LONLAT}, {_project_sql()}
      select point, cast(floor(x * 1000 + 5e-1) as bigint) as x_mm, cast(floor(y * 1000 + 5e-1) as bigint) as y_mm,
        cast(floor(x / 10000) as bigint) * 10000 as cell_x, cast(floor(y / 10000) as bigint) * 10000 as cell_y,
        'cell_' || cast(cast(floor(x / 10000) as bigint) * 10000 as varchar) || '_' || cast(cast(floor(y / 10000) as bigint) * 10000 as varchar) as cell_id,
        {micro_sql(f'(lon + 95) * {_LCC.cone!r}')} as convergence_micro from xy""")
def projected_cells(t: Tables):
    p = _lonlat(t)
    x, y = _LCC.project(F.col("lon"), F.col("lat"))
    p = p.withColumns({"x": x, "y": y})
    cx, cy = geo.cell_origin(F.col("x"), 10000), geo.cell_origin(F.col("y"), 10000)
    mm = lambda c: F.floor(F.col(c) * 1000 + 0.5).cast("bigint")
    return p.select("point", mm("x").alias("x_mm"), mm("y").alias("y_mm"), cx.alias("cell_x"), cy.alias("cell_y"), geo.cell_name("cell", cx, cy).alias("cell_id"),
                    micro(_LCC.convergence(F.col("lon"))).alias("convergence_micro"))


@query("C1 C2", lambda d: f"{_LONLAT} select point, {micro_sql('lon')} as lon_micro, {micro_sql('lat')} as lat_micro from pts")
def projection_round_trip(t: Tables):
    """Unprojecting the projected point gives back the longitude and latitude."""
    x, y = _LCC.project(F.col("lon"), F.col("lat"))
    p = _lonlat(t).withColumns({"x": x, "y": y})
    lon, lat = _LCC.unproject(F.col("x"), F.col("y"))
    return p.select("point", micro(lon).alias("lon_micro"), micro(lat).alias("lat_micro"))


@query("D9", lambda d: f"""{A.with_views(d, e=A.polygon_edges)} select poly, cast(floor((min(x1) - 2000) / 90) * 90 as bigint) as west, cast(floor((min(y1) - 2000) / 90) * 90 as bigint) as south,
      cast(ceil((max(x1) + 2000) / 90) * 90 as bigint) as east, cast(ceil((max(y1) + 2000) / 90) * 90 as bigint) as north from e group by poly""")
def snapped_windows(t: Tables):
    b = t.sql(A.polygon_edges).groupBy("poly").agg(F.min("x1").alias("w"), F.min("y1").alias("s"), F.max("x1").alias("e"), F.max("y1").alias("n"))
    return b.select("poly", *[c.cast("bigint").alias(n) for n, c in geo.snapped_window(F.col("w"), F.col("s"), F.col("e"), F.col("n"), 90.0, 2000.0).items()])


@query("C8 C15", lambda d: f"""{A.with_views(d, det=A.detections)}
      select id, abs((x % 360 - y % 360 + 540) % 360 - 180) as angle, t + case when x % 20 < 10 then -6 else -5 end * 3600 as local_t from det""")
def angles_and_local_time(t: Tables):
    det = t.sql(A.detections)
    from panelspark.functions.calendar import local_seconds

    angle = geo.angle_between((F.col("x") % 360).cast("double"), (F.col("y") % 360).cast("double")).cast("bigint")
    return det.select("id", angle.alias("angle"), local_seconds(F.col("t"), F.col("x") % 20 - 100.0).alias("local_t"))


#: Fewest newly seen cells of a usable replay step.
LEAST_NEW = 5


def _flood(cells: str, keys: str) -> str:
    """Oracle steps from the table `cells`: gaps closed (er), and all that the outside does not reach (in `filled`)."""
    same = lambda a, b: " and ".join(f"{a}.{k} = {b}.{k}" for k in keys.split(", "))
    of = lambda a: ", ".join(f"{a}.{k}" for k in keys.split(", "))
    return f"""o as (select i, j from unnest(generate_series(-2, 2)) as a(i), unnest(generate_series(-2, 2)) as b(j)),
      dl as (select distinct {keys}, x + i as x, y + j as y from {cells}, o),
      er as materialized (select {keys}, x + i as x, y + j as y from dl, o group by {keys}, x + i, y + j having count(*) = 25),
      bx as (select {keys}, min(x) - 1 as a, max(x) + 1 as b, min(y) - 1 as c, max(y) + 1 as e from er group by {keys}),
      fr as materialized (select {keys}, u.x, v.y from bx, unnest(generate_series(a, b)) as u(x), unnest(generate_series(c, e)) as v(y)
        where not exists (select 1 from er where {same('er', 'bx')} and er.x = u.x and er.y = v.y)),
      outside_ as (select {keys}, a as x, c as y from bx union select {of('f')}, f.x, f.y from outside_ s, (values (0, 1), (0, -1), (1, 0), (-1, 0)) m(i, j), fr f
        where {same('f', 's')} and f.x = s.x + m.i and f.y = s.y + m.j),
      filled as materialized (select * from er union select {keys}, x, y from {cells} union (select * from fr except select * from outside_))"""


@query(
    "G17 G16",
    lambda d: f"""{A.with_views(d, det=A.detections).replace('with det', 'with recursive det')},
      se as (select entity % 20 as entity, cast(floor(t / 86400e0) as bigint) as o, t, cast(floor(x / 375e0) as bigint) as x, cast(floor(y / 375e0) as bigint) as y from det),
      ob as (select entity, o, min(t) as t from se group by entity, o), ar as (select entity, x, y, min(o) as f from se group by entity, x, y),
      st as materialized (select a.entity, a.o as observation, b.o as next_observation, (b.t - a.t) / 3600e0 as hours from ob a join ob b on b.entity = a.entity and b.o = a.o + 1),
      wk as materialized (select s.entity, s.observation, r.x, r.y from st s join ar r on r.entity = s.entity and r.f <= s.observation),
      {_flood('wk', KEYS_SQL)},
      fs as (select s.entity, s.observation, r.x, r.y from st s join ar r on r.entity = s.entity and r.f = s.next_observation
        where not exists (select 1 from filled f where f.entity = s.entity and f.observation = s.observation and f.x = r.x and f.y = r.y)),
      eg as materialized (select f.* from filled f join (select entity, observation, x + i as x, y + j as y, count(*) as n from filled, o where abs(i) <= 1 and abs(j) <= 1 group by all) c using (entity, observation, x, y) where c.n < 9),
      re as (select distinct s.entity, s.observation, e.x + i as x, e.y + j as y from st s join se e on e.entity = s.entity and e.o = s.observation, o where abs(i) <= 1 and abs(j) <= 1),
      nr as (select eg.* from eg join re using (entity, observation, x, y)),
      ac as (select entity, observation, count(*) as n from (select * from nr union all select * from eg where not exists (select 1 from nr where nr.entity = eg.entity and nr.observation = eg.observation)) group by all),
      nf as (select entity, observation, count(*) as n from fs group by all), ns as (select entity, observation, count(*) as n from filled group by all)
      select s.entity, s.observation, s.next_observation, {micro_sql('hours')} as hours_micro, ns.n as start_cells, ac.n as active_cells, coalesce(nf.n, 0) as observed_new,
        hours between 6 and 30 and coalesce(nf.n, 0) >= {LEAST_NEW} as usable
      from st s left join nf using (entity, observation) left join ns using (entity, observation) left join ac using (entity, observation)""",
)
def replay_steps(t: Tables):
    """Steps from day to day: the repaired burned area at the start, its active edge, the cells newly seen at the end, and the usable flag."""
    day = F.floor(F.col("t") / 86400).cast("long").alias("observation")
    obs = checkpoint(t.sql(A.detections).select((F.col("entity") % 20).alias("entity"), day, "t", geo.cell_index(F.col("x"), 375).alias("x"), geo.cell_index(F.col("y"), 375).alias("y")))
    steps = checkpoint(T.consecutive_steps(obs.groupBy("entity", "observation").agg(F.min("t").alias("t")), "entity", "observation", "t"))
    arrivals = obs.groupBy("entity", "x", "y").agg(F.min("observation").alias("first_session"))
    start, fresh = T.step_cells(steps, arrivals, "entity", "observation")
    recent = obs.select("entity", "observation", "x", "y").distinct().join(steps.select("entity", "observation"), KEYS, "left_semi")
    sizes = [c.groupBy(*KEYS).agg(F.count(F.lit(1)).alias(n)) for c, n in ((start, "start_cells"), (T.active_edge(start, recent, KEYS), "active_cells"))]
    steps = T.usable_steps(steps, fresh, "entity", "observation", least=LEAST_NEW)
    for size in sizes:
        steps = steps.join(size, KEYS, "left")
    return steps.select(*KEYS, "next_observation", micro("hours").alias("hours_micro"), "start_cells", "active_cells", "observed_new", "usable")


def _weekly(t: Tables):
    """Cells burned per entity group by week: a compact burned set per key."""
    det = t.sql(A.detections)
    return det.select((F.col("entity") % 10).alias("entity"), (F.floor(F.col("t") / 604800)).cast("long").alias("observation"),
                      geo.cell_index(F.col("x"), 375).alias("x"), geo.cell_index(F.col("y"), 375).alias("y")).distinct()


_WEEK = """wk as (select distinct entity % 10 as entity, cast(floor(t / 604800e0) as bigint) as observation, cast(floor(x / 375e0) as bigint) as x, cast(floor(y / 375e0) as bigint) as y from det)"""
_EDGE = """nbc as (select a.entity, a.observation, a.x, a.y, count(*) as n from wk a join wk b on a.entity = b.entity and a.observation = b.observation
        and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1 group by a.entity, a.observation, a.x, a.y), edg as (select entity, observation, x, y from nbc where n < 9)"""


@query(
    "D8",
    lambda d: f"""{A.with_views(d, det=A.detections)}, {_WEEK},
      o as (select i, j from unnest(generate_series(-{RADIUS}, {RADIUS})) as a(i), unnest(generate_series(-{RADIUS}, {RADIUS})) as b(j) where i * i + j * j <= {RADIUS * RADIUS}),
      m as (select entity, observation, x + i as x, y + j as y, min((i * i + j * j, x, y)) as b from wk, o group by entity, observation, x + i, y + j),
      c as (select entity, observation, x, y, b[1] as burned_d2, b[2] as burned_x, b[3] as burned_y from m)
      select * from c where not exists (select 1 from wk where wk.entity = c.entity and wk.observation = c.observation and wk.x = c.x and wk.y = c.y)""",
)
def candidate_cells(t: Tables):
    return N.candidate_cells(checkpoint(_weekly(t)), KEYS, RADIUS)


@query(
    "G16 G15",
    lambda d: f"""{A.with_views(d, det=A.detections)}, {_WEEK}, {_EDGE}
      select n.entity, n.observation, n.x, n.y, n.n as block_count, e.x is not null as edge from nbc n left join edg e using (entity, observation, x, y)""",
)
def edges_and_block_counts(t: Tables):
    """Cells with the number of set cells in their 3x3 block, and whether erosion removes them."""
    cells = checkpoint(_weekly(t))
    counts = cells.join(G.neighbour_counts(cells, KEYS, 1, "block_count"), [*KEYS, "x", "y"])
    edge = G.edge_cells(cells, KEYS).withColumn("edge", F.lit(True))
    return counts.join(edge, [*KEYS, "x", "y"], "left").fillna(False, ["edge"])


@query(
    "G16",
    lambda d: f"""{A.with_views(d, det=A.detections).replace('with det', 'with recursive det')}, {_WEEK},
      {_flood('wk', KEYS_SQL)}
      select * from filled""",
)
def burned_area(t: Tables):
    """Gaps closed and holes filled per entity group and week (recursive flood fill as the oracle)."""
    return R.burned_area(checkpoint(_weekly(t)), KEYS)


@query(
    "G18 G15 G19 G20 D8 C6 C8",
    lambda d: f"""{A.with_views(d, det=A.detections)}, {_WEEK}, {_EDGE},
      o as (select i, j from unnest(generate_series(-{RADIUS}, {RADIUS})) as a(i), unnest(generate_series(-{RADIUS}, {RADIUS})) as b(j) where i * i + j * j <= {RADIUS * RADIUS}),
      cd as (select entity, observation, x + i as x, y + j as y, min(i * i + j * j) as bd from wk, o group by entity, observation, x + i, y + j),
      ca as (select * from cd where not exists (select 1 from wk where wk.entity = cd.entity and wk.observation = cd.observation and wk.x = cd.x and wk.y = cd.y)),
      ne as (select c.*, e.x as nx, e.y as ny, (c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y) as d2, row_number() over (partition by c.entity, c.observation, c.x, c.y
          order by (c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y), e.x, e.y) as rn from ca c join edg e on e.entity = c.entity and e.observation = c.observation),
      gm as (select *, sqrt(d2) * 375 as dist, cos(atan2(x - nx, y - ny) - radians(observation % 360)) as cw from ne where rn = 1),
      bn as (select g.entity, g.observation, g.x, g.y, count(*) as burned from gm g join wk on wk.entity = g.entity and wk.observation = g.observation and abs(wk.x - g.x) <= 3 and abs(wk.y - g.y) <= 3 group by all),
      an as (select g.entity, g.observation, g.x, g.y, count(*) as active from gm g join edg wk on wk.entity = g.entity and wk.observation = g.observation and abs(wk.x - g.x) <= 3 and abs(wk.y - g.y) <= 3 group by all),
      hs as (select entity, observation, count(*) as cells from wk group by entity, observation)
      select g.entity, g.observation, g.x, g.y, nx as near_x, ny as near_y, {micro_sql('sqrt(bd) * 375')} as burned_micro, {micro_sql('dist')} as active_micro,
        {micro_sql('cw')} as downwind_micro, {micro_sql('sqrt(greatest(0, 1 - cw * cw))')} as cross_micro, {micro_sql('dist * cw')} as along_micro, {micro_sql('dist * sqrt(greatest(0, 1 - cw * cw))')} as across_micro,
        coalesce(burned, 0) as burned_nearby, coalesce(active, 0) as active_nearby, hs.cells as previous_cells,
        {micro_sql('((g.x * 7 + g.y * 3) % 50 - (nx * 7 + ny * 3) % 50) / dist')} as slope_micro
      from gm g left join bn using (entity, observation, x, y) left join an using (entity, observation, x, y) left join hs using (entity, observation)""",
)
def candidate_features(t: Tables):
    """Wind-relative geometry, neighbourhood counts, history lookup and rise for candidates within 6 km."""
    burned = checkpoint(_weekly(t))
    active = checkpoint(G.edge_cells(burned, KEYS))
    wind = burned.select(*KEYS).distinct().withColumn("downwind_deg", (F.col("observation") % 360).cast("double"))
    f = T.candidate_features(burned, active, KEYS, RADIUS, wind, 375.0)
    spots = f.select(*KEYS, "x", "y").union(active.select(*KEYS, "x", "y")).distinct()
    elevation = spots.withColumn("elevation", ((F.col("x") * 7 + F.col("y") * 3) % 50).cast("double"))
    f = T.rise_from_front(f, elevation, KEYS)
    f = T.previous_step(f, burned.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("cells")), KEYS, ["cells"])
    names = {"distance_to_burned": "burned", "distance_to_active": "active", "downwind_cos": "downwind", "crosswind_sin": "cross", "along_wind": "along", "across_wind": "across", "slope_from_front": "slope"}
    return f.select(*KEYS, "x", "y", "near_x", "near_y", "burned_nearby", "active_nearby", "previous_cells", *[micro(c).alias(f"{n}_micro") for c, n in names.items()])
