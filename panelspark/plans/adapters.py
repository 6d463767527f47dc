"""Domain views of the star-schema tables as SQL text both engines accept.

Every view keeps the whole source table; columns are whole numbers wherever the
engines could differ in a last bit.
"""

from __future__ import annotations

from panelspark.plans.registry import Dialect


def cells(d: Dialect) -> str:
    """5 x 5 lattice of 10 km cells, one per nation."""
    return f"""select cast(n_nationkey as bigint) as cell, cast((n_nationkey % 5) * 10000 as bigint) as x,
      cast(floor(n_nationkey / 5.0) * 10000 as bigint) as y, cast(n_regionkey as bigint) as region,
      -85e0 + (n_nationkey % 5) * 15e-2 as lon, 48e0 + floor(n_nationkey / 5.0) * 1e-1 as lat from {d.table('nation')}"""


def ignitions(d: Dialect) -> str:
    """Every order is an event in its customer's cell; `day` counts days since 1970."""
    return f"""select o_orderkey as event_id, cast(c_nationkey as bigint) as cell, {d.day('o_orderdate')} as day,
      case when o_totalprice >= 400000 then 1 else 0 end as large, o_totalprice as size,
      cast(substr(o_orderpriority, 1, 1) as int) as cause, o_orderstatus as status, o_custkey as cust
      from {d.table('orders')} join {d.table('customer')} on o_custkey = c_custkey"""


def observations(d: Dialect) -> str:
    """Line items as station records in source order `seq`; `fwi` and `rain` have gaps."""
    return f"""select l_suppkey as station, {d.day('l_shipdate')} as day, l_orderkey * 100000000 + l_linenumber * 10000000 + (l_partkey * 1009 + l_suppkey * 31 + cast(l_quantity as bigint)) % 10000000 as seq,
      case when l_linenumber % 5 = 0 then null else cast(l_quantity as bigint) end as fwi,
      cast(l_quantity as bigint) - 20 as temp, case when l_linenumber % 7 = 0 then null else cast(floor(l_tax * 100 + 5e-1) as bigint) end as rain,
      cast(floor(l_discount * 100 + 5e-1) as bigint) as calcstatus, l_returnflag as flag from {d.table('lineitem')}"""


def stations(d: Dialect) -> str:
    """Suppliers as stations on a lattice of places near the cells."""
    return f"""select s_suppkey as station, -856e-1 + (s_suppkey * 37 % 101) * 2e-2 as lon, 477e-1 + (s_suppkey * 53 % 97) * 1e-2 as lat
      from {d.table('supplier')}"""


def detections(d: Dialect) -> str:
    """User events as point detections in metres; `t` is epoch seconds."""
    return f"""select event_id as id, user_id as entity, {d.seconds('ts')} as t, cast(floor(value * 60) as bigint) % 9000 as x,
      event_id * 7919 % 7000 as y, cast(floor(value * 100) as bigint) as power, event_type as satellite,
      case when hour(ts) between 7 and 18 then 'D' else 'N' end as daynight from {d.table('events')}"""


def hourly(d: Dialect) -> str:
    """Weather per entity and hour, from that hour's events."""
    h = f"cast(floor({d.seconds('ts')} / 3600e0) as bigint) * 3600"
    return f"""select user_id as entity, {h} as t, sum(event_id % 40) as speed, max(event_id * 37 % 360) as direction,
      max(event_id % 30) as temp, min(event_id * 7 % 100) as rh, sum(event_id % 3) as precip from {d.table('events')}
      group by user_id, {h}"""


def predictions(d: Dialect) -> str:
    """Orders as scored rows: label, two tied scores, day, year, cell and a missing flag."""
    return f"""select o_orderkey as id, cast(c_nationkey as bigint) as cell, {d.day('o_orderdate')} as day, cast(year(o_orderdate) as bigint) as year,
      case when o_totalprice >= 400000 and (o_orderpriority = '1-URGENT' or o_orderkey % 11 = 0) then 1 else 0 end as y,
      floor(o_totalprice / 1000 + o_orderkey % 97) / 1024e0 as p, floor(o_totalprice / 800 + o_custkey % 211) / 1024e0 as p2,
      case when o_orderstatus = 'P' then 1 else 0 end as missing, o_totalprice as size
      from {d.table('orders')} join {d.table('customer')} on o_custkey = c_custkey"""


def pixels(d: Dialect) -> str:
    """Parts as 20 x 20 raster windows of 90 m with a code and an elevation."""
    return f"""select cast(floor(p_partkey / 400e0) as bigint) as win, cast(floor((p_partkey % 400) / 20e0) as bigint) as r, p_partkey % 20 as c,
      case p_size % 10 when 0 then 2 when 1 then 2 when 2 then 650 when 3 then 13 when 4 then 102 when 5 then 101 when 6 then 3
        when 7 then 31 when 8 then 625 else 77 end as code,
      cast(p_size as bigint) * 3 + p_partkey * 13 % 29 as elevation from {d.table('part')}"""


def polygon_edges(d: Dialect) -> str:
    """Per nation: a square, or for odd keys an L, both with a square hole, as directed ring edges in metres."""
    shapes = {
        0: ["0,0,9000,0", "9000,0,9000,9000", "9000,9000,0,9000", "0,9000,0,0"],
        1: ["0,0,9000,0", "9000,0,9000,4000", "9000,4000,4000,4000", "4000,4000,4000,9000", "4000,9000,0,9000", "0,9000,0,0"],
    }
    hole = ["1000,1000,1000,3000", "1000,3000,3000,3000", "3000,3000,3000,1000", "3000,1000,1000,1000"]
    rows = []
    for kind, outer in shapes.items():
        for ring, edges in ((0, outer), (1, hole)):
            rows += [f"({kind}, {ring}, {i}, {e})" for i, e in enumerate(edges)]
    return f"""select cast(n_nationkey as bigint) as poly, cast(s.ring as bigint) as ring, cast(s.i as bigint) as edge,
      (n_nationkey % 5) * 10000e0 + s.x1 as x1, floor(n_nationkey / 5.0) * 10000e0 + s.y1 as y1,
      (n_nationkey % 5) * 10000e0 + s.x2 as x2, floor(n_nationkey / 5.0) * 10000e0 + s.y2 as y2
      from {d.table('nation')} join (values {', '.join(rows)}) as s(kind, ring, i, x1, y1, x2, y2) on n_nationkey % 2 = s.kind"""


def points(d: Dialect) -> str:
    """Customers as points over the lattice; some fall exactly on ring edges."""
    return f"""select c_custkey as point, cast(c_custkey * 131 % 500 as double) * 100 as px, cast(c_custkey * 977 % 497 as double) * 100 as py,
      c_acctbal as balance from {d.table('customer')}"""


def with_views(d: Dialect, **views) -> str:
    """`WITH` clause naming adapter views."""
    return "with " + ", ".join(f"{name} as ({view(d)})" for name, view in views.items())


def site_hours(d: Dialect) -> str:
    """Weather per site (one of five groups of users) and hour; `cut` hours lack wind."""
    h = f"cast(floor({d.seconds('ts')} / 3600e0) as bigint) * 3600"
    return f"""select user_id % 5 as site, {h} as t, cast(max(event_id * 7 % 40) as double) as speed, cast(max(event_id * 37 % 360) as double) as direction,
      max(event_id % 30) as temp, min(event_id * 7 % 100) as rh, sum(event_id % 3) as rain from {d.table('events')}
      group by user_id % 5, {h}"""


def bins(d: Dialect) -> str:
    """Three-hour counts per native cell; some counts are unknown."""
    b = f"cast(floor({d.seconds('ts')} / 10800e0) as bigint) * 10800"
    return f"""select user_id % 12 as native, {b} as start, case when count(*) % 7 = 0 then null else count(*) end as n
      from {d.table('events')} group by user_id % 12, {b}"""


def season_weather(d: Dialect) -> str:
    """Daily noon weather per nation of the supplier and year, from line items."""
    return f"""select cast(s_nationkey as bigint) as site, cast(year(l_shipdate) as bigint) as season, {d.day('l_shipdate')} as day,
      cast(max(month(l_shipdate)) as int) as month, cast(max(l_quantity) - 15 as double) as temp, cast(min(l_partkey % 90) + 8 as double) as rh,
      cast(max(l_suppkey * 7 % 37) as double) as wind, cast(greatest(0, max(l_linenumber * 5 + l_partkey % 7) - 31) as double) as rain
      from {d.table('lineitem')} join {d.table('supplier')} on l_suppkey = s_suppkey group by s_nationkey, year(l_shipdate), {d.day('l_shipdate')}"""
