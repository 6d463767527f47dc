"""Modelling queries: splits, preprocessing, fits, search, calibration and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import boosting as B, metrics as M, model as L
from panelspark.plans import adapters as A
from panelspark.plans.registry import Tables, micro, micro_sql, query

FEATURES = ("size_scaled", "season", "load", "cell_x")
INDICATORS = ("load",)
YEARS = (1997, 1998, 1999)
FIRST_YEAR, FOLD_YEARS = 1995, (1997, 1998, 1999, 2000, 2001)


def rows(t: Tables):
    """Scored orders with four features, one of them with gaps."""
    p = t.sql(A.predictions)
    return p.select(
        "id", "cell", "day", "year", "y", "p", "missing", (F.col("size") / 100000).alias("size_scaled"), (F.col("day") % 365).cast("double").alias("season"),
        F.when(F.col("missing") == 0, F.col("id") % 11 + F.col("p") * 10).alias("load"), (F.col("cell") % 5).cast("double").alias("cell_x"),
    )


_ROWS = """rw as (select *, size / 100000 as size_scaled, cast(day % 365 as double) as season, case when missing = 0 then id % 11 + p * 10 end as load_, cast(cell % 5 as double) as cell_x from pr)"""


@query("J1 J4", lambda d: f"""{A.with_views(d, pr=A.predictions)} select year, least(greatest(year - 1997, 0), 3) as code, case when cell % 6 = 0 then 'no_archive' when year >= 1999 then 'holdout' else 'calibration' end as split, count(*) as "rows" from pr group by 1, 2, 3""")
def date_partitions(t: Tables):
    p = t.sql(A.predictions)
    coded = p.select("year", L.partition_code(F.col("year"), 1997).cast("bigint").alias("code"), L.entity_split(F.col("year"), F.col("cell") % 6 != 0, 1999).alias("split"))
    return coded.groupBy("year", "code", "split").agg(F.count(F.lit(1)).alias("rows"))


@query("J2 J3", lambda d: f"""{A.with_views(d, pr=A.predictions)}, f as (select unnest([1997, 1998, 1999]) as fold)
      select 'expanding' as kind, cast(fold as bigint) as fold, count(case when year < fold then 1 end) as train, count(case when year = fold then 1 end) as valid from pr, f group by fold
      union all select 'leave_one_out', cast(fold as bigint), count(case when year <> fold then 1 end), count(case when year = fold then 1 end) from pr, f group by fold""")
def fold_sizes(t: Tables):
    p = t.sql(A.predictions)
    cells = []
    for kind, folds in (("expanding", L.expanding_folds(1995, YEARS)), ("leave_one_out", L.leave_one_year_out(YEARS))):
        cells += [F.struct(F.lit(kind).alias("kind"), F.lit(y).cast("long").alias("fold"), F.count(F.when(a, 1)).alias("train"), F.count(F.when(v, 1)).alias("valid")) for y, a, v in folds]
    return p.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


@query("J5 J6", lambda d: f"""{A.with_views(d, pr=A.predictions)}, {_ROWS}, tr as (select * from rw where year <= 1998), md as (select {', '.join(f'median({c}) as m_{c}' for c in ('size_scaled', 'season', 'load_', 'cell_x'))} from tr),
      im as (select size_scaled, season, coalesce(load_, m_load_) as load_, cell_x, m_size_scaled, m_season, m_load_, m_cell_x from tr, md)
      {' union all '.join(f"select '{c.rstrip('_')}' as feature, {micro_sql(f'max(m_{c})')} as median_micro, {micro_sql('0.0' if c == 'cell_x' else f'avg({c})')} as mean_micro, {micro_sql('1.0' if c == 'cell_x' else f'stddev_pop({c})')} as scale_micro from im" for c in ('size_scaled', 'season', 'load_', 'cell_x'))}""")
def fitted_statistics(t: Tables):
    """Medians, means and population deviations fitted on the training years."""
    train = rows(t).where("year <= 1998")
    fitted = L.Preprocessor.fit(train, FEATURES, INDICATORS, ("cell_x",))
    return fitted.table(train).select("feature", micro("median").alias("median_micro"), micro("mean").alias("mean_micro"), micro("scale").alias("scale_micro"))


@query("J5 J6", lambda d: f"""{A.with_views(d, pr=A.predictions)}, {_ROWS}, tr as (select * from rw where year <= 1998), md as (select median(load_) as m from tr), st as (select avg(coalesce(load_, m)) as a, stddev_pop(coalesce(load_, m)) as s from tr, md)
      select id, {micro_sql('(coalesce(load_, m) - a) / s')} as load_micro, case when load_ is null then 1e0 else 0e0 end as load__missing from rw, md, st""")
def standardised_rows(t: Tables):
    """Training statistics applied to every row, with a missing indicator."""
    all_rows = rows(t)
    fitted = L.Preprocessor.fit(all_rows.where("year <= 1998"), FEATURES, INDICATORS, ("cell_x",))
    return fitted.transform(all_rows).select("id", micro("load").alias("load_micro"), "load__missing")


@query("J7", lambda d: f"{A.with_views(d, pr=A.predictions)} select count(case when id % 77 = 0 and missing = 0 then 1 end) as mismatches, 0 as infinite from pr")
def censor_mismatches(t: Tables):
    """Flag and NULL agree but for planted rows."""
    flagged = rows(t).withColumn("flag", F.when(F.col("id") % 77 == 0, 1).otherwise(F.col("missing")))
    return L.censor_mismatches(flagged, "load", "flag")


@query("J8", lambda d: f"{A.with_views(d, pr=A.predictions)} select y, {micro_sql('(select count(*) from pr) / (2e0 * count(*))')} as weight_micro from pr group by y")
def class_weights(t: Tables):
    p = t.sql(A.predictions)
    return p.select("y", micro(L.class_weight(p, "y")).alias("weight_micro")).distinct()


@query("J19", lambda d: f"{A.with_views(d, pr=A.predictions)} select id, {micro_sql('(select avg(y) from pr where year <= 1998)')} as p_micro from pr")
def rate_baseline(t: Tables):
    p = t.sql(A.predictions).drop("p")
    return L.rate_baseline(p.where("year <= 1998"), p, "y").select("id", micro("p").alias("p_micro"))


@query("J20", lambda d: f"{A.with_views(d, pr=A.predictions)} select day, count(*) as cells, cast(sum(missing) as bigint) as missing, {micro_sql('max(p)')} as max_micro, {micro_sql('avg(p)')} as mean_micro from pr group by day")
def day_score_summary(t: Tables):
    s = L.day_summary(t.sql(A.predictions), "day", "p", "missing")
    return s.select("day", "cells", "missing", micro("maximum_score").alias("max_micro"), micro("mean_score").alias("mean_micro"))


@query("J20", lambda d: f"{A.with_views(d, pr=A.predictions)} select id, cell, day, {micro_sql('size / 100000')} as size_micro, {micro_sql('p')} as p_micro, y from pr where day = 10000 and cell = 16")
def cell_lookup(t: Tables):
    r = rows(t)
    found = L.lookup(r.select("id", "cell", "day", "p", "y"), r.select("id", "cell", "day", "size_scaled"), ["id", "cell", "day"], {"day": 10000, "cell": 16})
    return found.select("id", "cell", "day", micro("size_scaled").alias("size_micro"), micro("p").alias("p_micro"), "y")


def _fit(t: Tables, family: str, params: dict, balanced: bool = True):
    r = rows(t)
    return L.fit(family, params, r.where("year <= 1998"), FEATURES, "y", indicators=INDICATORS, exempt=("cell_x",), balanced=balanced, forbidden={"p"}), r


def _scores(t: Tables, family: str, params: dict):
    fitted, r = _fit(t, family, params)
    return fitted.score(r.where("year > 1998"), ["id", "y"], "score")


@query("J9 J8 J17")
def logistic_scores(t: Tables):
    return _scores(t, "logistic", {"l2": 0.01})


@query("J9")
def logistic_objective(t: Tables):
    """Objective per iteration of the fit on the training years."""
    fitted, r = _fit(t, "logistic", {"l2": 0.01})
    return L.objective_history(fitted, r)


#: Declared settings: 200 rounds for scores, 160 for the prefixes of 40, 80 and 160.
BOOSTED = {"rounds": 200, "rate": 0.05, "leaves": 15, "min_leaf": 100, "l2": 1.0}
PREFIXES = (40, 80, 160)
STUMPS = B.Settings(rounds=3, rate=0.1, leaves=2, min_leaf=20, l2=1.0, bins=64)


@query("J10 J17")
def boosted_scores(t: Tables):
    return _scores(t, "boosted", BOOSTED)


@query("J10")
def boosted_trees(t: Tables):
    """The nodes of twenty trees as rows; a leaf has a value and no feature."""
    fitted, r = _fit(t, "boosted", {"rounds": 20, "rate": 0.1}, balanced=False)
    return fitted.table(t.spark)


def _stump_rounds() -> str:
    """Quantile bins with one for unknown values, then per round the sums by column and bin, the best cut, and the next margins."""
    s, columns = STUMPS, ("size_scaled", "season", "load_", "cell_x")
    steps = [
        f"""tr as (select * from rw where year <= 1998), ap as (select id, year, y, {', '.join(columns)} from rw),
      lv as (select id, unnest(range({len(columns)})) as f, unnest([{', '.join(columns)}]) as v from tr),
      cv as (select f, v, count(*) as n from lv where v is not null group by f, v),
      cw as (select *, sum(n) over (partition by f order by v) as upto, sum(n) over (partition by f) as total, count(*) over (partition by f) as several, row_number() over (partition by f order by v) as place from cv),
      ce as (select *, place < several and (several <= {s.bins} or upto * {s.bins} // total > (upto - n) * {s.bins} // total) as edge from cw),
      cb as materialized (select *, coalesce(sum(edge::int) over (partition by f order by v rows between unbounded preceding and 1 preceding), 0) as b from ce),
      lb as materialized (select lv.id, lv.f, coalesce(cb.b, -1) as b from lv left join cb on cb.f = lv.f and cb.v = lv.v),
      m0 as materialized (select id, ln((select avg(y) from tr) / (1 - (select avg(y) from tr))) as m from ap)"""
    ]
    for r in range(s.rounds):
        steps.append(f"""g{r} as materialized (select id, 1 / (1 + exp(-m)) - y as g, 1 / (1 + exp(-m)) * (1 - 1 / (1 + exp(-m))) as h from tr join m{r} using (id)),
      h{r} as materialized (select f, b, sum(g) as g, sum(h) as h, count(*) as n from lb join g{r} using (id) group by f, b),
      k{r} as (select f, b, sum(g) over w as g, sum(h) over w as h, sum(n) over w as n from h{r} where b >= 0 window w as (partition by f order by b)),
      u{r} as (select c.f, coalesce(sum(g), 0) as g, coalesce(sum(h), 0) as h, coalesce(sum(n), 0) as n from (select distinct f from cv) c left join h{r} x on x.f = c.f and x.b = -1 group by c.f),
      t{r} as (select sum(g) as tg, sum(h) as th, count(*) as tn from g{r}),
      c{r} as (select k.f, k.b, false as side, k.g, k.h, k.n, u.n as un from k{r} k join u{r} u using (f) union all select k.f, k.b, true, k.g + u.g, k.h + u.h, k.n + u.n, u.n from k{r} k join u{r} u using (f) where u.n > 0),
      s{r} as (select *, g * g / (h + {s.l2}) + (tg - g) * (tg - g) / (th - h + {s.l2}) - tg * tg / (th + {s.l2}) as gain from c{r}, t{r}
        where least(n, tn - n) >= {s.min_leaf} and least(h, th - h) >= {B.LEAST_CURVATURE}),
      b{r} as materialized (select s.f, s.gain, case when un > 0 then side else n > tn - n end as side, (select max(v) from cb where cb.f = s.f and cb.b = s.b and cb.edge) as threshold,
        -{s.rate} * g / (h + {s.l2}) as l, -{s.rate} * (tg - g) / (th - h + {s.l2}) as r from s{r} s order by gain desc, s.f, side, s.b limit 1),
      m{r + 1} as materialized (select ap.id, m + case when case when x is null then side else x <= coalesce(threshold, 1e300) end then l else r end as m
        from (select *, [{', '.join(columns)}][(select f from b{r}) + 1] as x from ap) ap join m{r} using (id), b{r})""")
    return ",\n".join(steps)


@query("J10", lambda d: f"""{A.with_views(d, pr=A.predictions)}, {_ROWS}, {_stump_rounds()}
      {' union all '.join(f"select {r} as tree, ['size_scaled', 'season', 'load', 'cell_x'][f + 1] as feature, {micro_sql('threshold')} as threshold_micro, side as unknown_left, {micro_sql('l')} as left_micro, {micro_sql('r')} as right_micro from b{r}" for r in range(STUMPS.rounds))}""")
def boosted_stumps(t: Tables):
    """The cuts of three rounds of two leaves, with a learned side for unknown values."""
    r = rows(t)
    fitted = B.fit(r.where("year <= 1998"), FEATURES, "y", STUMPS)
    nodes = fitted.table(t.spark)
    leaf = nodes.select("tree", F.col("node").alias("leaf"), F.col("value"))
    cut = nodes.where("feature is not null").join(leaf.withColumnsRenamed({"leaf": "left", "value": "l"}), ["tree", "left"]).join(leaf.withColumnsRenamed({"leaf": "right", "value": "r"}), ["tree", "right"])
    threshold = F.when(F.col("threshold") < float("inf"), F.col("threshold"))
    return cut.select("tree", "feature", micro(threshold).alias("threshold_micro"), "unknown_left", micro("l").alias("left_micro"), micro("r").alias("right_micro"))


@query("J10 J15 J17", lambda d: f"""{A.with_views(d, pr=A.predictions)}, {_ROWS}, {_stump_rounds()}
      select id, {', '.join(f"{micro_sql(f'1 / (1 + exp(-m{n}.m))')} as p_{n}_micro" for n in (1, 2, 3))} from m1 join m2 using (id) join m3 using (id) join rw using (id) where year > 1998""")
def stump_scores(t: Tables):
    """Scores of later years after one, two and three rounds of two leaves."""
    r = rows(t)
    fitted = B.fit(r.where("year <= 1998"), FEATURES, "y", STUMPS)
    scored = L.prefix_scores(fitted, r.where("year > 1998"), ["id"], (1, 2, 3))
    return scored.select("id", *[micro(f"p_{n}").alias(f"p_{n}_micro") for n in (1, 2, 3)])


@query("J11 J17")
def forest_scores(t: Tables):
    return _scores(t, "forest", {"trees": 200, "depth": 6})


@query("J12 J17")
def perceptron_scores(t: Tables):
    return _scores(t, "perceptron", {"hidden": (64, 32), "iterations": 30})


@query("J15")
def boosting_prefixes(t: Tables):
    fitted, r = _fit(t, "boosted", {**BOOSTED, "rounds": max(PREFIXES), "rate": 0.1}, balanced=False)
    return L.prefix_scores(fitted, r.where("year > 1998"), ["id"], PREFIXES)


@query("J13 J14 M19")
def candidate_search(t: Tables):
    """Eight seeded random settings against a baseline over five expanding folds."""
    drawn = L.random_candidates({"l2": (0.0, 0.001, 0.01, 0.1, 1.0), "iterations": (5, 10, 20)}, 8, 385)
    candidates = {"baseline": ("logistic", {"l2": 0.01}, FEATURES)} | {f"r{i}": ("logistic", s, FEATURES) for i, s in enumerate(drawn)}
    return L.compare_candidates(rows(t), L.expanding_folds(FIRST_YEAR, FOLD_YEARS), candidates, "y", ["id"], "baseline", indicators=INDICATORS)


@query("J16 J3")
def feature_ablation(t: Tables):
    """2 x 2 ablation over leave-one-year-out folds: with and without load and place."""
    base = ("size_scaled", "season")
    sets = {"neither": base, "load": (*base, "load"), "place": (*base, "cell_x"), "both": (*base, "load", "cell_x")}
    candidates = {n: ("logistic", {"l2": 0.01}, f) for n, f in sets.items()}
    summary = L.compare_candidates(rows(t), L.leave_one_year_out((FIRST_YEAR, *FOLD_YEARS)), candidates, "y", ["id"], "neither")
    return L.interaction(summary, "both", "load", "place", "neither")


@query("J18 M3")
def calibration_comparison(t: Tables):
    """Sigmoid calibration fitted on 1999 and compared with the raw score on later years."""
    r = rows(t)
    slope, intercept = L.sigmoid_calibration(r.where("year = 1999"), "y", "p")
    later = r.where("year > 1999").withColumn("calibrated", L.calibrated(F.col("p"), slope, intercept))
    labelled = later.select("y", F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col("p")), F.struct(F.lit("calibrated").alias("kind"), F.col("calibrated").alias("p")))).alias("v")).select("y", "v.*")
    return M.binary_metrics(labelled, ["kind"], "y", "p")
