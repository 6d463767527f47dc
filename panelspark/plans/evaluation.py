"""Ranking, metric and bootstrap queries over scored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.operators import bootstrap as B, metrics as M, nearest as N, ranking as K, spatial as G, steps as T
from panelspark.plans import adapters as A
from panelspark.plans.raster import KEYS, RADIUS, _EDGE, _WEEK, _weekly
from panelspark.plans.registry import Tables, micro, micro_sql, query
from panelspark.session import checkpoint

STEP = ["cell", "day"]


def _w(d):
    return A.with_views(d, pr=A.predictions)


def _metrics_sql(keys: str, p: str = "p", source: str = "pr") -> str:
    k = keys + ", " if keys else ""
    part = f"partition by {keys}" if keys else ""
    group = f"group by {keys}" if keys else ""
    return f"""lv as (select {k}{p} as p, count(*) as n, sum(y) as pos from {source} group by {k}{p}),
      cu as (select *, n - pos as neg, sum(n) over (w order by p desc) as nu, sum(pos) over (w order by p desc) as pu, sum(n) over (w) as nt, sum(pos) over (w) as pt
        from lv window w as ({part})),
      mt as (select {k}max(nt) as n, max(pt) as pos, sum(pos * pu / cast(nu as double)) / nullif(max(pt), 0) as ap,
        sum(pos * ((nt - pt) - (nu - pu) + neg / 2e0)) / nullif(max(pt) * (max(nt) - max(pt)), 0) as auc,
        sum(pos * pow(1 - p, 2) + neg * pow(p, 2)) / max(nt) as brier,
        -sum(pos * ln(greatest(2.220446049250313e-16, p)) + neg * ln(greatest(2.220446049250313e-16, 1 - p))) / max(nt) as ll from cu {group})"""


_OUT = f"""cast(n as bigint) as n_samples, cast(pos as bigint) as n_positive, {micro_sql('pos / cast(n as double)')} as prevalence_micro, {micro_sql('ap')} as ap_micro, {micro_sql('ap / (pos / cast(n as double))')} as ratio_micro,
      {micro_sql('auc')} as auc_micro, {micro_sql('brier')} as brier_micro, {micro_sql('ll')} as log_loss_micro"""


def _shown(m, *keys):
    names = {"prevalence": "prevalence", "average_precision": "ap", "ap_prevalence_ratio": "ratio", "roc_auc": "auc", "brier_score": "brier", "log_loss": "log_loss"}
    return m.select(*keys, "n_samples", "n_positive", *[micro(c).alias(f"{n}_micro") for c, n in names.items()])


@query("M1 M2 M3 L14", lambda d: f"{_w(d)}, {_metrics_sql('')} select {_OUT} from mt")
def binary_metrics(t: Tables):
    return _shown(M.binary_metrics(t.sql(A.predictions), [], "y", "p"))


@query("M4", lambda d: f"""{_w(d)}, st as (select 'all' as stratum, 'all' as value, y, p from pr union all select 'year', cast(year as varchar), y, p from pr union all select 'missing', cast(missing as varchar), y, p from pr),
      {_metrics_sql('stratum, value', source='st')} select stratum, value, {_OUT} from mt""")
def stratified_metrics(t: Tables):
    rows = t.sql(A.predictions)
    return _shown(M.stratified_metrics(rows, "y", "p", {"year": F.col("year"), "missing": F.col("missing")}), "stratum", "value")


@query("M4", lambda d: f"{_w(d)} select count(distinct day) as n_dates from pr")
def distinct_dates(t: Tables):
    return t.sql(A.predictions).agg(F.countDistinct("day").alias("n_dates"))


@query("M5", lambda d: f"""{_w(d)}, b as (select year, least(cast(floor(p * 10) as bigint), 9) as bin, count(*) as n, sum(y) as pos, avg(p) as mp, avg(y) as ob from pr group by 1, 2)
      select s.year, s.bin, coalesce(n, 0) as n_samples, cast(coalesce(pos, 0) as bigint) as n_positive, {micro_sql('mp')} as mean_micro, {micro_sql('ob')} as observed_micro
      from (select distinct year, unnest(generate_series(0, 9)) as bin from pr) s left join b using (year, bin)""")
def reliability_bins(t: Tables):
    r = M.reliability(t.sql(A.predictions), ["year"], "y", "p")
    return r.select("year", "bin", "n_samples", "n_positive", micro("mean_probability").alias("mean_micro"), micro("observed").alias("observed_micro"))


@query("M6", lambda d: f"""{_w(d)}, lv as (select p, count(*) as n, sum(y) as pos from pr group by p),
      b as (select *, least(cast(floor((sum(n) over (order by p) - n / 2e0) / sum(n) over () * 10) as bigint), 9) as cut from lv)
      select dense_rank() over (order by cut) as bin, {micro_sql('min(p)')} as low_micro, {micro_sql('max(p)')} as high_micro, cast(sum(n) as bigint) as n_samples, cast(sum(pos) as bigint) as n_positive,
        {micro_sql('sum(p * n) / sum(n)')} as mean_micro, {micro_sql('sum(pos) / cast(sum(n) as double)')} as observed_micro from b group by cut""")
def quantile_reliability_bins(t: Tables):
    r = M.quantile_reliability(t.sql(A.predictions), [], "y", "p")
    return r.select("bin", micro("min_probability").alias("low_micro"), micro("max_probability").alias("high_micro"), "n_samples", "n_positive",
                    micro("mean_probability").alias("mean_micro"), micro("observed").alias("observed_micro"))


THRESHOLDS = [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def _threshold_sql(values: str) -> str:
    return f"""th(threshold) as ({values}), c as (select threshold, count(*) as n, sum(y) as pos, count(distinct day) as days, count(case when p >= threshold then 1 end) as alerts,
        count(case when p >= threshold and y = 1 then 1 end) as tp from pr, th group by threshold)
      select {micro_sql('threshold')} as threshold_micro, alerts as n_alerts, tp as true_positive, alerts - tp as false_positive, cast(n - pos - (alerts - tp) as bigint) as true_negative, cast(pos - tp as bigint) as false_negative,
        {micro_sql('tp / cast(nullif(alerts, 0) as double)')} as precision_micro, {micro_sql('tp / cast(pos as double)')} as recall_micro, {micro_sql('2e0 * tp / nullif(alerts + pos, 0)')} as f1_micro,
        {micro_sql('(alerts - tp) / cast(n - pos as double)')} as fpr_micro, {micro_sql('1e4 * (alerts - tp) / n')} as per_10000_micro, {micro_sql('alerts / cast(days as double)')} as per_day_micro from c"""


def _thresholds(table):
    names = {"precision": "precision", "recall": "recall", "f1": "f1", "false_positive_rate": "fpr", "false_alerts_per_10000": "per_10000", "alerts_per_day": "per_day", "threshold": "threshold"}
    return table.select("n_alerts", "true_positive", "false_positive", "true_negative", "false_negative", *[micro(c).alias(f"{n}_micro") for c, n in names.items()])


@query("M7 M10", lambda d: f"{_w(d)}, {_threshold_sql('values ' + ', '.join(f'({v!r}::double)' for v in THRESHOLDS))}")
def threshold_tradeoffs(t: Tables):
    return _thresholds(M.threshold_table(t.sql(A.predictions), [], "y", "p", THRESHOLDS, "day"))


@query("M8 M7", lambda d: f"""{_w(d)}, {_threshold_sql("select unnest(quantile_cont(p, [0.5, 0.9, 0.99])) from pr where year = 1999")}""")
def frozen_quantile_thresholds(t: Tables):
    """Thresholds taken from one year's score quantiles, then applied to every row."""
    rows = t.sql(A.predictions)
    chosen = M.score_quantile_thresholds(rows.where("year = 1999"), "p", [0.5, 0.9, 0.99])
    return _thresholds(M.threshold_table(rows, [], "y", "p", chosen, "day"))


def _thin_sql(source: str, columns: str, most: int) -> str:
    return f"""th as (select *, row_number() over (order by o) - 1 as i, count(*) over () as m from {source})
      select {columns} from th where m <= {most} or floor(ceil(i * {most - 1}e0 / (m - 1)) * (m - 1) / {most - 1}) = i"""


@query("M9 H8", lambda d: f"""{_w(d)}, lv as (select p, count(*) as n, sum(y) as pos from pr group by p),
      cu as (select *, sum(n) over (order by p desc) as nu, sum(pos) over (order by p desc) as pu, sum(n) over () as nt, sum(pos) over () as pt, lag(pos) over (order by p) as lower_ from lv),
      kp as (select pu / cast(pt as double) as recall, pu / cast(nu as double) as prec, p as threshold, nt - nu as o from cu where nu = n or nu = nt or pos > 0 or lower_ > 0
        union all select 0, 1, null, max(nt) from cu),
      {_thin_sql('kp', f"{micro_sql('recall')} as recall_micro, {micro_sql('prec')} as precision_micro, {micro_sql('threshold')} as threshold_micro", 101)}""")
def precision_recall_points(t: Tables):
    c = M.pr_curve(t.sql(A.predictions), "y", "p", 101)
    return c.select(micro("recall").alias("recall_micro"), micro("precision").alias("precision_micro"), micro("threshold").alias("threshold_micro"))


@query("M9 H8", lambda d: f"""{_w(d)}, lv as (select p, count(*) as n, sum(y) as pos, count(*) - sum(y) as neg from pr group by p),
      cu as (select *, sum(n) over (order by p desc) as nu, sum(pos) over (order by p desc) as pu, sum(n) over () as nt, sum(pos) over () as pt, lag(pos) over (order by p) as lp, lag(neg) over (order by p) as ln_ from lv),
      kp as (select (nu - pu) / cast(nt - pt as double) as fpr, pu / cast(pt as double) as tpr, nu as o from cu where nu = n or nu = nt or pos <> lp or neg <> ln_ union all select 0, 0, 0),
      {_thin_sql('kp', f"{micro_sql('fpr')} as fpr_micro, {micro_sql('tpr')} as tpr_micro", 101)}""")
def roc_points(t: Tables):
    c = M.roc_curve(t.sql(A.predictions), "y", "p", 101)
    return c.select(micro("false_positive_rate").alias("fpr_micro"), micro("true_positive_rate").alias("tpr_micro"))


@query("G10", lambda d: f"""{_w(d)} select id, day, row_number() over (partition by day order by p desc, id) as "rank", rank() over (partition by day order by p desc) as rank_min,
      rank() over (partition by day order by p desc) + count(*) over (partition by day, p) - 1 as rank_max,
      cast(2 * rank() over (partition by day order by p desc) + count(*) over (partition by day, p) - 1 as bigint) as twice_midrank from pr""")
def daily_ranks(t: Tables):
    r = K.ranks(t.sql(A.predictions).select("id", "day", "p"), ["day"], "p", "id")
    return r.select("id", "day", "rank", "rank_min", "rank_max", (F.col("midrank") * 2).cast("long").alias("twice_midrank"))


@query("H1", lambda d: f"""{_w(d)}, r as (select id, day, row_number() over (partition by day order by p desc, id) as rn, count(*) over (partition by day) as n from pr)
      select id, day from r where rn <= cast(floor((n * 5 + 99) / 100e0) as bigint)""")
def daily_budget_selection(t: Tables):
    r = K.ranks(t.sql(A.predictions).select("id", "day", "p"), ["day"], "p", "id")
    return r.where(F.col("rank") <= K.budget_size(F.col("group_size"), 5)).select("id", "day")


def _cut_sql(day: str = "day") -> str:
    return f"""lv as (select {day} as day, p, count(*) as n, sum(y) as pos from pr group by {day}, p),
      cu as (select *, sum(n) over w as nu, sum(pos) over w as pu, sum(n) over (partition by day) as nt, sum(pos) over (partition by day) as pt from lv window w as (partition by day order by p desc)),
      bu as (select *, cast(floor((nt * pc + 99) / 100e0) as bigint) as k from cu, (values (1), (2), (5), (20)) as b(pc)),
      ct as (select day, pc as percent, k, nt as rows_, pt as n_positive, p as cutoff_score, n as tie_count, k - (nu - n) as slots, pu - pos + greatest(0, k - (nu - n) - (n - pos)) as least_hits,
        pu - pos + least(k - (nu - n), pos) as most_hits, pu - pos + (k - (nu - n)) * pos / cast(n as double) as expected_hits, case when n > k - (nu - n) then 1 else 0 end as ambiguous,
        k * pt / cast(nt as double) as random_hits from bu where nu - n < k and k <= nu)"""


BUDGETS = [1, 2, 5, 20]


@query("H2", lambda d: f"""{_w(d)}, {_cut_sql('year')} select day as year, cast(percent as bigint) as percent, k, cast(rows_ as bigint) as rows_, cast(n_positive as bigint) as n_positive, {micro_sql('cutoff_score')} as cutoff_micro,
      tie_count, cast(slots as bigint) as slots, cast(least_hits as bigint) as least_hits, cast(most_hits as bigint) as most_hits, {micro_sql('expected_hits')} as expected_micro,
      cast(ambiguous as bigint) as ambiguous, {micro_sql('random_hits')} as random_micro from ct""")
def cutoff_tie_bounds(t: Tables):
    c = K.cutoff_ties(t.sql(A.predictions), ["year"], "p", "y", BUDGETS)
    return c.select("year", F.col("percent").cast("long").alias("percent"), "k", F.col("rows").alias("rows_"), "n_positive", micro("cutoff_score").alias("cutoff_micro"), "tie_count", "slots",
                    "least_hits", "most_hits", micro("expected_hits").alias("expected_micro"), "ambiguous", micro("random_hits").alias("random_micro"))


@query("H3 H1 H2", lambda d: f"""{_w(d)}, {_cut_sql()},
      rk as (select *, row_number() over (partition by day order by p desc, id) as rn, count(*) over (partition by day) as n from pr),
      lg as (select *, case when rn <= cast(floor((n * pc + 99) / 100e0) as bigint) then 1 else 0 end as s from rk, (values (1), (2), (5), (20)) as b(pc)),
      ex as (select pe as period, co as coverage, lg.* from lg, unnest([cast(year as varchar), 'pooled']) as a(pe), unnest(['all', case when missing = 0 then 'covered' else 'missing' end]) as c(co)),
      dt as (select pe as period, count(distinct day) as n_dates from pr, unnest([cast(year as varchar), 'pooled']) as a(pe) group by pe),
      ti as (select pe as period, percent, 'all' as coverage, sum(least_hits) as least_hits, sum(most_hits) as most_hits, sum(expected_hits) as expected_hits, sum(random_hits) as random_hits, sum(ambiguous) as ambiguous
        from ct join (select distinct day, year from pr) using (day), unnest([cast(year as varchar), 'pooled']) as a(pe) group by pe, percent),
      ag as (select period, coverage, pc as percent, count(*) as n_samples, sum(y) as n_positive, sum(s) as n_alerts, sum(s * y) as tp, count(distinct day) as days_with_rows from ex group by 1, 2, 3)
      select period, coverage, cast(percent as bigint) as percent, n_samples, cast(n_positive as bigint) as n_positive, cast(n_alerts as bigint) as n_alerts, cast(tp as bigint) as true_positive, days_with_rows, n_dates,
        cast(least_hits as bigint) as least_hits, cast(most_hits as bigint) as most_hits, {micro_sql('expected_hits')} as expected_micro, cast(ambiguous as bigint) as ambiguous,
        {micro_sql('tp / cast(nullif(n_alerts, 0) as double)')} as precision_micro, {micro_sql('tp / cast(nullif(n_positive, 0) as double)')} as recall_micro,
        {micro_sql('1e4 * (n_alerts - tp) / n_samples')} as per_10000_micro, {micro_sql('tp / nullif(random_hits, 0)')} as lift_micro
      from ag join dt using (period) left join ti using (period, percent, coverage)""")
def budget_report(t: Tables):
    r = K.budget_report(t.sql(A.predictions), "day", "year", "p", "id", "y", "missing", BUDGETS)
    return r.select("period", "coverage", F.col("percent").cast("long").alias("percent"), "n_samples", "n_positive", "n_alerts", "true_positive", "days_with_rows", "n_dates", "least_hits", "most_hits",
                    micro("expected_hits").alias("expected_micro"), "ambiguous", micro("precision").alias("precision_micro"), micro("recall").alias("recall_micro"),
                    micro("false_alerts_per_10000").alias("per_10000_micro"), micro("lift_vs_random").alias("lift_micro"))


@query("H4", lambda d: f"""{_w(d)}, r as (select id, cell, year, row_number() over (partition by cell, year order by p desc, id) as rn from pr) select id, cell, year from r where rn <= 3 + cell % 4""")
def top_k_by_group(t: Tables):
    rows = t.sql(A.predictions).select("id", "cell", "year", "p")
    k = rows.select("cell", "year").distinct().withColumn("k", F.lit(3) + F.col("cell") % 4)
    return K.top_k(rows, ["cell", "year"], "p", "id", k).where("selected").select("id", "cell", "year")


_PRIORITY = "(id * 48271 % 2147483647 * 16807) % 2147483647"


@query("H5 H6", lambda d: f"{_w(d)} select id, cell, day from pr order by {_PRIORITY}, id limit 500")
def uniform_sample(t: Tables):
    priority = F.struct(F.expr(_PRIORITY), F.col("id"))
    return K.uniform_sample(t.sql(A.predictions).select("id", "cell", "day"), 500, priority)


@query("H9 I4", lambda d: f"{A.with_views(d, ev=A.ignitions)} select cell, day, count(*) as copies from ev group by cell, day having count(*) > 1")
def repeated_keys(t: Tables):
    return K.strict_order_violations(t.sql(A.ignitions), ["cell", "day"])


@query("M11 M21", lambda d: f"""{_w(d)}, {_metrics_sql('year, cell')}, m1 as (select year, avg(ap) as ap, count(ap) as steps from mt group by year),
      lv2 as (select year, cell, size, count(*) as n, sum(y) as pos from pr group by year, cell, size),
      cu2 as (select *, sum(n) over (partition by year, cell order by size desc) as nu, sum(pos) over (partition by year, cell order by size desc) as pu from lv2),
      m2 as (select year, avg(ap) as ap from (select year, cell, sum(pos * pu / cast(nu as double)) / nullif(sum(pos), 0) as ap from cu2 group by year, cell) group by year)
      select year, {micro_sql('m1.ap')} as model_micro, {micro_sql('m2.ap')} as reference_micro, steps from m1 join m2 using (year)""")
def mean_step_precision(t: Tables):
    """Step AP averaged per year for a model score, next to a reference score column on the same folds."""
    rows = t.sql(A.predictions)
    model = M.mean_step_ap(rows, ["cell"], "y", "p", ["year"])
    other = _reference_ap(rows)
    return model.join(other, "year").select("year", micro("mean_step_ap").alias("model_micro"), micro("reference_ap").alias("reference_micro"), "steps")


def _reference_ap(rows):
    levels = M.score_levels(rows, ["year", "cell"], "y", "size")
    ap = levels.groupBy("year", "cell").agg((F.sum(F.col("pos") * F.col("pos_upto") / F.col("n_upto")) / F.nullif(F.sum("pos"), F.lit(0))).alias("ap"))
    return ap.groupBy("year").agg(F.avg("ap").alias("reference_ap"))


@query("M12", lambda d: f"""{_w(d)}, s as (select cell, year, sum(p) as e, sum(y) as o from pr group by cell, year having sum(y) > 0) select {micro_sql('1.3e0 / median(e / o)')} as scale_micro from s""")
def area_scale(t: Tables):
    return M.area_scale(t.sql(A.predictions), ["cell", "year"], "y", "p").select(micro("area_scale").alias("scale_micro"))


@query("M13", lambda d: f"""{_w(d)}, r as (select *, row_number() over (partition by cell, year order by p desc, id) as rn from pr),
      s as (select cell, year, 10 + cell % 7 as k, sum(y) + 1 as observed from pr group by cell, year)
      select r.cell, r.year, cast(sum(case when rn <= k then y else 0 end) as bigint) as hits, {micro_sql('sum(case when rn <= k then y else 0 end) / cast(max(observed) as double)')} as recall_micro from r join s using (cell, year) group by r.cell, r.year""")
def matched_recall(t: Tables):
    rows = t.sql(A.predictions)
    sizes = rows.groupBy("cell", "year").agg((F.sum("y") + 1).alias("observed")).withColumn("k", F.lit(10) + F.col("cell") % 7)
    return M.matched_recall(rows, ["cell", "year"], "y", "p", "id", sizes).select("cell", "year", "hits", micro("recall").alias("recall_micro"))


@query("C21", lambda d: f"""{_w(d)} select id, {micro_sql('case when p2 > 3e-1 then 2 + p2 - coalesce(case when missing = 0 then p end, 2) / 10 else -size / 1e5 end')} as score_micro from pr""")
def two_tier_scores(t: Tables):
    """Reached share then arrival, else minus distance, over supplied columns."""
    rows = t.sql(A.predictions)
    arrival = F.coalesce(F.when(F.col("missing") == 0, F.col("p")), F.lit(2.0))
    return rows.select("id", micro(F.when(F.col("p2") > 0.3, F.col("p2") + 2.0 - arrival / 10).otherwise(-F.col("size") / 1e5)).alias("score_micro"))


_SETS = """pd as (select distinct cell, year, day from pr where p > 3e-1), ob as (select distinct cell, year, day from pr where p2 > 3e-1),
      bt as (select cell, year, day, count(p) as p, count(o) as o from (select cell, year, day, 1 as p, null as o from pd union all select cell, year, day, null, 1 from ob) group by cell, year, day)"""


@query("I5", lambda d: f"""{_w(d)}, {_SETS} select cell, year, cast(sum(p) as bigint) as predicted, cast(sum(o) as bigint) as observed, cast(sum(p * o) as bigint) as hits, count(*) as "union", {micro_sql('sum(p * o) / cast(count(*) as double)')} as iou_micro,
      {micro_sql('sum(p * o) / cast(nullif(sum(o), 0) as double)')} as recall_micro, {micro_sql('sum(p * o) / cast(nullif(sum(p), 0) as double)')} as precision_micro, {micro_sql('sum(p) / cast(nullif(sum(o), 0) as double)')} as ratio_micro from bt group by cell, year""")
def set_overlap(t: Tables):
    rows = t.sql(A.predictions)
    s = M.set_overlap(rows.where("p > 0.3"), rows.where("p2 > 0.3"), ["cell", "year"], ["day"])
    return s.select("cell", "year", "predicted", "observed", "hits", "union", *[micro(c).alias(f"{n}_micro") for c, n in (("iou", "iou"), ("recall", "recall"), ("precision", "precision"), ("area_ratio", "ratio"))])


def _step_scores(t: Tables):
    """One scored step per cell and day, with NULLs where a step predicts nothing."""
    e = F.col
    return t.sql(A.predictions).select(
        "id", "cell", "year", (e("id") % 3).alias("model"), e("p").alias("recall"), (e("p") / 2).alias("iou"), F.when(e("missing") == 0, e("p2")).alias("precision"), (e("p2") + 0.5).alias("area_ratio"),
        F.when(e("id") % 10 != 0, (e("id") * 7 % 180).cast("double")).alias("direction_error"), F.when(e("id") % 9 != 0, e("p2") / 2).alias("even_recall"),
        F.when(e("missing") == 0, e("p2") * 1000).alias("simulated_distance"), (e("p") * 1000 + 100).alias("observed_distance"),
    )


_STEPS = """ss as (select id, cell, year, id % 3 as model, p as recall, p / 2 as iou, case when missing = 0 then p2 end as prec, p2 + 0.5 as area_ratio, case when id % 10 <> 0 then cast(id * 7 % 180 as double) end as de,
        case when id % 9 <> 0 then p2 / 2 end as er, coalesce(case when missing = 0 then p2 * 1000 end, 0) as sd, p * 1000 + 100 as od from pr)"""


def _summary_sql(keys: str, source: str) -> str:
    return f"""rk as (select *, rank() over (partition by {keys} order by sd) + (count(*) over (partition by {keys}, sd) - 1) / 2e0 as ra, rank() over (partition by {keys} order by od) + (count(*) over (partition by {keys}, od) - 1) / 2e0 as rb from {source})
      select {keys}, count(*) as steps, count(distinct cell) as entities, {micro_sql('avg(recall)')} as mean_recall_micro, {micro_sql('avg(coalesce(er, 0))')} as mean_even_micro, {micro_sql('avg(iou)')} as mean_iou_micro,
        {micro_sql('avg(coalesce(prec, 0))')} as mean_precision_micro, {micro_sql('avg(case when coalesce(de, 999) <= 45 then 1e0 else 0e0 end)')} as within_45_micro, {micro_sql('median(area_ratio)')} as area_micro,
        {micro_sql('median(de)')} as error_micro, {micro_sql('median(sd / od)')} as distance_micro, {micro_sql('corr(ra, rb)')} as rank_micro from rk group by {keys}"""


def _summary(s, *keys):
    names = {"mean_recall": "mean_recall", "mean_even_recall": "mean_even", "mean_iou": "mean_iou", "mean_precision": "mean_precision", "share_within_45": "within_45", "median_area_ratio": "area",
             "median_direction_error": "error", "median_distance_ratio": "distance", "rank_correlation": "rank"}
    return s.select(*keys, "steps", "entities", *[micro(c).alias(f"{n}_micro") for c, n in names.items()])


@query("M15 F23", lambda d: f"{_w(d)}, {_STEPS}, {_summary_sql('model', 'ss')}")
def step_score_summary(t: Tables):
    return _summary(M.step_summary(_step_scores(t), ["model"], "cell"), "model")


@query("M16", lambda d: f"""{_w(d)}, {_STEPS}, sb as (select 'all' as subset, * from ss union all select 'long_runs', * from ss where od >= 400 union all select 'sample', * from ss where cell % 2 = 0), {_summary_sql('subset, model', 'sb')}""")
def model_comparison_report(t: Tables):
    subsets = {"all": F.lit(True), "long_runs": F.col("observed_distance") >= 400, "sample": F.col("cell") % 2 == 0}
    return _summary(M.model_report(_step_scores(t), "model", subsets, "cell"), "subset", "model")


@query("E16", lambda d: f"""{_w(d)}, a as (select cell, day, avg(case when id % 3 = 0 then p end) as m0, avg(case when id % 3 = 1 then p end) as m1 from pr group by cell, day)
      select cell, day, {micro_sql('m1 - m0')} as difference_micro from a where m0 is not null and m1 is not null""")
def paired_model_differences(t: Tables):
    return _pairs(t).select("cell", "day", micro("difference").alias("difference_micro"))


def _pairs(t: Tables):
    rows = t.sql(A.predictions).withColumn("model", F.col("id") % 3)
    wide = rows.groupBy("cell", "day").pivot("model", [0, 1]).agg(F.avg("p"))
    return wide.dropna(subset=["0", "1"]).select("cell", "day", (F.col("1") - F.col("0")).alias("difference"))


def _draw_sql(rep: str, slot: str, size: str, seed: int) -> str:
    once = f"((({rep}) * 1000003 + ({slot}) * 7919 + {seed * 104729}) % 2147483647 * 48271 % 2147483647)"
    return f"((({once} + ({slot}) * 65539) % 2147483647 * 16807 % 2147483647) % ({size}))"


@query("M17 E16", lambda d: f"""{_w(d)}, a as (select cell, day, avg(case when id % 3 = 0 then p end) as m0, avg(case when id % 3 = 1 then p end) as m1 from pr group by cell, day),
      s as (select day, sum(m1 - m0) as s, count(*) as c from a where m0 is not null and m1 is not null group by day),
      i as (select *, row_number() over (order by day) - 1 as i, count(*) over () as f from s),
      dr as (select r, {_draw_sql('r', 'i', 'f', 7)} as i from i, unnest(generate_series(0, 1999)) as g(r)),
      mn as (select r, sum(s) / sum(c) as m from dr join i using (i) group by r)
      select (select {micro_sql('sum(s) / sum(c)')} from s) as mean_micro, {micro_sql('quantile_cont(m, 0.025)')} as low_micro, {micro_sql('quantile_cont(m, 0.975)')} as high_micro, (select cast(sum(c) as bigint) from s) as steps, (select count(*) from s) as clusters from mn""")
def cluster_bootstrap(t: Tables):
    """Whole days resampled, 2,000 replicates."""
    b = B.cluster_bootstrap(_pairs(t), "day", "difference", 2000, 7)
    return b.select(micro("mean").alias("mean_micro"), micro("low").alias("low_micro"), micro("high").alias("high_micro"), "steps", "clusters")


_REPS = f"""u as (select distinct year, day from pr), i as (select *, row_number() over (partition by year order by day) - 1 as i, count(*) over (partition by year) as f from u),
      dr as (select year, r, {_draw_sql('r', 'i', 'f', 3)} as i from i, unnest(generate_series(0, 1999)) as g(r)),
      ml as (select dr.year, r, day, count(*) as times from dr join i using (year, i) group by dr.year, r, day),"""


def _rep_sql(p: str) -> str:
    return f"""l{p} as (select year, r, {p} as p, sum(times) as n, sum(times * y) as pos from pr join ml using (year, day) group by year, r, {p}),
      c{p} as (select *, sum(n) over w as nu, sum(pos) over w as pu from l{p} window w as (partition by year, r order by p desc)),
      a{p} as (select year, r, coalesce(sum(pos * pu / cast(nu as double)) / nullif(sum(pos), 0), 0) as ap from c{p} group by year, r)"""


@query("M18", lambda d: f"""{_w(d)}, {_REPS} {_rep_sql('p')}, {_rep_sql('p2')} select year, r as replicate, {micro_sql('ap.ap')} as a_micro, {micro_sql('ap2.ap')} as b_micro from ap join ap2 using (year, r)""")
def paired_day_bootstrap(t: Tables):
    """Yearly AP of two models on the same resampled days, 2,000 replicates."""
    return _replicates(t).select("year", "replicate", micro("ap_a").alias("a_micro"), micro("ap_b").alias("b_micro"))


def _replicates(t: Tables):
    return B.paired_day_bootstrap(t.sql(A.predictions), "year", "day", "y", {"a": "p", "b": "p2"}, 2000, 3)


@query("M18", lambda d: f"""{_w(d)}, {_REPS} {_rep_sql('p')}, {_rep_sql('p2')}, dl as (select r, avg(ap2.ap) - avg(ap.ap) as d from ap join ap2 using (year, r) group by r)
      select {micro_sql('avg(d)')} as mean_micro, {micro_sql('median(d)')} as median_micro, {micro_sql('stddev_samp(d)')} as error_micro, {micro_sql('quantile_cont(d, 0.025)')} as low_micro, {micro_sql('quantile_cont(d, 0.975)')} as high_micro,
        {micro_sql('avg(case when d > 0 then 1e0 else 0e0 end)')} as better_micro from dl""")
def paired_bootstrap_interval(t: Tables):
    i = B.bootstrap_interval(_replicates(t), "year", "ap_a", "ap_b")
    names = {"mean_delta": "mean", "median_delta": "median", "standard_error": "error", "low": "low", "high": "high", "share_better": "better"}
    return i.select(*[micro(c).alias(f"{n}_micro") for c, n in names.items()])


@query("M19", lambda d: f"""{_w(d)}, lg as (select 'a' as candidate, year, y, p from pr union all select 'b', year, y, p2 from pr), {_metrics_sql('candidate, year', source='lg')},
      j as (select m.candidate, m.ap, b.ap as base from mt m join mt b on b.year = m.year and b.candidate = 'a')
      select candidate, {micro_sql('avg(ap)')} as mean_micro, {micro_sql('avg(ap - base)')} as delta_micro, count(case when ap > base then 1 end) as folds_improved, count(*) as folds, {micro_sql('avg(ap) / avg(base) - 1')} as gain_micro from j group by candidate""")
def fold_summary(t: Tables):
    rows = t.sql(A.predictions)
    long = rows.select("year", "y", F.explode(F.array(F.struct(F.lit("a").alias("candidate"), F.col("p")), F.struct(F.lit("b").alias("candidate"), F.col("p2").alias("p")))).alias("v")).select("year", "y", "v.*")
    s = M.fold_summary(M.binary_metrics(long, ["candidate", "year"], "y", "p"), "candidate", "year", "average_precision", "a")
    return s.select("candidate", micro("mean_metric").alias("mean_micro"), micro("mean_delta").alias("delta_micro"), "folds_improved", "folds", micro("relative_gain").alias("gain_micro"))


def _rank_sql(p: str) -> str:
    return f"rank() over (partition by day order by {p} desc) as {p}_min, rank() over (partition by day order by {p} desc) + count(*) over (partition by day, {p}) - 1 as {p}_max, row_number() over (partition by day order by {p} desc, id) as {p}_rank"


@query("M20 G10", lambda d: f"""{_w(d)}, r as (select *, {_rank_sql('p')}, {_rank_sql('p2')} from pr),
      c as (select missing, 'a' as model, p_min as lo, p_max as hi, p_rank as rk, (p_min + p_max) / 2e0 as mid, (p_min + p_max) / 2e0 as base from r where y = 1
        union all select missing, 'b', p2_min, p2_max, p2_rank, (p2_min + p2_max) / 2e0, (p_min + p_max) / 2e0 from r where y = 1)
      select missing, model, count(*) as n, {micro_sql('avg(mid)')} as mean_micro, {micro_sql('median(mid)')} as median_micro, {micro_sql('avg(base - mid)')} as gain_micro, count(case when base > mid then 1 end) as better,
        count(case when base < mid then 1 end) as worse, count(case when base = mid then 1 end) as tied, count(case when rk <= 2 then 1 end) as captured_2, {micro_sql('sum(greatest(0, least(1, (2 - lo + 1) / cast(hi - lo + 1 as double))))')} as expected_micro from c group by missing, model""")
def cohort_rank_report(t: Tables):
    rows = t.sql(A.predictions).select("id", "day", "y", "p", "p2", "missing")
    for p, m in (("p", "a"), ("p2", "b")):
        rows = K.ranks(rows, ["day"], p, "id").withColumnsRenamed({c: f"{m}_{c}" for c in ("rank", "rank_min", "rank_max", "midrank")}).drop("group_size")
    r = M.cohort_rank_report(checkpoint(rows.where("y = 1")), ["missing"], ["a", "b"], "a", {"2": 2})
    return r.select("missing", "model", "n", micro("mean_midrank").alias("mean_micro"), micro("median_midrank").alias("median_micro"), micro("mean_gain").alias("gain_micro"), "better", "worse", "tied",
                    "captured_2", micro("expected_2").alias("expected_micro"))


@query("H7", lambda d: f"""{_w(d)}, r as (select id, cell, year, row_number() over (partition by cell, year order by p2, id) as rn from pr) select id, cell, year from r where rn <= 5""")
def even_growth_baseline(t: Tables):
    rows = t.sql(A.predictions).select("id", "cell", "year", "p2")
    k = rows.select("cell", "year").distinct().withColumn("k", F.lit(5))
    return T.even_growth(rows, ["cell", "year"], "p2", "id", k).select("id", "cell", "year")


@query("M14 I5 F9 H7", lambda d: f"""{A.with_views(d, det=A.detections)}, {_WEEK}, {_EDGE},
      o as (select i, j from unnest(generate_series(-{RADIUS}, {RADIUS})) as a(i), unnest(generate_series(-{RADIUS}, {RADIUS})) as b(j) where i * i + j * j <= {RADIUS * RADIUS}),
      cd as (select distinct entity, observation, x + i as x, y + j as y from wk, o),
      ca as (select * from cd where not exists (select 1 from wk where wk.entity = cd.entity and wk.observation = cd.observation and wk.x = cd.x and wk.y = cd.y)),
      ds as (select c.entity, c.observation, c.x, c.y, min((c.x - e.x) * (c.x - e.x) + (c.y - e.y) * (c.y - e.y)) as d2 from ca c join edg e using (entity, observation) group by all),
      pd as (select * from ca where (x * 7 + y) % 5 = 0), ob as (select * from ca where (x + y * 3) % 4 = 0),
      nr as (select 'p' as k, c.entity, c.observation, c.x, c.y, b.x as bx, b.y as by_, row_number() over (partition by c.entity, c.observation, c.x, c.y order by (c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y), b.x, b.y) as rn from pd c join wk b using (entity, observation)
        union all select 'o', c.entity, c.observation, c.x, c.y, b.x, b.y, row_number() over (partition by c.entity, c.observation, c.x, c.y order by (c.x - b.x) * (c.x - b.x) + (c.y - b.y) * (c.y - b.y), b.x, b.y) from ob c join wk b using (entity, observation)),
      m as (select k, entity, observation, cast(x - bx as double) as dx, cast(y - by_ as double) as dy, sqrt((x - bx) * (x - bx) + (y - by_) * (y - by_)) * 375 as dist from nr where rn = 1),
      q as (select k, entity, observation, quantile_cont(dist, 0.9) as p90 from m group by k, entity, observation),
      h as (select m.k, m.entity, m.observation, max(p90) as p90, avg(case when dist >= p90 then dx end) as hx, avg(case when dist >= p90 then dy end) as hy from m join q using (k, entity, observation) group by all),
      g as (select *, case when sqrt(hx * hx + hy * hy) >= 1e-9 then degrees(atan2(hx, hy)) end as b from h),
      ev as (select *, row_number() over (partition by entity, observation order by d2, x * 1000 + y) as rn from ds),
      np as (select entity, observation, count(*) as n from pd group by all), no as (select entity, observation, count(*) as n from ob group by all),
      hit as (select entity, observation, count(*) as n from pd join ob using (entity, observation, x, y) group by all),
      eh as (select ev.entity, ev.observation, count(*) as n from ev join np using (entity, observation) join ob using (entity, observation, x, y) where ev.rn <= np.n group by all)
      select np.entity, np.observation, np.n as predicted, no.n as observed, coalesce(hit.n, 0) as hits, {micro_sql('a.p90')} as observed_distance_micro, {micro_sql('b.p90')} as predicted_distance_micro,
        {micro_sql('abs((b.b - a.b + 900) % 360 - 180)')} as error_micro, {micro_sql('coalesce(eh.n, 0) / cast(no.n as double)')} as even_recall_micro
      from np join no using (entity, observation) left join hit using (entity, observation) left join eh using (entity, observation)
        left join g a on a.k = 'o' and a.entity = np.entity and a.observation = np.observation left join g b on b.k = 'p' and b.entity = np.entity and b.observation = np.observation""")
def step_scores(t: Tables):
    """Predicted against observed new cells around each group's weekly burned set."""
    start = checkpoint(_weekly(t))
    active = checkpoint(G.edge_cells(start, KEYS))
    near = N.nearest_cell(N.candidate_cells(start, KEYS, RADIUS), active, KEYS, close=RADIUS)
    cells = checkpoint(near.withColumns({"distance_to_active": F.col("near_d2"), "cell": F.col("x") * 1000 + F.col("y")}))
    predicted = cells.where((F.col("x") * 7 + F.col("y")) % 5 == 0)
    observed = cells.where((F.col("x") + F.col("y") * 3) % 4 == 0)
    s = T.score_steps(predicted, observed, start, cells, KEYS, 375.0)
    return s.select(*KEYS, "predicted", "observed", "hits", micro("observed_distance").alias("observed_distance_micro"), micro("predicted_distance").alias("predicted_distance_micro"),
                    micro("direction_error").alias("error_micro"), micro("even_recall").alias("even_recall_micro"))
