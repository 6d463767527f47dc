"""Metrics with hand-worked values, ties, one-class data and bootstrap checks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import bootstrap as B, metrics as M, ranking as K


@pytest.fixture(scope="module")
def scored(spark):
    return spark.createDataFrame([(0, 0.1, 1), (1, 0.9, 1), (0, 0.7, 2), (1, 0.4, 2)], "y int, p double, day int")


def test_small_example(scored):
    m = M.binary_metrics(scored, [], "y", "p").first()
    assert m.average_precision == pytest.approx(5 / 6) and m.roc_auc == 0.75 and m.brier_score == pytest.approx(np.mean([0.01, 0.01, 0.49, 0.36]))
    t = M.threshold_table(scored, [], "y", "p", [0.5], "day").first()
    assert (t.true_positive, t.false_positive, t.true_negative, t.false_negative, t.false_alerts_per_10000, t.alerts_per_day) == (1, 1, 1, 1, 2500.0, 1.0)


def test_ties_and_single_class(spark):
    tied = M.binary_metrics(spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double"), [], "y", "p").first()
    assert (tied.average_precision, tied.roc_auc) == (0.5, 0.5)
    none = M.binary_metrics(spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double"), [], "y", "p").first()
    assert (none.average_precision, none.roc_auc) == (None, None) and none.brier_score == pytest.approx(0.025)


def plain_ap(y, p, w=None):
    w = np.ones(len(y)) if w is None else w
    total = (w * y).sum()
    return sum((w * y)[p == s].sum() * (w * y)[p >= s].sum() / w[p >= s].sum() for s in np.unique(p) if w[p >= s].sum()) / total if total else 0.0


def test_average_precision_against_plain_formula(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 400), rng.integers(0, 50, 400) / 50
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, p double")
    m = M.binary_metrics(df, [], "y", "p").first()
    assert m.average_precision == pytest.approx(plain_ap(y, p))
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert m.roc_auc == pytest.approx(np.mean(pairs))


def test_reliability_keeps_empty_bins_and_last_edge(spark):
    r = {x.bin: x for x in M.reliability(spark.createDataFrame([(1, 1.0), (0, 0.05)], "y int, p double"), [], "y", "p").collect()}
    assert len(r) == 10 and (r[9].n_samples, r[0].n_samples, r[5].n_samples, r[5].observed) == (1, 1, 0, None)


def test_quantile_bins_keep_ties_together(spark):
    rows = [(0, 0.0)] * 70 + [(1, i / 100) for i in range(1, 31)]
    r = M.quantile_reliability(spark.createDataFrame(rows, "y int, p double"), [], "y", "p").collect()
    assert sum(x.n_samples for x in r) == 100 and max(x.n_samples for x in r) == 70


def test_step_scores_and_matched_recall(spark):
    rows = spark.createDataFrame([("a", 0, 0.1), ("b", 1, 0.9), ("b", 0, 0.2)], "step string, y int, p double")
    m = M.mean_step_ap(rows, ["step"], "y", "p").first()
    assert (m.mean_step_ap, m.steps) == (1.0, 1)
    cells = spark.createDataFrame([("s", c, y, p) for c, (y, p) in enumerate([(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.1), (1, 0.3), (0, 0.0)])], "step string, cell int, y int, p double")
    sizes = spark.createDataFrame([("s", 2, 4)], "step string, k int, observed int")
    assert M.matched_recall(cells, ["step"], "y", "p", "cell", sizes).first().recall == 0.25


def test_top_k_breaks_ties_by_key(spark):
    df = spark.createDataFrame([("s", 1, 0.1), ("s", 2, 0.9), ("s", 4, 0.5), ("s", 5, 0.5), ("s", 6, 0.5)], "g string, cell int, p double")
    got = K.top_k(df, ["g"], "p", "cell", spark.createDataFrame([("s", 3)], "g string, k int")).where("selected")
    assert sorted(r.cell for r in got.collect()) == [2, 4, 5]


def test_tie_bounds_hold_the_selection(spark):
    rows = [(d, i, (i * 7 + d) % 5 / 5, int(i % 4 == 0)) for d in range(6) for i in range(40)]
    df = spark.createDataFrame(rows, "day int, id int, p double, y int")
    picked = K.ranks(df, ["day"], "p", "id").where(F.col("rank") <= K.budget_size(F.col("group_size"), 20)).groupBy("day").agg(F.sum("y").alias("hits"))
    for r in K.cutoff_ties(df, ["day"], "p", "y", [20]).join(picked, "day").collect():
        assert r.k == 8 and r.least_hits <= r.hits <= r.most_hits and r.least_hits <= r.expected_hits <= r.most_hits


def test_set_overlap(spark):
    a = spark.createDataFrame([("s", 1), ("s", 2), ("s", 3), ("t", 1)], "k string, x int")
    b = spark.createDataFrame([("s", 2), ("s", 9)], "k string, x int")
    s = {r.k: r for r in M.set_overlap(a, b, ["k"], ["x"]).collect()}
    assert (s["s"].iou, s["s"].recall, s["s"].precision, s["s"].area_ratio) == (0.25, 0.5, pytest.approx(1 / 3), 1.5)
    assert (s["t"].recall, s["t"].precision) == (None, 0.0)


def test_cluster_bootstrap_mean_and_interval(spark):
    rows = [(fire, step, 0.1 + 0.01 * (fire % 3)) for fire in range(12) for step in range(3)]
    b = B.cluster_bootstrap(spark.createDataFrame(rows, "fire int, step int, d double"), "fire", "d", 500, 1).first()
    assert b["mean"] == pytest.approx(0.11) and b.low < 0.11 < b.high and 0.1 <= b.low and b.high <= 0.12 and (b.steps, b.clusters) == (36, 12)


def test_day_bootstrap_equals_weighted_ap(spark):
    rng = np.random.default_rng(3)
    rows = [(0, int(d), int(y), float(p)) for d, y, p in zip(rng.integers(0, 9, 500), rng.random(500) < 0.08, rng.integers(0, 60, 500) / 60)]
    df = spark.createDataFrame(rows, "g int, day int, y int, p double")
    times = B.multiplicities(df, ["g"], "day", 12, 5)
    drawn = times.toPandas()
    assert drawn.groupby("replicate").times.sum().eq(9).all() and drawn.replicate.nunique() == 12
    got = B.replicate_ap(df, "g", "day", "y", "p", 12, 5).toPandas().set_index("replicate").ap
    day, y, p = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    for replicate, part in drawn.groupby("replicate"):
        weights = part.set_index("day").times.reindex(range(9), fill_value=0)
        assert got[replicate] == pytest.approx(plain_ap(y, p, weights.to_numpy()[day]))


def test_curves_end_where_they_should(spark):
    rng = np.random.default_rng(8)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 80, 300) / 80
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, p double")
    pr = M.pr_curve(df, "y", "p", 50).toPandas().sort_values("recall")
    roc = M.roc_curve(df, "y", "p", 50).toPandas().sort_values(["false_positive_rate", "true_positive_rate"])
    assert len(pr) <= 50 and (pr.recall.iloc[0], pr.precision.iloc[0], pr.recall.iloc[-1]) == (0.0, 1.0, 1.0)
    assert tuple(roc.iloc[0][:2]) == (0.0, 0.0) and tuple(roc.iloc[-1][:2]) == (1.0, 1.0) and np.isinf(roc.threshold).sum() == 1


def test_replicates_in_pieces(spark, monkeypatch):
    """Cut along the thresholds into pieces of a few, and rows into small steps: the same replicates."""
    rng = random.Random(9)
    rows = [(g, d, int(rng.random() < 0.2), round(rng.random(), 2)) for g in (1, 2) for d in range(12) for _ in range(20)] + [(3, 0, 0, 0.5)]
    df = spark.createDataFrame(rows, "g int, d int, y int, p double")
    whole = {(r.g, r.replicate): r.ap for r in B.replicate_ap(df, "g", "d", "y", "p", 30, 5).collect()}
    monkeypatch.setattr(B, "SLOTS", 3)
    monkeypatch.setattr(B, "ROWS", 7)
    monkeypatch.setattr(B, "BLOCK", 11)
    pieces = {(r.g, r.replicate): r.ap for r in B.replicate_ap(df, "g", "d", "y", "p", 30, 5).collect()}
    assert pieces.keys() == whole.keys() and len(whole) == 90
    assert all(pieces[k] == pytest.approx(whole[k], abs=1e-12) for k in whole) and whole[3, 0] == 0
    # Against the definition, for one replicate.
    days = [B.drawn_slots(4, np.arange(12), 5, 12).tolist().count(d) for d in range(12)]
    drawn = [(p, y) for g, d, y, p in rows if g == 1 for _ in range(days[d])]
    found, total = 0.0, sum(y for _, y in drawn)
    for t in {p for p, _ in drawn}:
        above = [y for p, y in drawn if p >= t]
        found += sum(y for p, y in drawn if p == t) * sum(above) / len(above)
    assert whole[1, 4] == pytest.approx(found / total, abs=1e-12)
