"""Ordered-group operators against pandas, with one key holding most of the rows and the many-task path forced."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import ordered as O, ranking as K


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(5)
    n = 3000
    return pd.DataFrame({"k": np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n)), "id": np.arange(n), "t": rng.permutation(n), "v": rng.integers(0, 9, n), "s": rng.integers(0, 40, n) / 40})


def test_running_sums(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = O.running(df, ["k"], "t", {"r": "v"}, totals=True).toPandas().sort_values("id").reset_index(drop=True)
    ordered = skewed.sort_values("t")
    want = ordered.assign(r=ordered.groupby("k").v.cumsum()).sort_values("id")
    assert got.r.tolist() == want.r.tolist()
    assert got.r_total.tolist() == skewed.groupby("k").v.transform("sum").tolist()


def test_descending_global(spark, skewed):
    got = O.running(spark.createDataFrame(skewed), [], "t", {"r": "v"}, descending=True).toPandas().sort_values("t", ascending=False)
    assert got.r.tolist() == got.v.cumsum().tolist()


@pytest.mark.parametrize("following", [False, True])
def test_neighbour(spark, skewed, following):
    got = O.neighbour(spark.createDataFrame(skewed), ["k"], "t", {"n": "id"}, following=following).toPandas().sort_values("id")
    ordered = skewed.sort_values("t")
    want = ordered.assign(n=ordered.groupby("k").id.shift(-1 if following else 1)).sort_values("id")
    assert np.array_equal(got.n.to_numpy(dtype=float), want.n.to_numpy(), equal_nan=True)


def test_backward_dates_order_tied_rows_alike_inside_pieces_and_across_cuts(spark):
    from panelspark.operators.stations import backward_dates

    rng = np.random.default_rng(7)
    rows = pd.DataFrame({"seq": np.repeat(np.arange(400), 5), "day": rng.integers(0, 50, 2000)})
    got = backward_dates(spark.createDataFrame(rows).repartition(7), "seq", "day").toPandas()
    ordered = rows.sort_values(["seq", "day"])
    want = ordered.assign(previous_day=ordered.day.shift()).dropna()
    want = want[want.day < want.previous_day]
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.astype("int64").to_numpy().tolist()))


def test_quantiles(spark, skewed):
    got = O.quantiles(spark.createDataFrame(skewed), ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.9}).toPandas().set_index("k")
    for key, group in skewed.groupby("k"):
        assert got.loc[key].tolist() == pytest.approx(np.quantile(group.v, [0.1, 0.5, 0.9]).tolist())


def test_average_ranks(spark, skewed):
    got = O.average_ranks(spark.createDataFrame(skewed), [], "s", "r").toPandas().set_index("s").r
    assert skewed.s.map(got).tolist() == skewed.s.rank().tolist()


def test_ranks_and_ties(spark, skewed):
    got = K.ranks(spark.createDataFrame(skewed), ["k"], "s", "id").toPandas().sort_values("id")
    ordered = skewed.sort_values(["s", "id"], ascending=[False, True])
    assert got["rank"].tolist() == ordered.assign(r=ordered.groupby("k").cumcount() + 1).sort_values("id").r.tolist()
    by = skewed.groupby("k").s
    assert got.rank_min.tolist() == by.rank(method="min", ascending=False).tolist()
    assert got.rank_max.tolist() == by.rank(method="max", ascending=False).tolist()
    assert got.midrank.tolist() == by.rank(ascending=False).tolist()


def test_null_keys_are_kept(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 3, 1)], "k string, t int, v int")
    assert sorted(r.r for r in O.running(df, ["k"], "t", {"r": "v"}).collect()) == [1, 5, 12]


def test_thinning_keeps_ends(spark):
    points = spark.range(1000).select(F.col("id").alias("o"))
    kept = sorted(r.o for r in K.thin(points, "o", 11).collect())
    assert kept == np.unique(np.linspace(0, 999, 11, dtype=int)).tolist()


def test_sample_is_fixed_size_and_repeatable(spark):
    df = spark.range(5000)
    a = {r.id for r in K.uniform_sample(df, 50, K.seeded_priority("id", seed=1)).collect()}
    assert len(a) == 50 and a == {r.id for r in K.uniform_sample(df.repartition(7), 50, K.seeded_priority("id", seed=1)).collect()}


@pytest.mark.parametrize("whole", [10, 1 << 18])
def test_groups_are_cut_only_where_one_is_large(spark, skewed, monkeypatch, whole):
    calls, real = [], O.cut_points
    monkeypatch.setattr(O, "cut_points", lambda *a, **o: calls.append(a) or real(*a, **o))
    monkeypatch.setattr(O, "WHOLE", whole)
    df, ordered = spark.createDataFrame(skewed), skewed.sort_values("t")
    got = O.running(df, ["k"], "t", {"r": "v"}, totals=True).toPandas().set_index("id").sort_index()
    assert got.r.tolist() == ordered.assign(r=ordered.groupby("k").v.cumsum()).sort_values("id").r.tolist()
    assert got.r_total.tolist() == skewed.groupby("k").v.transform("sum").tolist()
    near = O.neighbour(df, ["k"], "t", {"n": "id"}).toPandas().set_index("id").sort_index().n
    assert np.array_equal(near.to_numpy(dtype=float), ordered.assign(n=ordered.groupby("k").id.shift()).sort_values("id").n.to_numpy(), equal_nan=True)
    cut = O.quantiles(df, ["k"], "v", {"a": 0.3}).toPandas().set_index("k").a
    assert cut.to_dict() == pytest.approx(skewed.groupby("k").v.quantile(0.3).to_dict())
    assert bool(calls) == (whole == 10)


def test_peers_share_the_sum_of_the_last_of_them(spark, monkeypatch):
    df = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 4), ("b", 1, 8)], "k string, t int, v int")
    for whole in (1, 10):
        monkeypatch.setattr(O, "WHOLE", whole)
        got = O.running(df, ["k"], "t", {"r": "v"}, peers=True).collect()
        assert sorted((r.k, r.t, r.r) for r in got) == [("a", 1, 3), ("a", 1, 3), ("a", 2, 7), ("b", 1, 8)]
