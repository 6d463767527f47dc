"""Histogram boosting against plain recomputations."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.contracts import ContractError
from panelspark.operators import boosting as B


def table(spark, n=3000, seed=1):
    """Label from a step in `a`, an interaction and whether `b` is known; `c` is noise, `d` constant."""
    draw = np.random.default_rng(seed)
    a, c = draw.normal(size=n), draw.normal(size=n)
    b = np.where(draw.random(n) < 0.3, np.nan, draw.integers(0, 6, n))
    lift = 2.0 * (a > 0.5) + 2.5 * np.isnan(b) + 1.5 * ((a < 0) & (b >= 3)) - 2.5
    y = (draw.random(n) < 1 / (1 + np.exp(-lift))).astype(int)
    rows = [(i, int(y[i]), float(a[i]), None if np.isnan(b[i]) else float(b[i]), float(c[i]), 1.0) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, y int, a double, b double, c double, d double")


FEATURES = ["a", "b", "c", "d"]


def plain_fit(rows, settings, rounds):
    """Best-first boosting by exhaustive search over raw values (every distinct value is an edge)."""
    x = np.array([[np.nan if v is None else v for v in r[2:]] for r in rows], dtype=float)
    y = np.array([r[1] for r in rows], dtype=float)
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))

    def score(g, h):
        return g * g / (h + settings.l2)

    def best(own, g, h):
        found = (0.0, None)
        for f in range(x.shape[1]):
            values = x[own, f]
            unknown = np.isnan(values)
            for edge in [*np.unique(values[~unknown])[:-1], math.inf]:
                for side in (False, True) if unknown.any() else (False,):
                    left = np.where(unknown, side, values <= edge)
                    n = left.sum()
                    if min(n, len(own) - n) < settings.min_leaf:
                        continue
                    a, b = own[left], own[~left]
                    gain = score(g[a].sum(), h[a].sum()) + score(g[b].sum(), h[b].sum()) - score(g[own].sum(), h[own].sum())
                    if gain > found[0] + 1e-9:
                        found = (gain, (f, edge, side, a, b))
        return found

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        leaves = [(np.arange(len(y)), *best(np.arange(len(y)), g, h))]
        while len(leaves) < settings.leaves:
            at = max(range(len(leaves)), key=lambda i: leaves[i][1])
            if leaves[at][2] is None:
                break
            _, _, (f, edge, side, a, b) = leaves.pop(at)
            leaves += [(a, *best(a, g, h)), (b, *best(b, g, h))]
        for own, _, _ in leaves:
            margin[own] -= settings.rate * g[own].sum() / (h[own].sum() + settings.l2)
    return margin


def test_equal_to_an_exhaustive_search(spark):
    rows, df = table(spark, 400)
    rows = [(*r[:2], round(r[2], 1), r[3], round(r[4], 1), r[5]) for r in rows]  # fewer values than bins: bins cut nothing away
    df = spark.createDataFrame(rows, df.schema).repartition(3)
    settings = B.Settings(rounds=3, rate=0.3, leaves=6, min_leaf=15)
    model = B.fit(df, FEATURES, "y", settings)
    got = {r.id: r.m_3 for r in model.margins(df, ["id"], [3]).collect()}
    want = plain_fit(rows, settings, 3)
    assert np.allclose([got[r[0]] for r in rows], want, atol=1e-9)


@pytest.fixture(scope="module")
def fitted(spark):
    rows, df = table(spark)
    return rows, df, B.fit(df, FEATURES, "y", B.Settings(rounds=25, rate=0.2, leaves=8, min_leaf=40, bins=32))


def test_trees_as_rows_walked_by_sql(spark, fitted):
    """The model table alone gives the scores: DuckDB walks every row down every tree."""
    rows, df, model = fitted
    con = duckdb.connect()
    nodes, data = model.table(spark).toPandas(), df.toPandas()
    con.register("nodes", nodes)
    con.register("data", data)
    walked = con.sql(f"""
        with recursive v as (select id, unnest(['a', 'b', 'c', 'd']) as feature, unnest([a, b, c, d]) as value from data),
        w as (select d.id, n.tree, n.node, n.feature, n.threshold, n.unknown_left, n.left, n.right, n.value as leaf from data d, nodes n where n.node = 0
          union all select w.id, w.tree, n.node, n.feature, n.threshold, n.unknown_left, n.left, n.right, n.value
          from w join v on v.id = w.id and v.feature = w.feature
          join nodes n on n.tree = w.tree and n.node = case when v.value is null or isnan(v.value) then case when w.unknown_left then w.left else w.right end when v.value <= w.threshold then w.left else w.right end)
        select id, {model.start!r} + sum(leaf) filter (where tree < 10) as m_10, {model.start!r} + sum(leaf) as m_25 from w where leaf is not null group by id""").fetchall()
    want = {i: (a, b) for i, a, b in walked}
    got = {r.id: (r.m_10, r.m_25) for r in model.margins(df, ["id"], [10, 25]).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-9) for i in got)
    scores = {r.id: r.p for r in model.score(df, ["id"]).collect()}
    assert all(scores[i] == pytest.approx(1 / (1 + math.exp(-got[i][1])), abs=1e-12) for i in got)


def test_unknown_values_have_a_learned_side(fitted):
    """`b` raises the odds where it is unknown; the model must tell that from every known value."""
    rows, df, model = fitted
    scored = model.score(df.withColumn("known", F.col("b").isNotNull()), ["known", "y"]).groupBy("known").agg(F.avg("p").alias("p"), F.avg("y").alias("y")).collect()
    assert all(abs(r.p - r.y) < 0.02 for r in scored) and abs(scored[0].y - scored[1].y) > 0.2
    assert any(math.isinf(t) for tree in model.trees for t in tree.threshold) or any(tree.unknown_left.any() for tree in model.trees)


def test_nan_is_unknown_and_keys_pass_through(spark, fitted):
    _, df, model = fitted
    nan = df.withColumn("b", F.coalesce("b", F.lit(float("nan"))))
    assert [r.p for r in model.score(nan, ["id"]).orderBy("id").collect()] == [r.p for r in model.score(df, ["id"]).orderBy("id").collect()]
    kept = model.score(df.withColumn("tag", F.lit("x")), ["tag", "a", "id"], "score").where("id = 3").first()
    assert kept.tag == "x" and kept.a == df.where("id = 3").first().a
    assert model.score(df.limit(0), ["id"]).isEmpty()


@pytest.mark.parametrize("local", [0, 400, 10_000])
def test_same_model_however_the_rows_are_dealt(spark, fitted, monkeypatch, local):
    rows, df, _ = fitted
    settings = B.Settings(rounds=12, leaves=5, min_leaf=40, bins=16)
    one = B.fit(df, FEATURES, "y", settings)
    monkeypatch.setattr(B, "PARTITION", 700)
    monkeypatch.setattr(B, "BLOCK", 100)
    monkeypatch.setattr(B, "ROUNDS", 5)
    monkeypatch.setattr(B, "LOCAL", local)
    two = B.fit(df.repartition(5), FEATURES, "y", settings)
    for s, t in zip(one.trees, two.trees):
        assert (s.feature == t.feature).all() and (s.bin == t.bin).all() and np.allclose(s.value, t.value, atol=1e-9)


def test_weights_count_as_repeated_rows(spark):
    rows, df = table(spark, 600)
    settings = B.Settings(rounds=3, leaves=4, min_leaf=1, bins=255)
    twice = df.withColumn("n", F.expr("explode(array_repeat(1, if(y = 1, 2, 1)))"))
    light = B.fit(df, ["b"], "y", settings, F.when(F.col("y") == 1, 2.0).otherwise(1.0))
    heavy = B.fit(twice, ["b"], "y", settings)
    assert np.allclose([r.m_3 for r in light.margins(df, ["id"], [3]).orderBy("id").collect()], [r.m_3 for r in heavy.margins(df, ["id"], [3]).orderBy("id").collect()])


def test_bin_edges(spark):
    values = [float(v) for v in range(1000)] + [5000.0] * 1000
    edges = B.bin_edges(spark.createDataFrame([(v, None if v > 3 else v) for v in values], "a double, b double"), ["a", "b"], 10)
    assert edges[0].tolist() == [199.0, 399.0, 599.0, 799.0, 999.0] and edges[1].tolist() == [0.0, 1.0, 2.0]
    assert [len(e) for e in B.bin_edges(spark.createDataFrame([], "a double"), ["a"], 10)] == [0]


def test_refusals(spark):
    _, df = table(spark, 50)
    for bad in (df.where("y = 1"), df.withColumn("y", F.lit(2)), df.limit(0), df.withColumn("y", F.lit(None).cast("int"))):
        with pytest.raises(ContractError):
            B.fit(bad, FEATURES, "y", B.Settings(rounds=1))
    with pytest.raises(ContractError):
        B.Settings(bins=400)
    model = B.fit(df, ["d"], "y", B.Settings(rounds=2, min_leaf=5))
    assert len(model.trees) == 2 and all(len(t.left) == 1 for t in model.trees)  # nothing to split: the rate alone
    with pytest.raises(ContractError):
        model.margins(df, ["id"], [3])


def test_leaves_found_through_sets_are_those_of_the_walk():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 256, (3, 500)).astype(np.uint8)
    for leaves in (1, 2, 15, 16, 40):
        split, names = {}, [""]
        while len(split) < leaves - 1:
            name = names.pop(int(rng.integers(len(names))))
            split[name] = (1.0, int(rng.integers(3)), int(rng.integers(255)), bool(rng.integers(2)), (1.0, 1.0, 1.0), (2.0, 2.0, 2.0))
            names += [name + "l", name + "r"]
        tree, _ = B._assembled(split, [np.arange(254.0)] * 3, B.Settings(), (1.0, 1.0, 1.0))
        numbers = np.arange(len(tree.left))
        assert B.leaf_finder(tree, bins)(numbers).tolist() == tree.leaves(500, B._binned(bins)).tolist()


def test_guessed_cuts_change_nothing_but_the_number_of_looks(spark, monkeypatch):
    """Nodes below remembered cuts hold only where the cuts are the same; a wrong memory gives the same tree."""
    _, df = table(spark, 2000)
    settings = B.Settings(rounds=6, rate=0.05, leaves=6, min_leaf=40, bins=32)
    monkeypatch.setattr(B, "LOCAL", 0)
    looks, cuts, grow = [], B.cuts, B.grow
    monkeypatch.setattr(B, "cuts", lambda *a: looks.append(1) or cuts(*a))
    guessed = B.fit(df, FEATURES, "y", settings)
    with_guess = len(looks)
    monkeypatch.setattr(B, "grow", lambda look, edges, settings, rows, memory: grow(look, edges, settings, rows))
    plain = B.fit(df, FEATURES, "y", settings)
    without = len(looks) - with_guess
    wrong = {"": (9.0, 3, 0, False), "l": (8.0, 2, 5, True), "ll": (7.0, 0, 1, False), "r": (6.0, 1, 2, True)}
    monkeypatch.setattr(B, "grow", lambda look, edges, settings, rows, memory: grow(look, edges, settings, rows, dict(wrong)))
    misled = B.fit(df, FEATURES, "y", settings)
    assert with_guess < without
    for other in (plain, misled):
        for s, t in zip(guessed.trees, other.trees):
            assert (s.feature == t.feature).all() and (s.bin == t.bin).all() and np.allclose(s.value, t.value, atol=1e-9)


def test_weights_of_rows_and_of_classes(spark, monkeypatch):
    """Blocks keep two weights where they follow from the class, else one a row; blocks of two rows too."""
    rows, df = table(spark, 300)
    by_row = F.when(F.col("id") % 3 == 0, 2.0).otherwise(1.0)
    for block in (300, 3, 2):
        monkeypatch.setattr(B, "BLOCK", block)
        packed = B.pack(df, ["a"], F.col("y").cast("double"), by_row, [np.array([0.0])], 0.0, 300).toArrow()
        found = [(int(k), float(w)) for n, _, y, weight, _ in B._unpacked(iter(packed.to_batches())) for k, w in zip(y, weight[y] if len(weight) == 2 else weight[2:])]
        assert sorted(found) == sorted((r[1], 2.0 if r[0] % 3 == 0 else 1.0) for r in rows)
