"""Connected components against union-find, and their number of rounds."""

import numpy as np
import pytest

from panelspark.operators import connect


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


def run(spark, n, edges):
    nodes = spark.range(n).withColumnRenamed("id", "node")
    return {r.node: r.label for r in connect.labels(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}


@pytest.mark.parametrize("n, m, seed", [(60, 30, 1), (60, 60, 2), (200, 190, 3)])
def test_random_graphs(spark, n, m, seed):
    draw = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, n, (m, 2))]
    assert run(spark, n, edges) == roots(n, edges)


def test_no_edges_and_no_nodes(spark):
    assert run(spark, 3, []) == {0: 0, 1: 1, 2: 2} and run(spark, 0, []) == {}


def test_rounds_of_a_long_chain_and_a_star(spark, monkeypatch):
    """A chain of 500 nodes in shuffled order, and a hub with 500: rounds grow with the logarithm."""
    rounds, write = [], connect.checkpoint
    monkeypatch.setattr(connect, "checkpoint", lambda df: rounds.append(1) or write(df))
    order = np.random.default_rng(5).permutation(500)
    chain = [(int(a), int(b)) for a, b in zip(order, order[1:])]
    assert set(run(spark, 500, chain).values()) == {0} and len(rounds) <= 2 + 14
    rounds.clear()
    assert set(run(spark, 501, [(500, i) for i in range(500)]).values()) == {0} and len(rounds) <= 2 + 4
