"""Strongly connected components and shares along lineage, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import graph


def components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            more = reach[n].union(*(reach[m] for m in reach[n])) if reach[n] else reach[n]
            changed |= more != reach[n]
            reach[n] = more
    return sorted((n, min(m for m in reach[n] if n in reach[m])) for n in nodes if n in reach[n])


def found(spark, edges):
    return sorted(tuple(r) for r in graph.strong_components(spark.createDataFrame(edges, "child long, parent long")).select("node", "component").collect())


def sparse(seed, nodes, edges):
    r = random.Random(seed)
    return [(r.randrange(nodes), r.randrange(nodes)) for _ in range(edges)] + [(3, 3), (nodes + 5, nodes + 5)]


KNOWN = [
    sparse(1, 40, 48), [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (8, 1), (9, 9)], [(i, (i + 1) % 60) for i in range(60)] + [(5, 200), (200, 201), (201, 5)],
    [(i, i + 1) for i in range(50)], [(1, 2), (2, 1), (2, 3), (3, 4), (4, 2), (10, 11), (11, 12), (12, 10)],
]


@pytest.mark.parametrize("edges", [*KNOWN, sparse(2, 60, 66), sparse(3, 30, 90), sparse(4, 200, 230)])
def test_components_in_one_task(spark, edges):
    assert found(spark, edges) == components(edges)


@pytest.mark.parametrize("edges", KNOWN)
def test_components_by_colours(spark, monkeypatch, edges):
    monkeypatch.setattr(graph, "SMALL", 0)
    assert found(spark, edges) == components(edges)


@pytest.mark.parametrize("small", [0, 4])
def test_loops_on_chains_of_larger_components(spark, monkeypatch, small):
    """Nodes that lead to themselves, at once or over a chain, and lie on a ring too: one row each."""
    monkeypatch.setattr(graph, "SMALL", small)
    edges = [(1, 2), (2, 3), (3, 1), (1, 4), (4, 5), (5, 1), (2, 2), (4, 4), (5, 6), (6, 5), (7, 7), (3, 8), (8, 3), (8, 9), (9, 8)]
    assert found(spark, edges) == components(edges)


def test_a_long_ring_takes_log_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", 0)
    rounds, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda x: rounds.append(1) or real(x))
    n = 1000
    got = graph.strong_components(spark.range(n).select(F.col("id").alias("child"), ((F.col("id") + 1) % n).alias("parent")))
    assert got.count() == n and got.filter("component != 0").isEmpty()
    assert len(rounds) < 40


def test_cycles_where_a_node_has_two_parents(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 1), (3, 9), (9, 8), (8, 7)], "child long, parent long")
    assert sorted(tuple(r) for r in graph.on_cycles(edges).collect()) == [(1, 2), (2, 2), (3, 3)]


def test_shares(spark):
    inputs = [("b", "a", 1.0), ("c", "a", 0.5), ("c", "b", 0.25), ("d", "c", 0.5), ("d", "x", 0.5), ("d", "x", 0.25), ("e", "d", 1.0), (None, "a", 1.0), ("f", None, 1.0)]
    got = graph.shares(spark.createDataFrame(inputs, "sample string, origin string, proportion double"))
    want = [("a", "a", 1.0), ("b", "a", 1.0), ("c", "a", 0.75), ("d", "a", 0.375), ("d", "x", 0.75), ("e", "a", 0.375), ("e", "x", 0.75), ("x", "x", 1.0)]
    assert sorted(tuple(r) for r in got.select("sample", "source", "share").collect()) == want
    with pytest.raises(ValueError):
        graph.shares(spark.createDataFrame([("a", "b", 1.0), ("b", "a", 1.0), ("a", "x", 1.0)], "sample string, origin string, proportion double"))
