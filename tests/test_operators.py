"""Operators on small graphs, intervals and versions."""

import pytest
from pyspark.sql import functions as F

from lattica.model.catalog import catalog
from lattica.model.defs import Reference
from lattica.operators import graph, reconcile, referential, search, temporal, versions
from lattica.streaming import ledger


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_closure_of_a_chain_and_of_a_ring(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "child long, parent long")
    assert graph.closure(chain).count() == 40 * 39 // 2
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "child long, parent long")
    assert rows(graph.on_cycles(ring), "node", "cycle_length") == [(1, 3), (2, 3), (3, 3)]
    paths = graph.ancestor_paths(chain.filter("child < 4"), spark.range(4).select(F.col("id").alias("node")))
    assert rows(paths, "node", "path", "depth") == [(0, "0", 0), (1, "0/1", 1), (2, "0/1/2", 2), (3, "0/1/2/3", 3)]


def test_flipping_symmetric_edges_twice_changes_nothing(spark):
    edges = spark.createDataFrame([(1, 2, "includes"), (2, 3, "overlaps"), (3, 4, "uncertain")], "a int, b int, kind string")
    inverse = {"includes": "included_in", "included_in": "includes", "overlaps": "overlaps"}
    once = graph.symmetrized(edges, "a", "b", "kind", inverse)
    assert rows(once, "a", "b", "kind") == rows(graph.symmetrized(once, "a", "b", "kind", inverse), "a", "b", "kind")
    assert (2, 1, "included_in") in rows(once, "a", "b", "kind")


def test_tree_faults(spark):
    nodes = spark.createDataFrame([(1, None), (2, 1), (2, 1), (3, 9), (4, 5), (5, 4)], "id int, up int")
    assert rows(graph.tree_faults(nodes, "id", "up"), "fault", "n") == [("missing_parent", 1), ("not_linked", 3), ("repeated_id", 1)]


def test_deleting_follows_the_cascade_before_it_looks_at_restrictions(spark):
    tables = {
        "core.resource": spark.createDataFrame([("a",), ("b",), ("c",)], "resource_id string"),
        "core.agent": spark.createDataFrame([("a",)], "resource_id string"),
        "core.agent_resource_role": spark.createDataFrame([("r", "a", "b")], "agent_resource_role_id string, agent_id string, resource_id string"),
        "evidence.assertion": spark.createDataFrame([("c", "a")], "resource_id string, asserted_by_agent_id string"),
    }
    names = set(tables)
    references = [r for t in catalog().values() for r in t.references if r.table in names and r.target in names and r.column in tables[r.table].columns]
    keys = {n: catalog()[n].key[0] for n in names}
    gone = tables["core.resource"].filter("resource_id = 'a'").select("resource_id")
    plan = referential.plan(tables, keys, references, "core.resource", gone)
    assert rows(plan.doomed["core.agent"], "key") == [("a",)]
    assert {r.column: rows(d, "key") for r, d in plan.blocked.items() if d.count()} == {"agent_id": [("a",)]}
    assert {r.column: rows(d, "key") for r, d in plan.cleared.items() if d.count()} == {"asserted_by_agent_id": [("c",)]}
    with pytest.raises(ValueError):
        referential.plan(tables, keys, [Reference("core.resource", "resource_id", "core.resource", "C")], "core.resource", gone)


def test_intervals_with_open_ends(spark):
    spans = spark.createDataFrame([(1, 1, None, 5), (1, 2, 5, None), (1, 3, 1, 2), (2, 4, None, None)], "e int, k int, f int, t int")
    assert rows(temporal.overlapping(spans, "e", "k", "f", "t"), "a", "b") == [(1, 2), (1, 3)]
    assert rows(spans.filter(temporal.valid_at(F.col("f"), F.col("t"), F.lit(5))), "k") == [(1,), (2,), (4,)]
    closed = spark.createDataFrame([(1, 1, 3), (1, 2, 9), (1, 9, 10), (1, 12, 13)], "e int, f int, t int")
    assert rows(temporal.islands(closed, "e", "f", "t"), "island_start", "island_end", "n_rows") == [(1, 10, 3), (12, 13, 1)]


def test_islands_keep_intervals_without_a_start_for_last(spark):
    some = spark.createDataFrame([(1, None, None), (1, 1, 3), (1, None, None), (1, 2, 9), (1, 12, 13), (2, None, None), (2, None, None)], "e int, f int, t int")
    assert rows(temporal.islands(some, "e", "f", "t"), "e", "island_start", "island_end", "n_rows") == [(1, 1, 9, 2), (1, 12, 13, 3), (2, None, None, 1), (2, None, None, 1)]


def test_as_of_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "e int, at int")
    right = spark.createDataFrame([(1, 5, 0, "x"), (1, 5, 1, "y"), (1, 6, 2, "z")], "e int, r_at int, k int, v string")
    assert rows(temporal.as_of(left, right, "e", "at", "r_at", "v", "k"), "e", "at", "as_of_v") == [(1, 1, None), (1, 5, "y"), (2, 5, None)]


def test_versions(spark):
    r = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 5, "c")], "k int, n int, s string")
    assert rows(versions.gaps(r, ["k"], "n"), "after_no", "before_no") == [(2, 5)]
    assert rows(versions.latest(r, ["k"], [F.desc_nulls_last("n")]), "s") == [("c",)]
    assert rows(versions.state_at(r, ["k"], "n", F.lit(3), "s", "n"), "k", "s") == [(1, "b")]


def test_outcomes(spark):
    staged = spark.createDataFrame([("a", "1", 0, False), ("a", "2", 1, False), ("b", "1", 0, False), ("c", "1", 0, False), ("d", "1", 0, True)], "k string, h string, o int, bad boolean")
    current = spark.createDataFrame([("b", "1"), ("c", "0"), ("e", "1")], "k string, h string")
    found = reconcile.outcomes(staged, current, "k", "h", F.col("o"), F.col("bad"))
    assert rows(found, "k", "outcome") == [("a", "duplicate"), ("a", "inserted"), ("b", "unchanged"), ("c", "updated"), ("d", "quarantined"), ("e", "skipped")]


def test_points_on_the_edges_of_boxes(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.1, 0.1), (3, 0.11, 0.0), (4, -0.05, 0.05)], "p int, x double, y double")
    boxes = spark.createDataFrame([(1, -0.1, 0.0, 0.1, 0.1)], "b int, west double, south double, east double, north double")
    assert rows(search.points_in_boxes(points, "x", "y", boxes, 0.03), "p") == [(1,), (2,), (4,)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema

    def write(batch, number):
        for _ in range(2):
            batch.dropDuplicates(["k"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    ledger.ledger(ledger.records(spark, str(source), schema), write, str(tmp_path / "state")).awaitTermination()
    assert rows(spark.read.parquet(out), "k", "v") == [(1, "a"), (2, "b")]


def test_whole_texts_meet_by_their_rarest_trigrams(spark):
    """A word that every text has brings no two rows together; what is alike after 60 characters is found, and a repeated row counts once."""
    from lattica.functions.text import trigrams

    words = ["".join(chr(97 + (i * p + j * q) % 26) for j in range(6)) for i in range(40) for p, q in ((3, 7), (5, 11))]
    texts = [(k, " ".join(["common"] + [words[(k * 7 + i * i) % 80] for i in range(4 + k % 9)])) for k in range(60)]
    texts += [(k, " ".join(words[k - 100 + i * 3] for i in range(9)) + " the same long end of both texts, word for word, is further on") for k in (100, 101)] + [texts[5]]
    df = spark.createDataFrame(texts, "k long, s string").cache()
    grams = {r["k"]: set(r["g"]) for r in df.select("k", trigrams(F.col("s")).alias("g")).collect()}
    a, b = df.withColumnRenamed("k", "a"), df.withColumnRenamed("k", "b")
    for least in (0.3, 0.8):
        want = {(x, y): len(grams[x] & grams[y]) / len(grams[x] | grams[y]) for x in grams for y in grams}
        got = [(tuple(r[:2]), round(r[2], 9)) for r in search.similar(a, "a", "s", b, "b", "s", least).collect()]
        assert sorted(got) == sorted((k, round(v, 9)) for k, v in want.items() if v >= least)
    g = df.distinct().select("k", F.lit(0).alias("h"), trigrams(F.col("s")).alias("g"))
    counts = g.select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("rows"))
    assert search.rarest(g, counts, 0.3).filter("t = 'omm'").isEmpty()


def test_paths_of_trees_beside_a_ring(spark):
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (11, 12), (12, 11), (13, 11)], "child long, parent long")
    paths = graph.ancestor_paths(edges, spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5, 13)], "node long"))
    assert rows(paths, "node", "path", "depth") == [(1, "1", 0), (2, "1/2", 1), (3, "1/3", 1), (4, "1/2/4", 2), (5, "5", 0)]
