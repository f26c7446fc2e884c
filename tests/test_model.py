"""Declared defaults, geometry, trees and intervals, and the entry without what it may lack."""

import struct
import subprocess
import sys

from pyspark.sql import functions as F

from lattica.functions import geo
from lattica.model.catalog import catalog
from lattica.operators import graph, temporal
from lattica.rules import advisory, runner


def test_defaults_are_declared(spark):
    assert sum(c.default is not None for t in catalog().values() for c in t.columns) == 36
    now = F.lit("2026-01-02 03:04:05").cast("timestamp")
    row = runner.filled(spark.range(1), runner.defaults_of(catalog()["core.resource"], now)).first()
    assert (row["row_version"], row["validation_status"], row["currency_status"], str(row["created_at"])) == (1, "unreviewed", "current", "2026-01-02 03:04:05")
    assert "first_seen_at" not in runner.defaults_of(catalog()["field.individual"])


def test_points_and_boxes_of_binary_geometry(spark):
    def line(order, kind, points, srid=None, ring=False):
        head = struct.pack(order + "I", kind | (0x20000000 if srid else 0)) + (struct.pack(order + "I", srid) if srid else b"")
        n = (struct.pack(order + "I", 1) if ring else b"") + (struct.pack(order + "I", len(points)) if kind % 1000 > 1 else b"")
        return bytes([order == "<"]) + head + n + b"".join(struct.pack(order + "d" * len(p), *p) for p in points)

    far = [(-99.5, 19.25), (1e-300, -0.0), (103.0000001, -7.5)]
    cases = [line(o, k, p, s, r) for o in "<>" for s in (None, 4326) for k, p, r in ((1, far[:1], False), (2, far, False), (3, far, True))]
    cases += [line("<", 1001, [(1.5, 2.5, 9.0)]), line("<", 7, far), None]
    got = spark.createDataFrame([(i, bytearray(c) if c else None) for i, c in enumerate(cases)], "i int, g binary").select("i", geo.wkb_points(F.col("g")).alias("p"), geo.wkb_box(F.col("g")).alias("b")).orderBy("i").collect()
    want = [far[:1], far, far] * 4 + [[(1.5, 2.5)], None, None]
    assert [[tuple(p) for p in r["p"]] if r["p"] else None for r in got] == want
    assert tuple(got[1]["b"]) == (-99.5, -7.5, 103.0000001, 19.25) and tuple(got[-1]["b"]) == (None,) * 4


def test_descendants_roots_and_cycles(spark):
    edges = [(2, 1), (3, 2), (4, 2), (9, 8), (10, 11), (11, 12), (12, 10), (13, 10), (14, 14)]
    df = spark.createDataFrame(edges, "child long, parent long")
    start = spark.createDataFrame([(1,)], "node long")
    assert {tuple(r) for r in graph.descendants(df, start).collect()} == {(2, 1), (3, 2), (4, 2)}
    assert {r["node"] for r in graph.below_roots(df, start).collect()} == {1, 2, 3, 4}
    assert {tuple(r) for r in graph.on_cycles(df).collect()} == {(10, 3), (11, 3), (12, 3), (14, 1)}
    two = spark.createDataFrame([*edges, (10, 2), (2, 3)], "child long, parent long")
    assert {(2, 2), (3, 2), (14, 1)} <= {tuple(r) for r in graph.on_cycles(two).collect()}
    ring = spark.createDataFrame([(i, (i + 1) % 100) for i in range(100)], "child long, parent long")
    assert {tuple(r) for r in graph.on_cycles(ring).collect()} == {(i, 100) for i in range(100)}


def test_overlaps_are_those_of_all_pairs(spark):
    import random

    r = random.Random(3)
    rows = [(r.randrange(4), i, r.choice([None, r.randrange(30)]), r.choice([None, r.randrange(40)])) for i in range(120)] + [(None, 500, 1, 2)]
    rows += rows[:3]
    want = sorted((x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] is not None and x[1] < y[1] and (x[2] is None or y[3] is None or x[2] <= y[3]) and (y[2] is None or x[3] is None or y[2] <= x[3]))
    got = temporal.overlapping(spark.createDataFrame(rows, "e int, k int, s int, t int"), "e", "k", "s", "t").collect()
    assert sorted(tuple(x) for x in got) == want


def test_more_advice(spark):
    resources = spark.createDataFrame([("a", "TAX"), ("b", "LOC")], "resource_id string, resource_type_code string")
    assert {r["resource_id"] for r in advisory.other_type(spark.createDataFrame([("a",), ("b",), ("c",)], "resource_id string"), resources, "TAX").collect()} == {"b", "c"}
    parents = spark.createDataFrame([("h", 1), ("h", 2), ("i", 1), ("j", 1), ("j", 1)], "h string, p int")
    assert {r["h"] for r in advisory.odd_parents(parents, "h", "p").collect()} == {"i", "j"}
    terms = spark.createDataFrame([("t1", "rank"), ("t2", "origin")], "term_key string, term_domain string")
    rows = spark.createDataFrame([(1, "t1"), (2, "t2"), (3, "t3"), (4, None)], "k int, rank_term_key string")
    assert {r["k"] for r in advisory.other_domain(rows, "k", "rank_term_key", terms, "rank").collect()} == {2, 3}


def test_the_library_stands_where_a_package_is_missing():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'ck_report' in q and not any(k.startswith('op') for k in q) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True)
