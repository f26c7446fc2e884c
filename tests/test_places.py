"""Boxes, geometry of several parts, the substring index, and labelled trees."""

import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattica.functions import geo
from lattica.operators import boxes, textindex, trees


def pack(kind, parts, order="<", flags=0, extra=0, srid=None):
    """A geometry written by hand; parts as for geo.wkb_of."""

    def head(kind, own):
        return struct.pack("B", order == "<") + struct.pack(order + "I", kind | flags | (0x20000000 if own else 0)) + (struct.pack(order + "I", own) if own else b"")

    def points(p):
        return b"".join(struct.pack(order + "dd" + "d" * extra, p[i], p[i + 1], *[9.0] * extra) for i in range(0, len(p), 2))

    def one(kind, pieces, own=None):
        out = head(kind, own)
        if kind == 1:
            return out + points(pieces[0])
        if kind == 3:
            out += struct.pack(order + "I", len(pieces))
        return out + b"".join(struct.pack(order + "I", len(p) // 2) + points(p) for p in pieces)

    if kind <= 3:
        return one(kind, parts[0], srid)
    return head(kind, srid) + struct.pack(order + "I", len(parts)) + b"".join(one(kind - 3 if kind < 7 else 1 + i % 3, p) for i, p in enumerate(parts))


SQUARE = [0.0, 0.0, 4.0, 0.0, 4.0, 4.0, 0.0, 4.0, 0.0, 0.0]
HOLE = [1.0, 1.0, 3.0, 1.0, 3.0, 3.0, 1.0, 3.0, 1.0, 1.0]
FAR = [10.0, 10.0, 12.0, 10.0, 11.0, 12.0, 10.0, 10.0]


def test_geometry_of_several_parts(spark):
    cases = [
        pack(4, [[[1.0, 2.0]], [[-3.0, 7.5]]]), pack(5, [[[0.0, 0.0, 1.0, 1.0]], [[5.0, 5.0, 6.0, 2.0, 7.0, 7.0]]], ">"), pack(6, [[SQUARE, HOLE], [FAR]], ">", srid=4326),
        pack(6, [[SQUARE], [FAR]], "<", 0x80000000, 1), pack(6, [[SQUARE], [FAR]], ">", 0xC0000000, 2), pack(7, [[[1.0, 1.0]], [[2.0, 2.0, 3.0, 3.0]], [FAR]]),
        pack(3, [[SQUARE, HOLE]]), pack(1, [[[1.5, -2.5]]]), pack(4, [[[float("nan"), float("nan")]], [[1.0, 1.0]]]), pack(6, []), pack(4, [[[1.0, 2.0]]])[:-1], b"", b"\x01\x63\x00\x00\x00", None,
    ]
    df = spark.createDataFrame([(i, bytearray(c) if c is not None else None) for i, c in enumerate(cases)], "i int, g binary")
    got = [r["s"] for r in df.select("i", geo.wkb_shape(F.col("g")).alias("s")).orderBy("i").collect()]
    box = lambda s: tuple(s[k] for k in ("west", "south", "east", "north"))
    assert [s and s["kind"] for s in got] == [4, 5, 6, 6, 6, 7, 3, 1, 4, 6, None, None, None, None]
    assert [box(s) for s in got[:10]] == [(-3, 2, 1, 7.5), (0, 0, 7, 7), (0, 0, 12, 12), (0, 0, 12, 12), (0, 0, 12, 12), (1, 1, 12, 12), (0, 0, 4, 4), (1.5, -2.5, 1.5, -2.5), (1, 1, 1, 1), (None,) * 4]
    assert [s["srid"] for s in got[:4]] == [None, None, 4326, None]
    assert [(p["kind"], len(p["rings"])) for p in got[2]["parts"]] == [(3, 2), (3, 1)]
    assert got[2]["parts"][1]["rings"][0]["xs"] == FAR[::2] and [p["kind"] for p in got[5]["parts"]] == [1, 2, 3]
    # What is written is read alike, and the kind by built-in functions is the same.
    parts = [(4, [[[1.0, 2.0]], [[3.0, 4.0]]]), (6, [[SQUARE, HOLE], [FAR]]), (2, [[[0.0, 0.0, 1.0, 1.0]]])]
    made = spark.createDataFrame(parts, "k int, p array<array<array<double>>>").select("k", geo.wkb_of(F.col("k"), F.col("p")).alias("g"))
    assert [(r["k"], bytes(r["g"])) for r in made.collect()] == [(k, pack(k, p)) for k, p in parts]
    assert all(r[0] == r[1] == r[2]["kind"] for r in made.select("k", geo.wkb_kind(F.col("g")), geo.wkb_shape(F.col("g"))).collect())


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ((3, [[SQUARE]]), (1, [[[4.0, 2.0]]]), True), ((3, [[SQUARE, HOLE]]), (1, [[[2.0, 2.0]]]), False), ((3, [[SQUARE, HOLE]]), (1, [[[3.0, 2.0]]]), True), ((3, [[SQUARE]]), (1, [[[2.0, 2.0]]]), True),
        ((3, [[SQUARE, HOLE]]), (3, [[[1.5, 1.5, 2.5, 1.5, 2.0, 2.5]]]), False), ((3, [[SQUARE]]), (3, [[[1.5, 1.5, 2.5, 1.5, 2.0, 2.5]]]), True), ((2, [[[0.0, 0.0, 4.0, 4.0]]]), (2, [[[0.0, 4.0, 4.0, 0.0]]]), True),
        ((2, [[[0.0, 0.0, 1.0, 1.0]]]), (2, [[[2.0, 2.0, 3.0, 3.0]]]), False), ((2, [[[0.0, 0.0, 2.0, 2.0]]]), (2, [[[2.0, 2.0, 3.0, 3.0]]]), True), ((2, [[[-1.0, 2.0, 5.0, 2.0]]]), (3, [[SQUARE]]), True),
        ((4, [[[9.0, 9.0]], [[2.0, 0.5]]]), (6, [[FAR], [SQUARE, HOLE]]), True), ((4, [[[9.0, 9.0]], [[2.0, 2.0]]]), (6, [[FAR], [SQUARE, HOLE]]), False), ((1, [[[1.0, 1.0]]]), (1, [[[1.0, 1.0]]]), True),
    ],
)
def test_geometries_that_share_a_point(spark, a, b, want):
    df = spark.createDataFrame([(i, bytearray(pack(*g))) for i, g in enumerate((a, b))], "k int, g binary").select("k", geo.wkb_shape(F.col("g")).alias("s"))
    assert boxes.geometries_meeting(df, None, "k", "s").count() == want
    assert boxes.geometries_meeting(df.filter("k = 1"), df.filter("k = 0"), "k", "s").count() == want


def test_boxes_of_all_sizes(spark):
    r = random.Random(7)
    known = []
    for i in range(260):
        x, y, w, h = r.uniform(-50, 50), r.uniform(-20, 20), 2 ** r.uniform(-9, 6) * r.randrange(2), 2 ** r.uniform(-9, 6) * r.randrange(2)
        known.append((i, x, y, x + w, y + h))
    known += [(900, -100.0, -100.0, 100.0, 100.0), (901, 0.0, 0.0, 0.0, 0.0), (902, 0.0, 0.0, 0.0, 0.0), (903, 5.0, 5.0, 4.0, 6.0), (904, None, 0.0, 1.0, 1.0), (905, float("nan"), 0.0, 1.0, 1.0), (906, 100.0, 100.0, 100.0, 100.0), (907, -100.0, -3.0, 100.0, -3.0)]
    a = spark.createDataFrame(known, "k int, west double, south double, east double, north double")
    sound = [b for b in known if all(v is not None and v == v for v in b) and b[1] <= b[3]]
    want = sorted((x[0], y[0]) for x in sound for y in sound if x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4])
    assert sorted((x["a"]["k"], x["b"]["k"]) for x in boxes.meeting(a, a).collect()) == want
    few = a.filter("k % 3 = 0")
    assert sorted((x["a"]["k"], x["b"]["k"]) for x in boxes.meeting(few, a).collect()) == [p for p in want if p[0] % 3 == 0]
    assert boxes.meeting(a.limit(0), a.limit(0)).count() == 0 == boxes.meeting(a, a.limit(0)).count()


def test_a_box_has_few_rows_whatever_its_size(spark):
    """The whole world beside a thousand points: the rows dealt are bounded for each box."""
    points = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 37).cast("double").alias("west"), (F.col("id") % 41).cast("double").alias("south")).withColumns({"east": F.col("west"), "north": F.col("south")})
    world = spark.createDataFrame([(-1, -1e6, -1e6, 1e6, 1e6)], "k long, west double, south double, east double, north double")
    assert boxes.meeting(world, points).count() == 1000
    cells = points.limit(1).select(F.struct("*").alias("row")).select(F.size(boxes._cells(F.lit(3), (-1e6, -1e6, 2e6), "row")).alias("n"))
    assert cells.first()["n"] <= 4


def test_the_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    known = [(i, "".join(r.choice("abcdé%_\\ 日😀\n") for _ in range(r.choice([0, 1, 2, 5, 40, 200])))) for i in range(400)] + [(7, "abcd repeated key"), (None, "abcd"), (5000, None), (5001, "x" * 100_000 + "needle")]
    df = spark.createDataFrame(known, "k long, s string")
    folder = str(tmp_path / "index")
    textindex.build(df, "k", "s", folder, block_bytes=4000)
    for pattern in ["%abc%", "%ab_d%", "abc%", "%é日%", "%d\\%a%", "%a\\\\b%", "%needle", "%zzz%", "%a%", "%", "", "%😀\n%", "%abcd%é%", "%_\\_c%"]:
        want = sorted((x["k"], x["s"]) for x in df.filter("k is not null").filter(F.col("s").like(pattern)).collect())
        assert sorted((x["id"], x["text"]) for x in textindex.like(spark, folder, pattern).collect()) == want, pattern
    rare = textindex.like(spark, folder, "%needle%")
    plan = rare._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*block#\d+L? (IN|INSET|=) ", plan)
    monkeypatch.setattr(textindex, "MOST_BLOCKS", 0)
    assert textindex.like(spark, folder, "%needle%").count() == 1
    empty = str(tmp_path / "none")
    textindex.build(df.limit(0), "k", "s", empty)
    assert textindex.like(spark, empty, "%abc%").count() == 0


def plain_labels(edges, nodes):
    parent = {c: p for c, p in edges}
    known = sorted(set(nodes) | set(parent) | set(parent.values()))
    children = {k: [c for c in known if parent.get(c) == k] for k in known}
    out, count = {}, [0, 0]
    for root in (k for k in known if k not in parent):
        stack = [(root, 0, False)]
        while stack:
            node, depth, left = stack.pop()
            if left:
                count[1] += 1
                out[node][1:3] = [count[1], count[0] - out[node][0] + 1]
                continue
            count[0] += 1
            out[node] = [count[0], 0, 0, depth]
            stack.append((node, depth, True))
            stack += [(c, depth + 1, False) for c in reversed(children[node])]
    return sorted((k, parent.get(k), *v) for k, v in out.items())


def test_labels_of_a_forest(spark):
    r = random.Random(5)
    edges = [(i, r.randrange(max(0, i - 9), i)) for i in range(1, 80) if i % 17] + [(200, 201), (201, 202), (202, 200), (203, 202)]
    nodes = [*range(80), 500]
    want = [x for x in plain_labels([e for e in edges if e[0] < 200], nodes)]
    labels = trees.labelled(spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame([(n,) for n in nodes], "node long")).cache()
    assert sorted(tuple(x) for x in labels.select("node", "parent", "pre", "post", "size", "depth").collect()) == want
    by = {x[0]: x for x in want}
    below = sorted((s, n, by[n][5] - by[s][5]) for s in (0, 17, 20, 500) for n in by if by[s][2] < by[n][2] < by[s][2] + by[s][4])
    starts = spark.createDataFrame([(0,), (17,), (20,), (500,), (999,)], "node long")
    assert sorted(tuple(x) for x in trees.below(labels, starts).collect()) == below
    assert trees.labelled(spark.createDataFrame([], "child long, parent long"), spark.createDataFrame([], "node long")).count() == 0


def test_a_long_chain_takes_log_rounds(spark, monkeypatch):
    rounds, real = [], trees.cut
    monkeypatch.setattr(trees, "cut", lambda x: rounds.append(1) or real(x))
    n = 3000
    labels = trees.labelled(spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent")), spark.range(n).withColumnRenamed("id", "node"))
    assert labels.filter("pre != node + 1 or depth != node or size != 3000 - node or post != 3000 - node").isEmpty() and labels.count() == n
    assert len(rounds) <= 18


def test_few_steps_are_counted_in_one_task(spark, monkeypatch):
    """Four tables are stored for a chain of 3000, none for each doubling; with very few rulers and steps a task, a forest with rings has the same labels."""
    rounds, real = [], trees.cut
    monkeypatch.setattr(trees, "cut", lambda x: rounds.append(1) or real(x))
    n = 3000
    chain = trees.labelled(spark.range(1, n).select(F.col("id").alias("child"), (F.col("id") - 1).alias("parent")), spark.range(n).withColumnRenamed("id", "node"))
    assert chain.filter("pre = node + 1 and depth = node").count() == n and len(rounds) <= 4
    monkeypatch.setattr(trees, "SMALL", 40)
    monkeypatch.setattr(trees, "SPARSE", 3)
    r = random.Random(6)
    edges = [(i, r.randrange(max(0, i - 9), i)) for i in range(1, 80) if i % 17] + [(200, 201), (201, 202), (202, 200), (203, 202)]
    labels = trees.labelled(spark.createDataFrame(edges, "child long, parent long"), spark.createDataFrame([(k,) for k in range(80)], "node long"))
    assert sorted(tuple(x) for x in labels.select("node", "parent", "pre", "post", "size", "depth").collect()) == plain_labels([e for e in edges if e[0] < 200], range(80))


def test_labels_send_no_table_to_all(spark, monkeypatch):
    plans, real = [], trees.cut

    def cut(x):  # a join is changed while it runs, so its plan is looked at afterwards
        out = real(x)
        plans.append(x._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(trees, "cut", cut)
    labels = trees.labelled(spark.createDataFrame([(2, 1), (3, 1), (4, 2)], "child long, parent long"), spark.createDataFrame([(n,) for n in (1, 2, 3, 4)], "node long"))
    assert labels.count() == 4 and len(plans) > 3
    assert not any("BroadcastHashJoin" in p for p in plans[3:])


def test_small_boxes_do_not_meet_where_wide_ones_are_looked_for(spark, monkeypatch):
    """Four thousand small boxes apart from each other and one over them all: pairs are as many as boxes, not their square; cells dealt into parts give the same."""
    small = spark.range(4000).select("id", (F.col("id") % 200).cast("double").alias("west"), F.floor(F.col("id") / 200).cast("double").alias("south"))
    small = small.select("id", "west", "south", (F.col("west") + 0.5).alias("east"), (F.col("south") + 0.5).alias("north"))
    rows = small.unionByName(spark.createDataFrame([(-1, -1.0, -1.0, 250.0, 250.0)], small.schema))
    for pairs in (boxes.PAIRS, 1000):
        monkeypatch.setattr(boxes, "PAIRS", pairs)
        got = boxes.meeting(rows, rows).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
        assert got.agg(F.count("*"), F.count_distinct("a", "b"), F.count_if(F.col("a") == F.col("b")), F.count_if(F.col("a") < F.col("b"))).first() == (12_001, 12_001, 4001, 4000)


def test_a_worker_holds_few_grams_of_a_block(spark, tmp_path, monkeypatch):
    """Postings of a block come in several rows, so that what a worker holds doesn't grow with the block."""
    monkeypatch.setattr(textindex, "HELD", 500)
    rows = spark.createDataFrame([(k, f"text {k} {'abcdefghij' * 2} {k * 7919}") for k in range(300)], "k long, s string")
    textindex.build(rows, "k", "s", str(tmp_path / "index"))
    assert textindex.postings_of(spark, str(tmp_path / "index")).groupBy("gram", "block").count().filter("count > 1").count() > 0
    assert [r["id"] for r in textindex.like(spark, str(tmp_path / "index"), "text 17 %").collect()] == [17]
    assert textindex.like(spark, str(tmp_path / "index"), "%abcdefghij%").count() == 300


def plain_meet(a, b):
    """Whether two geometries (kind, parts) of whole numbers share a point, side by side in exact numbers."""

    def singles(kind, parts):
        return [((kind - 3 if kind > 3 else kind), [[(r[k], r[k + 1]) for k in range(0, len(r), 2)] for r in p]) for p in parts]

    def sides(kind, rings):
        return [(r[k], r[(k + 1) % len(r)]) for r in rings for k in range(len(r) if kind == 3 or len(r) == 1 else len(r) - 1)]

    def turn(p, q, r):
        return (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])

    def touch(s, t):
        (p, q), (u, v) = s, t
        near = all(min(p[k], q[k]) <= max(u[k], v[k]) and min(u[k], v[k]) <= max(p[k], q[k]) for k in (0, 1))
        return near and turn(p, q, u) * turn(p, q, v) <= 0 and turn(u, v, p) * turn(u, v, q) <= 0

    def inside(at, rings):
        # What is below a side and to the left of it, times the sides' direction.
        return sum(1 for p, q in sides(3, rings) if (p[1] > at[1]) != (q[1] > at[1]) and (turn(p, q, at) > 0) == (q[1] > p[1])) % 2 == 1

    for k, x in singles(*a):
        for m, y in singles(*b):
            if any(touch(s, t) for s in sides(k, x) for t in sides(m, y)) or (m == 3 and inside(x[0][0], y)) or (k == 3 and inside(y[0][0], x)):
                return True
    return False


def some_geometries(n, seed):
    r = random.Random(seed)
    known = []
    for i in range(n):
        x, y, w = r.randrange(30), r.randrange(30), r.choice([0, 1, 2, 3, 12])
        ring = [x, y, x + w, y + r.randrange(2) * w, x + w, y + w, x, y + w]
        closed = ring + ring[:2] * r.randrange(2)
        hole = [x + 4, y + 4, x + 8, y + 6, x + 6, y + 8, x + 4, y + 4]
        polygon = [closed, hole] if w == 12 and ring[3] == y else [closed]
        kind = r.choice([1, 2, 3, 4, 5, 6])
        one = {1: [[x, y]], 2: [ring[:4]], 3: polygon}[kind - 3 if kind > 3 else kind]
        far = [[v + 9 for v in piece] for piece in one]
        known.append((i, kind, [[[float(v) for v in piece] for piece in p] for p in ([one] if kind <= 3 else [one, far])]))
    return known


def test_geometries_of_all_kinds_meet_as_they_do_one_by_one(spark, monkeypatch):
    """Of random ones on a grid, where edges and corners often touch; cells dealt into blocks of few, in many buckets, give the same."""
    known = some_geometries(120, 11)
    want = sorted((a[0], b[0]) for a in known for b in known if a[0] < b[0] and plain_meet(a[1:], b[1:]))
    assert 200 < len(want) < 3000
    shaped = spark.createDataFrame(known, "k long, kind int, parts array<array<array<double>>>").select("k", geo.wkb_shape(geo.wkb_of(F.col("kind"), F.col("parts"))).alias("s")).cache()
    assert sorted(tuple(x) for x in boxes.geometries_meeting(shaped, None, "k", "s").collect()) == want
    monkeypatch.setattr(boxes, "BLOCK", 4)
    monkeypatch.setattr(boxes, "HELD", 30)
    assert sorted(tuple(x) for x in boxes.geometries_meeting(shaped, None, "k", "s").collect()) == want
    few, named = shaped.filter("k % 4 = 0"), shaped.select(F.concat(F.lit("g"), "k").alias("k"), "s")
    both = want + [(b, a) for a, b in want] + [(k, k) for k in range(120)]
    assert sorted(tuple(x) for x in boxes.geometries_meeting(few, named, "k", "s").collect()) == sorted((a, f"g{b}") for a, b in both if a % 4 == 0)
    none = boxes.geometries_meeting(few.limit(0), named.limit(0), "k", "s")
    assert none.dtypes == [("a", "bigint"), ("b", "string")] and none.count() == 0


def test_parts_of_very_many_sides_are_compared_some_at_a_time(monkeypatch):
    known = some_geometries(60, 12)
    parts = [p for g in known for p in geo.shape_of(pack(*g[1:]))["parts"]]
    sides = geo.Sides(pa.array(parts, type=geo._PART_PA))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(parts)), np.arange(len(parts))))
    want = sides.meet(i, j)
    assert 0 < want.sum() < len(i) and (want == sides.meet(j, i)).all()
    monkeypatch.setattr(geo, "MOST", 3)
    assert (want == sides.meet(i, j)).all()


def test_no_row_is_formed_where_only_boxes_meet(spark):
    """Six hundred lines side by side, aslant: all boxes meet, no two lines do. No step gives as many rows as a tenth of their 179,700 pairs."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def rows():
        bus.waitUntilEmpty()
        out, runs = {}, store.executionsList()
        for run in (runs.apply(k) for k in range(runs.size())):
            values, metrics = store.executionMetrics(run.executionId()), run.metrics()
            found = (values.get(m.accumulatorId()) for m in (metrics.apply(k) for k in range(metrics.size())) if m.name() == "number of output rows")
            out[run.executionId()] = max((int(v.get().replace(",", "")) for v in found if v.isDefined()), default=0)
        return out

    line = F.array(*((F.lit(v) + F.col("id") * w).cast("double") for v, w in ((0, 1), (0, -1), (5000, 1), (5000, -1))))
    shaped = spark.range(600).select("id", geo.wkb_shape(geo.wkb_of(F.lit(2), F.array(F.array(line)))).alias("s"))
    before = rows()
    assert boxes.geometries_meeting(shaped, None, "id", "s").count() == 0
    assert 600 <= max(n for k, n in rows().items() if k not in before) < 17_970
