"""Numbers and sums over groups larger than a task, and interval joins built on them."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import ranking, temporal


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(params=[1_000_000, 5])
def large(request, monkeypatch):
    monkeypatch.setattr(ranking, "LARGE", request.param)


def test_running_sums(spark, large):
    r = random.Random(1)
    known = [(r.choice(["x", "y", None]), r.choice([None, 1, 2, 3]), i, r.randrange(5)) for i in range(400)]
    df = spark.createDataFrame(known, "g string, a int, k int, w int").repartition(7)
    got = {x["k"]: x["s"] for x in ranking.running_sum(df, ["g"], [F.col("a"), F.col("k")], F.col("w"), "s").collect()}
    for g, a, k, _ in known:
        order = lambda x: (x[1] is not None, x[1] or 0, x[2])
        assert got[k] == sum(x[3] for x in known if x[0] == g and order(x) <= order((g, a, k)))
    one = ranking.numbered(df, [], [F.col("a").isNull(), F.col("a"), F.col("k")], "n").collect()
    assert [x["n"] for x in sorted(one, key=lambda x: (x["a"] is None, x["a"] or 0, x["k"]))] == list(range(1, 401))
    same = ranking.numbered(df.withColumn("a", F.lit(1)), ["a"], [F.col("a")], "n")
    assert sorted(x["n"] for x in same.collect()) == list(range(1, 401))


def test_moments_in_intervals(spark, large):
    r = random.Random(2)
    spans = [(r.choice([1, 1, 1, 2, None]), i, r.choice([None, *range(20)]), r.choice([None, *range(20)])) for i in range(150)]
    points = [(r.choice([1, 1, 2, None]), i, r.choice([None, *range(-2, 22)])) for i in range(120)]
    a, b = spark.createDataFrame(spans, "e int, k int, f int, t int"), spark.createDataFrame(points, "e int, p int, at int")
    want = sorted((s[1], p[1]) for s in spans for p in points if s[0] is not None and s[0] == p[0] and p[2] is not None and (s[2] is None or s[2] <= p[2]) and (s[3] is None or p[2] <= s[3]))
    assert sorted(tuple(x) for x in temporal.covering(a, "e", "f", "t", b, "e", "at").select("span.k", "point.p").collect()) == want and len(want) > 500
    pairs = sorted((x[1], y[1]) for x in spans for y in spans if x[1] < y[1] and x[0] is not None and x[0] == y[0] and (x[2] is None or y[3] is None or x[2] <= y[3]) and (y[2] is None or x[3] is None or y[2] <= x[3]) and all(s[2] is None or s[3] is None or s[2] <= s[3] for s in (x, y)))
    sound = a.filter("f is null or t is null or f <= t")
    assert sorted(tuple(x) for x in temporal.overlapping(sound, "e", "k", "f", "t").select("a", "b").collect()) == pairs


def test_a_long_history_is_spread_over_tasks(spark, monkeypatch):
    """One entity with all rows: no task gets more than a part of them, and the numbers are whole."""
    monkeypatch.setattr(ranking, "LARGE", 1000)
    n = 40_000
    df = spark.range(n, numPartitions=4).select(F.lit(7).alias("e"), ((F.col("id") * 7919) % n).alias("at"))
    seen = {}
    real = ranking.cut

    def looked_at(x):
        out = real(x)
        seen.update({r["_rank_part"]: r["count"] for r in out.groupBy("_rank_part").count().collect()})
        return out

    monkeypatch.setattr(ranking, "cut", looked_at)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few bytes are one partition
    try:
        got = ranking.numbered(df, ["e"], [F.col("at")], "n")
        assert got.filter("n != at + 1").isEmpty() and got.count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(seen) >= 3 and max(seen.values()) < 0.6 * n


def test_wide_runs_go_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(1, 3, 9_000), (2, 5, 5), (3, 4096, 4096)], "k int, a long, b long")
    got = temporal.spread(df, F.col("a"), F.col("b"), "n").groupBy("k").agg(F.min("n"), F.max("n"), F.count("*"), F.count_distinct("n"))
    assert rows(got, "*") == [(1, 3, 9_000, 8_998, 8_998), (2, 5, 5, 1, 1), (3, 4096, 4096, 1, 1)]
