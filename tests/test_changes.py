"""Fields of JSON documents: paths, changes, replay; and import outcomes."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lattica.functions import documents
from lattica.operators import reconcile


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def plain_leaves(x, path=""):
    if isinstance(x, dict) and x:
        return {k: v for key, y in x.items() for k, v in plain_leaves(y, path + "/" + key.replace("~", "~0").replace("/", "~1").replace("#", "~2")).items()}
    if isinstance(x, list) and x:
        return {k: v for i, y in enumerate(x) for k, v in plain_leaves(y, f"{path}#{i}").items()}
    return {path: json.dumps(x, separators=(",", ":"), ensure_ascii=False)}


def made(r, depth=0):
    kind = r.randrange(7 if depth < 4 else 4)
    if kind < 4:
        return [None, True, r.randrange(100), r.choice(["", "a\"b", "é/#~", "{[", "back\\slash"])][kind]
    if kind < 6:
        return {r.choice(["a", "b", "x/y", "~", "#0", "0", "~1", "q\"t", "é"]): made(r, depth + 1) for _ in range(r.randrange(4))}
    return [made(r, depth + 1) for _ in range(r.randrange(14) if depth == 1 else r.randrange(4))]


def test_leaves_of_nested_documents(spark):
    r = random.Random(4)
    known = [made(r) for _ in range(150)] + [{}, [], 5, None, "x", {"a": {"0": 1}, "b": [1]}, list(range(12))]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(known)] + [(900, None), (901, "no json {"), (902, "")], "k int, j string")
    got = {}
    for k, path, value in rows(documents.leaves(df, "j", ["k"]), "k", "path", "value"):
        assert path not in got.setdefault(k, {})
        got[k][path] = value
    assert got == {i: plain_leaves(x) for i, x in enumerate(known)}
    back = documents.rebuilt(documents.leaves(df, "j", ["k"]), ["k"])
    assert {r["k"]: json.loads(r["document"]) for r in back.collect()} == dict(enumerate(known))
    assert documents.leaves(df.filter("k > 900"), "j", ["k"]).count() == 0


def test_changes_between_two_states(spark):
    old = spark.createDataFrame([(1, '{"a":1,"b":{"c":[1,2]},"e":null}'), (2, "[1]"), (3, '{"x":1.0}')], "k int, j string")
    new = spark.createDataFrame([(1, '{"b":{"c":[1,3,4]},"a":1,"e":false}'), (3, '{"x":1.0}'), (4, '{"n":{}}')], "k int, j string")
    got = documents.field_changes(documents.leaves(old, "j", ["k"]), documents.leaves(new, "j", ["k"]), ["k"])
    assert rows(got, "k", "path", "change_kind", "old_value", "new_value") == [
        (1, "/b/c#1", "changed", "2", "3"), (1, "/b/c#2", "added", None, "4"), (1, "/e", "changed", "null", "false"), (2, "#0", "removed", "1", None), (4, "/n", "added", None, "{}"),
    ]


def test_replay_gives_every_stored_version(spark):
    r = random.Random(9)
    stored = {(e, n): made(r) for e in range(6) for n in range(8)}
    df = spark.createDataFrame([(e, n, json.dumps(x)) for (e, n), x in stored.items()] + [(7, 0, '{"a":1}'), (7, 1, None), (7, 2, '{"a":1}')], "e int, at int, j string")
    changes = documents.history(df, "e", [F.col("at")], "j").cache()
    for n in range(8):
        got = {x["e"]: json.loads(x["document"]) for x in documents.replayed(changes, "e", F.lit(n + 1)).filter("e < 7").collect()}
        assert got == {e: stored[e, n] for e in range(6)}
    # A version without a document removes all, and the next adds it again.
    assert rows(changes.filter("e = 7"), "revision_no", "path", "change_kind") == [(1, "/a", "added"), (2, "/a", "removed"), (3, "/a", "added")]
    assert documents.replayed(changes.filter("e = 7"), "e", F.lit(2)).count() == 0


def test_fields_of_a_history_are_not_shuffled(spark):
    """Documents meet by entity and number; the fields they fall into stay where they are."""
    df = spark.createDataFrame([(1, n, json.dumps({"a": n // 2, "b": [n]})) for n in range(4)], "e int, at int, j string")
    changes = documents.history(df, "e", [F.col("at")], "j")
    plan = changes._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")]
    assert rows(changes.filter("revision_no > 2"), "revision_no", "path", "change_kind", "old_value", "new_value") == [(3, "/a", "changed", "0", "1"), (3, "/b#0", "changed", "1", "2"), (4, "/b#0", "changed", "2", "3")]


def test_seven_outcomes(spark):
    staged = spark.createDataFrame(
        [("a", "1", 0, True, False), ("a", "2", 1, False, False), ("a", "3", 2, False, False), ("b", "1", 0, False, False), ("c", "1", 0, False, False), ("d", "1", 0, True, False), ("f", "1", 0, True, True), (None, "1", 0, False, False), ("g", "9", 5, False, None), ("g", "9", 5, None, False)],
        "k string, h string, o int, bad boolean, lost boolean",
    )
    current = spark.createDataFrame([("b", "1"), ("c", "0"), ("d", "1"), ("e", "1"), (None, "2")], "k string, h string")
    found = reconcile.outcomes(staged, current, "k", "h", F.col("o"), F.col("bad"), F.col("lost"))
    # A broken first row doesn't make the sound one after it a duplicate.
    assert rows(found, "k", "outcome") == sorted(
        [("a", "quarantined"), ("a", "inserted"), ("a", "duplicate"), ("b", "unchanged"), ("c", "updated"), ("d", "quarantined"), ("e", "skipped"), ("f", "failed"), (None, "failed"), ("g", "inserted"), ("g", "duplicate")], key=str
    )


@pytest.mark.parametrize("copies", [2, 9_000])
def test_a_key_with_many_copies(spark, copies):
    staged = spark.range(copies).select(F.lit("k").alias("k"), F.lit("h").alias("h"), "id")
    found = reconcile.outcomes(staged, staged.limit(0).select("k", "h"), "k", "h", F.col("id")).groupBy("outcome").count()
    assert rows(found, "outcome", "count") == [("duplicate", copies - 1), ("inserted", 1)]
