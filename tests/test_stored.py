"""Stored tables in versions, tables laid out by their key, streams that go on from their checkpoint, and the sources."""

import hashlib
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lattica.model.catalog import catalog, schema_of
from lattica.rules import advisory
from lattica.sources import stored, tables
from lattica.streaming import ledger

HOW = {"first": "min", "last": "max", "v": "last"}


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def files(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def batch(spark, known):
    return spark.createDataFrame([(k, t, t, v) for k, t, v in known], "k int, first int, last int, v string")


def test_batches_in_any_order_give_one_table(spark, tmp_path):
    r = random.Random(1)
    known = [(r.randrange(60), t, r.choice([None, "a", "b", "c"])) for t in r.sample(range(1000), 200)]
    want = sorted(((k, min(t for x, t, _ in known if x == k), *max((t, v) for x, t, v in known if x == k)) for k in {k for k, *_ in known}), key=str)
    for order in (known, known[::-1], sorted(known, key=str)):
        folder = str(tmp_path / str(len(os.listdir(tmp_path))))
        for i in range(0, 200, 50):
            part = {}
            for k, t, v in order[i : i + 50]:
                part.setdefault(k, []).append((t, v))
            df = spark.createDataFrame([(k, min(x)[0], *max(x)) for k, x in part.items()], "k int, first int, last int, v string")
            stored.merge(df, folder, ["k"], HOW, "last", 5)
        assert rows(stored.read(spark, folder, df.schema), "k", "first", "last", "v") == want


def test_the_same_batch_again_changes_nothing(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert stored.newest(spark, folder) == 0
    one = batch(spark, [(k, 10, f"v{k}") for k in range(100)])
    assert stored.merge(one, folder, ["k"], HOW, "last", 16) == 1
    before = files(folder)
    assert stored.merge(one, folder, ["k"], HOW, "last", 16) == 1 and stored.merge(one.limit(0), folder, ["k"], HOW, "last", 16) == 1
    assert files(folder) == before
    # One key touches one bucket: the other buckets keep their files under their names.
    assert stored.merge(batch(spark, [(3, 20, "new"), (None, 1, "no key")]), folder, ["k"], HOW, "last", 16) == 2
    fresh = [f for f in files(f"{folder}/data") - before]
    assert len(fresh) == 1 and before <= files(folder)
    assert rows(stored.read(spark, folder, one.schema).filter("k = 3"), "first", "last", "v") == [(10, 20, "new")]
    assert stored.read(spark, folder, one.schema).count() == 100 == stored.read(spark, folder, one.schema, 1).count()
    # Nothing but the touched bucket is read.
    touched = stored.manifest(spark, folder, 2).join(stored.manifest(spark, folder, 1).withColumnRenamed("digest", "d"), "bucket").filter("digest != d").select("bucket").collect()
    assert len(touched) == 1


def test_a_run_that_fails_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    one = batch(spark, [(k, 10, "a") for k in range(20)])
    stored.merge(one, folder, ["k"], HOW, "last", 4)
    real = spark.createDataFrame

    def fails(rows, schema=None, **more):
        if schema == stored._MANIFEST and rows:
            raise OSError("lost")
        return real(rows, schema, **more)

    two = batch(spark, [(k, 30, "b") for k in range(10, 30)])
    monkeypatch.setattr(spark, "createDataFrame", fails)
    with pytest.raises(OSError):
        stored.merge(two, folder, ["k"], HOW, "last", 4)
    monkeypatch.undo()
    assert stored.newest(spark, folder) == 1 and rows(stored.read(spark, folder, one.schema), "v") == [("a",)] * 20
    assert stored.merge(two, folder, ["k"], HOW, "last", 4) == 2
    assert rows(stored.read(spark, folder, one.schema).groupBy("v").count(), "v", "count") == [("a", 10), ("b", 20)]


def test_versions_compared(spark, tmp_path):
    folder = str(tmp_path / "t")
    known = {i: (i, f"n{i}", i / 2 if i % 3 else None) for i in range(300)}
    schema = "id int, name string, x double"
    frame = lambda d: spark.createDataFrame(list(d.values()), schema)
    assert stored.write_version(frame(known), folder, ["id"], 32) == 1
    assert stored.write_version(frame(known).repartition(5), folder, ["id"], 32) == 1  # nothing differs
    other = {i: v for i, v in known.items() if i != 7} | {900: (900, "new", 1.0), 8: (8, "n8", None), 9: (9, "n9", 5.0)}
    assert stored.write_version(frame(other), folder, ["id"], 32) == 2
    found = stored.difference(spark, folder, frame(known).schema, ["id"], 1, 2)
    assert rows(found, "id", "change", "old.x", "new.x") == [(7, "removed", 3.5, None), (8, "changed", 4.0, None), (9, "changed", None, 5.0), (900, "added", None, 1.0)]
    assert rows(stored.difference(spark, folder, frame(known).schema, ["id"], 2, 1), "id", "change") == [(7, "added"), (8, "changed"), (9, "changed"), (900, "removed")]
    # Only buckets that differ are opened, and equal ones are not written again.
    assert len(found.inputFiles()) <= 8 < len(files(f"{folder}/data"))
    again = [{(r["bucket"], r["write"]) for r in stored.manifest(spark, folder, v).collect()} for v in (1, 2)]
    assert len(again[0] & again[1]) >= 28
    assert stored.write_version(frame({}), folder, ["id"], 32) == 3 and stored.read(spark, folder, frame(known).schema).count() == 0
    assert stored.difference(spark, folder, frame(known).schema, ["id"], 3, 3).count() == 0


def test_joins_by_the_key_of_the_layout_need_no_exchange(spark, tmp_path):
    a = spark.range(1000).select("id", (F.col("id") % 7).alias("x"))
    one = stored.write_bucketed(a, "laid_one", str(tmp_path / "a"), ["id"], 4)
    two = stored.write_bucketed(a.withColumnRenamed("x", "y"), "laid_two", str(tmp_path / "b"), ["id"], 4)
    try:
        both = one.hint("merge").join(two, "id").groupBy("id").agg(F.max("x").alias("x"), F.count("*").alias("n"))
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert both.filter("n != 1 or x != id % 7").isEmpty() and both.count() == 1000
    finally:
        spark.sql("DROP TABLE laid_one")
        spark.sql("DROP TABLE laid_two")


def test_streams_go_on_where_they_were(spark, tmp_path):
    """Records that come late, twice, and after a stop: the same rows as from all of them at once."""
    r = random.Random(5)
    start = datetime(2024, 1, 1)
    known = [(r.randrange(8), start + timedelta(hours=r.randrange(240))) for _ in range(300)]
    folder, state = tmp_path / "in", str(tmp_path / "state")
    seen_out, once_out = str(tmp_path / "seen"), str(tmp_path / "once")
    for part in range(4):
        some = known[part * 75 : part * 75 + 75] + known[:5]
        spark.createDataFrame(some, "k int, at timestamp").coalesce(1).write.parquet(str(folder / f"part{part}"))
        if part % 2:
            continue  # two folders come between stops
        source = ledger.records(spark, f"{folder}/*", spark.read.parquet(str(folder / "part0")).schema, files=1)
        seen = ledger.sightings(source, ["k"], "at", "20 days", "1 day").select("k", F.col("window.start").alias("day"), "first_seen_at", "last_seen_at", "n")
        ledger.ledger(seen, ledger.updates(seen_out), f"{state}/seen", "update").awaitTermination()
        ledger.ledger(ledger.once(source, ["k", "at"], "at", "20 days"), ledger.updates(once_out), f"{state}/once").awaitTermination()
    everything = spark.read.parquet(*[str(folder / f"part{p}") for p in range(3)])
    want = everything.groupBy("k", F.window("at", "1 day")["start"].alias("day")).agg(F.min("at").alias("a"), F.max("at").alias("b"), F.count("*").alias("n"))
    assert rows(ledger.newest(spark, seen_out, seen.schema, ["k", "day"]), "k", "day", "first_seen_at", "last_seen_at", "n") == rows(want, "k", "day", "a", "b", "n")
    assert rows(spark.read.parquet(once_out), "k", "at") == rows(everything.distinct(), "k", "at")


def test_sources(spark, tmp_path):
    os.makedirs(tmp_path / "files")
    for name, data in (("a.bin", b"abc"), ("b.bin", b"")):
        (tmp_path / "files" / name).write_bytes(data)
    got = rows(tables.assets(spark, str(tmp_path / "files")).withColumn("name", F.regexp_extract("path", "[^/]+$", 0)), "name", "size_bytes", "sha256")
    assert got == [("a.bin", 3, hashlib.sha256(b"abc").hexdigest())]  # a file without bytes is not listed
    root = str(tmp_path / "root")
    for snapshot, n in (("2024", 3), ("2025", 5), ("2024", 2)):  # the first is written anew, the second stays
        tables.write_snapshot(spark.range(n), root, "backbone", snapshot)
    assert rows(spark.read.parquet(f"{root}/backbone").groupBy("snapshot").count(), "snapshot", "count") == [(2024, 2), (2025, 5)]


def test_namespaces_and_declared_tables(spark, tmp_path):
    root, name = str(tmp_path / "model"), "core.agent_resource_role"
    schema = schema_of(catalog()[name])
    spark.createDataFrame([tuple(None for _ in schema.fields)], schema).write.parquet(f"{root}/{name}")
    names = tables.register(spark, root)
    try:
        assert len(names) == 67 and {d.name for d in spark.catalog.listDatabases()} >= {n.split(".")[0] for n in names}
        assert spark.table(name).schema == schema and spark.table(name).count() == 1 == tables.resource_table(spark, root, name).count()
        assert spark.table("governance.import_batch").count() == 0
    finally:
        for space in {n.split(".")[0] for n in names}:
            spark.sql(f"DROP DATABASE {space} CASCADE")


def test_closed_runs_that_changed(spark):
    runs = spark.createDataFrame([("a", "closed", 10), ("b", "closed", 10), ("c", "running", None)], "resource_id string, run_status string, closed_at int")
    revisions = spark.createDataFrame([("a", 1, 5), ("a", 2, 10), ("a", 3, 11), ("a", 4, 12), ("b", 1, 9), ("c", 1, 50)], "target_resource_id string, revision_no int, changed_at int")
    assert rows(advisory.changed_after_close(runs, revisions), "resource_id", "revision_no", "n") == [("a", 3, 2)]


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    """A bucket is one task's, so a set number of them would grow with the input."""
    assert stored.buckets_for(spark.range(5000), spark.range(1)) == 8
    monkeypatch.setattr(stored, "BUCKET_ROWS", 100)
    assert stored.buckets_for(spark.range(5000), spark.range(1)) == 51
