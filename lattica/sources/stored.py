"""Stored tables in versions: a batch is merged into the buckets that it touches, and two versions are compared by what differs.

    data/<write>/bucket=.../    rows, dealt by a hash of their key, sorted by it
    versions/<n>/               the manifest of a version: for each bucket its write, its rows and a digest of them

A version exists once its manifest is committed, which is the last step; a run that fails before leaves the table as it
was and files that nobody lists. Buckets whose rows are the same by their digest keep their files, and a version in which
nothing differs is not written: the same batch again changes nothing. A digest is a sum over the rows' hashes of 64 bits
and a second one of other bits, so it doesn't depend on their order.

Rows of a table have different keys, none of them null; the number of buckets is set when the table is made, and no more
than a row for each is ever brought to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.lineage import cut

BUCKETS = 64
_MANIFEST = "bucket int, write string, n long, digest string"

#: Rows of a bucketed table's bucket.
BUCKET_ROWS = 1_000_000


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def newest(spark: SparkSession, folder: str) -> int:
    """The number of the last committed version, 0 if there is none."""
    n = 0
    while _exists(spark, f"{folder}/versions/{n + 1}/_SUCCESS"):
        n += 1
    return n


def manifest(spark: SparkSession, folder: str, version: int) -> DataFrame:
    if not version:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/versions/{version}")


def _dealt(rows: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _digests(rows: DataFrame) -> dict[int, tuple[int, str]]:
    """bucket: rows and digest."""
    names = sorted(c for c in rows.columns if c != "bucket")
    first = F.xxhash64(*(F.col(f"`{c}`") for c in names), F.array(*(F.col(f"`{c}`").isNull() for c in names)))
    second = F.xxhash64(F.lit(1), *(F.col(f"`{c}`") for c in reversed(names)))
    sums = rows.groupBy("bucket").agg(F.count("*").alias("n"), *(F.sum(h.cast("decimal(38,0)")).cast("string").alias(n) for n, h in (("one", first), ("two", second))))
    return {r["bucket"]: (r["n"], f"{r['one']}:{r['two']}") for r in sums.collect()}


def _committed(rows: DataFrame, folder: str, keys: Sequence[str], kept: dict[int, tuple], version: int) -> int:
    """rows (with bucket): whole buckets; kept: of buckets that rows say nothing of. Returns the number of the version that holds both."""
    spark = rows.sparkSession
    rows = cut(rows)
    before = {r["bucket"]: (r["write"], r["n"], r["digest"]) for r in manifest(spark, folder, version).collect()}
    found = _digests(rows)
    fresh = [b for b, x in found.items() if before.get(b, (None, None, None))[1:] != x]
    state = kept | {b: before[b] if b not in fresh else None for b in found}
    if not fresh and state == before and version:
        return version
    write = uuid.uuid4().hex
    # An empty table has a write too, for its columns.
    rows.filter(F.col("bucket").isin(fresh)).repartition("bucket").sortWithinPartitions("bucket", *keys).write.partitionBy("bucket").parquet(f"{folder}/data/{write}")
    lines = [(b, *(x or (write, *found[b]))) for b, x in sorted(state.items())]
    spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.parquet(f"{folder}/versions/{version + 1}")
    return version + 1


def write_version(rows: DataFrame, folder: str, keys: Sequence[str], buckets: int = BUCKETS) -> int:
    """The rows as the table's next version, whole."""
    return _committed(_dealt(rows, keys, buckets), folder, keys, {}, newest(rows.sparkSession, folder))


def read(spark: SparkSession, folder: str, schema: StructType, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version (the newest); only: of some buckets."""
    version = newest(spark, folder) if version is None else version
    parts = [r for r in manifest(spark, folder, version).collect() if only is None or r["bucket"] in only]
    whole = StructType([f for f in schema if f.name != "bucket"]).add("bucket", "integer")
    if not parts:
        return spark.createDataFrame([], whole)
    by_write: dict[str, list[str]] = {}
    for r in parts:
        by_write.setdefault(r["write"], []).append(f"{folder}/data/{r['write']}/bucket={r['bucket']}")
    each = [spark.read.schema(whole).option("basePath", f"{folder}/data/{w}").parquet(*paths) for w, paths in by_write.items()]
    return reduce(DataFrame.unionByName, each)


def merge(batch: DataFrame, folder: str, keys: Sequence[str], how: dict[str, str], order: str, buckets: int = BUCKETS) -> int:
    """The batch's rows put into the table; returns the number of the version that has them.

    how: for each column that is no key `min`, `max`, or `last`, the value of the row with the greatest `order`; of equal
    ones the batch's, and of those the greatest value. Rows without a key are left out. Only buckets with rows of the batch are read and
    only those that differ afterwards are written.
    """
    spark = batch.sparkSession
    version = newest(spark, folder)
    fresh = cut(_dealt(batch.dropna(subset=list(keys)).select(*keys, *how), keys, buckets))
    touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
    old = read(spark, folder, fresh.schema, version, touched)
    both = old.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))

    def value(c: str) -> Column:
        match how[c]:
            case "min":
                return F.min(c)
            case "max":
                return F.max(c)
            case "last":
                return F.max(F.struct(order, "_new", c))[c]
        raise ValueError(f"{c}: {how[c]}")

    merged = both.groupBy("bucket", *keys).agg(*(value(c).alias(c) for c in how))
    kept = {r["bucket"]: (r["write"], r["n"], r["digest"]) for r in manifest(spark, folder, version).collect() if r["bucket"] not in touched}
    return _committed(merged, folder, keys, kept, version)


def difference(spark: SparkSession, folder: str, schema: StructType, keys: Sequence[str], old: int, new: int) -> DataFrame:
    """keys, change (added, removed, changed), old and new (the rows as structs) of two versions. Buckets with equal digests are not read."""
    a, b = ({r["bucket"]: (r["n"], r["digest"]) for r in manifest(spark, folder, v).collect()} for v in (old, new))
    differ = [x for x in {*a, *b} if a.get(x) != b.get(x)]
    names = [f.name for f in schema if f.name != "bucket"]
    one, two = (read(spark, folder, schema, v, differ).select(*(F.col(k).alias(f"_{side}{k}") for k in keys), F.struct(*names).alias(side)) for v, side in ((old, "old"), (new, "new")))
    same = reduce(lambda x, y: x & y, (F.col(f"_old{k}") == F.col(f"_new{k}") for k in keys))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    both = one.join(two, same, "full_outer").withColumn("change", change).filter("change is not null")
    return both.select(*(F.coalesce(f"_new{k}", f"_old{k}").alias(k) for k in keys), "change", "old", "new")


def write_bucketed(rows: DataFrame, name: str, folder: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table of the session's catalogue, its files in the folder, bucketed and sorted by its keys: joins and groups by them with another such table of as many buckets need no exchange."""
    rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", folder).mode("overwrite").saveAsTable(name)
    return rows.sparkSession.table(name)


def buckets_for(*tables: DataFrame, least: int = 8) -> int:
    """Buckets for tables that are to be joined: about BUCKET_ROWS rows of all of them in each, since one task sorts and joins a bucket."""
    return max(least, -(-sum(d.count() for d in tables) // BUCKET_ROWS))
