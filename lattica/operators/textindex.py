"""Substring search by an index of trigrams, kept as tables.

Texts are dealt into blocks of about `block_bytes`. For each trigram (three code points, as one number) and block there
is one row with the ids of the block's texts that hold it, so that a trigram of all texts is no row without bound.
These rows are dealt by trigram into buckets, sorted in each: a search reads the buckets of its trigrams, and of
their files the parts that may hold them. It takes the rarest trigrams of the pattern, intersects their ids block by
block, fetches the texts of what is left from the blocks concerned, and tests them.

    texts/block=.../    id, text, sorted by id
    postings/bucket=.../    gram, block, ids, sorted by gram
    grams/bucket=.../    gram, n: texts that hold it
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Code points of a gram; bytes of a block; buckets; grams of a pattern that are looked up; blocks that a search names.
GRAM, BLOCK_BYTES, BUCKETS, RAREST, MOST_BLOCKS = 3, 32 << 20, 64, 4, 5000
#: Grams with their ids that a worker holds at once, and rows that it takes from a batch at once.
HELD, AT_ONCE = 500_000, 64
_BITS = 21


def grams_of(text: str) -> np.ndarray:
    """The different trigrams of a text as numbers, in order."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    if len(points) < GRAM:
        return np.zeros(0, dtype=np.int64)
    return np.unique(points[:-2] << 2 * _BITS | points[1:-1] << _BITS | points[2:])


def _bucket() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int")


def _postings(texts: DataFrame) -> DataFrame:
    """gram, block, ids from texts (block, id, text), those of a block one after another."""
    schema = pa.schema([("gram", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def rows(block: int, ids: list[int], grams: list[np.ndarray]) -> pa.RecordBatch:
        gram, id_ = np.concatenate(grams), np.repeat(np.asarray(ids, dtype=np.int64), [len(g) for g in grams])
        order = np.lexsort((id_, gram))
        gram, id_ = gram[order], id_[order]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(gram)).astype(np.int32)), pa.array(id_))
        return pa.RecordBatch.from_arrays([pa.array(gram[start]), pa.array(np.full(len(start), block)), lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, grams, size = None, [], [], 0
        for batch in (whole.slice(at, AT_ONCE) for whole in batches for at in range(0, whole.num_rows, AT_ONCE)):
            for block, id_, text in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "text")), strict=True):
                # A block with more grams gives several rows for a gram.
                if ids and (block != now or size > HELD):
                    yield rows(now, ids, grams)
                    ids, grams, size = [], [], 0
                now = block
                ids.append(id_)
                grams.append(grams_of(text))
                size += len(grams[-1])
        if ids:
            yield rows(now, ids, grams)

    return texts.mapInArrow(run, "gram long, block long, ids array<long>")


def build(rows: DataFrame, key: str, text: str, folder: str, block_bytes: int = BLOCK_BYTES) -> None:
    """Writes the index of a text column into a new folder. Rows without a key or a text are left out; keys are longs, and repeated rows are kept."""
    spark = rows.sparkSession
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).dropna()
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    # A key that very many rows have is dealt by its texts too.
    placed = own.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    placed.repartition("block").sortWithinPartitions("block", "id").write.partitionBy("block").parquet(f"{folder}/texts")
    texts = spark.read.schema("id long, text string, block long").parquet(f"{folder}/texts")
    postings = _postings(texts.select("block", "id", "text").repartition("block").sortWithinPartitions("block")).withColumn("bucket", _bucket())
    postings.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/postings")
    counted = postings_of(spark, folder).groupBy("bucket", "gram").agg(F.sum(F.size("ids").cast("long")).alias("n"))
    counted.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/grams")


def postings_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("gram long, block long, ids array<long>, bucket int").parquet(f"{folder}/postings")


def pieces(pattern: str, escape: str = "\\") -> list[str]:
    """The literal parts of a LIKE pattern."""
    sign = re.escape(escape)
    parts = re.findall(rf"(?:{sign}.|[^%_{sign}])+", pattern, re.S)
    return [re.sub(rf"{sign}(.)", r"\1", p, flags=re.S) for p in parts]


def _rarest(spark: SparkSession, folder: str, wanted: list[int]) -> list[int] | None:
    """The rarest of a pattern's grams (a few numbers, whatever the texts); None if one of them is in no text."""
    grams = spark.read.schema("gram long, n long, bucket int").parquet(f"{folder}/grams")
    found = {r["gram"]: r["n"] for r in _of_grams(spark, grams, wanted).collect()}
    return sorted(found, key=found.get)[:RAREST] if len(found) == len(wanted) else None


def _of_grams(spark: SparkSession, rows: DataFrame, wanted: list[int]) -> DataFrame:
    """Rows of some grams, by filters that reach the folders and the file scan."""
    buckets = spark.createDataFrame([(g,) for g in wanted], "gram long").select(_bucket().alias("b")).distinct().collect()
    return rows.filter(F.col("bucket").isin([r["b"] for r in buckets]) & F.col("gram").isin(wanted))


def like(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """id, text of the texts that are LIKE the pattern. Without three literal signs in a row the index is no help, and all texts are tested."""
    texts = spark.read.schema("id long, text string, block long").parquet(f"{folder}/texts")
    test = F.col("text").like(pattern)
    wanted = sorted({int(g) for p in pieces(pattern) for g in grams_of(p)})
    if not wanted:
        return texts.filter(test).select("id", "text")
    rare = _rarest(spark, folder, wanted)
    if rare is None:
        return texts.limit(0).select("id", "text")
    each = _of_grams(spark, postings_of(spark, folder), rare).select("block", "gram", F.explode("ids").alias("id")).distinct()
    candidates = cut(each.groupBy("block", "id").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select("block", "id"))
    # Up to MOST_BLOCKS folders of texts are named, so that others are not opened; a pattern that is in more of them reads most texts anyway.
    blocks = [r["block"] for r in candidates.select("block").distinct().limit(MOST_BLOCKS + 1).collect()]
    if len(blocks) <= MOST_BLOCKS:
        texts = texts.filter(F.col("block").isin(blocks))
    return texts.join(candidates, ["block", "id"], "left_semi").filter(test).select("id", "text")
