"""Sharding by histogram sort: shards of nearly equal bytes that follow the order of a key.

Rows are ordered by the checksum of their text, so that equal texts lie side by side, then by a
hash of the id; the lowest bits are a salt of the row's place, so that rows that are equal
throughout can still be parted. Boundaries between shards come from exact counts of the bytes below
candidate keys (splitters.find); each shard is cut into finer ranges the same way, and one exchange
brings each fine range together. A row's slot is the number of rows of its shard in earlier ranges,
known from the counts, plus its place in its range: no task holds a whole shard. Where a boundary would part
rows of one text, it is moved to the text's edge if that costs no more than EDGE of a shard; larger groups of
copies are parted, since sizes near equal are the law.

Defined results: a null text has size 16 and the checksum of no bytes; a null id is ordered as
'null'; repeated rows are placed one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import splitters
from .common import cut, text_bytes

SHARDS, ROW_BYTES = 40, 16
#: How far a shard's boundary may be off, as a part of a shard; and that of the finer ranges, of one of them.
TOLERANCE, FINE_TOLERANCE = 0.001, 0.25
#: How far off a boundary may be for the sake of a group of equal texts, as a part of a shard.
EDGE = 0.01
#: Bits of a key below the text's checksum.
_BELOW_TEXT = 31


def sort_key() -> Column:
    """32 bits of the text's checksum, 20 of the id's hash, 11 of the row's place; never negative."""
    low = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(1 << 20))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 11))
    return F.shiftleft(F.col("text_crc32"), _BELOW_TEXT) + F.shiftleft(low, 11) + salt


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key: the narrow rows that boundaries are found on."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("bytes")).select(
        "doc_id", (F.octet_length("bytes") + ROW_BYTES).cast("long").alias("size"), F.crc32("bytes").cast("long").alias("text_crc32")
    )
    return rows.withColumn("key", sort_key())


def at_edges(rows: DataFrame, ranges: splitters.Ranges, per: int) -> splitters.Ranges:
    """The ranges, `per` of them a shard, with boundaries of shards moved to where a text's rows begin or end; finer ranges stay between them."""
    own = np.arange(per - 1, len(ranges.bounds), per)
    low = ranges.bounds[own] >> _BELOW_TEXT << _BELOW_TEXT
    high = low + ((1 << _BELOW_TEXT) - 1) + 1 * (low < np.iinfo(np.int64).max - (1 << _BELOW_TEXT))
    edges = np.unique(np.concatenate([low, high]))
    if not len(edges):
        return ranges
    weight, n = splitters.below(rows, edges)
    shard = ranges.total_weight / (len(own) + 1)
    bounds, weights, counts = ranges.bounds.copy(), ranges.weight.copy(), ranges.rows.copy()
    for i, at in enumerate(own):
        off, edge = min((abs(int(weight[k]) - shard * (i + 1)), int(k)) for k in np.searchsorted(edges, [low[i], high[i]]))
        if off <= EDGE * shard:
            bounds[at], weights[at], counts[at] = edges[edge], weight[edge], n[edge]
    for values in (bounds, weights, counts):
        ends = values[own]
        for i in range(len(own) + 1):
            fine = slice(i * per, i * per + per - 1)
            values[fine] = np.clip(values[fine], ends[i - 1] if i else None, ends[i] if i < len(own) else None)
    return replace(ranges, bounds=bounds, weight=weights, rows=counts)


def by_bytes(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """rows (with key and size, cheap to read again) with shard and slot."""
    spark = rows.sparkSession
    per = max(2, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    tolerance = np.full(shards * per - 1, FINE_TOLERANCE)
    tolerance[per - 1 :: per] = TOLERANCE * per
    weights = rows.select("key", F.col("size").alias("weight"))
    ranges = at_edges(weights, splitters.find(weights, shards * per, tolerance), per)
    bounds = spark.sparkContext.broadcast(ranges.bounds)
    starts = ranges.starts("rows")
    first = np.arange(len(starts)) // per * per  # the range that a range's shard begins with
    before = spark.sparkContext.broadcast(starts - starts[first])

    @F.pandas_udf("int")
    def fine(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, keys.to_numpy(), side="right").astype(np.int32))

    @F.pandas_udf("long")
    def skipped(at: pd.Series) -> pd.Series:
        return pd.Series(before.value[at.to_numpy()])

    placed = rows.withColumn("fine", fine("key"))
    place = F.row_number().over(Window.partitionBy("fine").orderBy("key", "doc_id", "size")) - 1
    placed = placed.withColumn("place", place).withColumn("slot", skipped("fine") + F.col("place"))
    return placed.withColumn("shard", F.floor(F.col("fine") / per).cast("int")).drop("fine", "place")


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    rows = by_bytes(cut(digests(documents)), shards)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
