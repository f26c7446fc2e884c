"""The import ledger as a stream: each batch of records once, each record once within the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def records(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def once(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Records whose keys have not been seen within the delay; state older than that is dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def sightings(stream: DataFrame, keys: list[str], at: str, delay: str, window: str) -> DataFrame:
    """First and last moment and count of each key in tumbling windows."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, window), *keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"), F.count("*").alias("n"))


def ledger(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Every batch handed to `write` with its number; write must overwrite what it has written for that number before."""
    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def updates(folder: str) -> Callable[[DataFrame, int], None]:
    """A writer for streams of updates: each batch in a folder of its number, so that a repeated one changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def newest(spark: SparkSession, folder: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The last update of each key."""
    rows = spark.read.schema(StructType([*schema.fields]).add("batch", "long")).parquet(folder)
    last = F.max(F.struct("batch", *(c for c in schema.names if c not in keys))).alias("_last")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_last.{c}") for c in schema.names if c not in keys))
