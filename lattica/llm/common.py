"""What the operators share: tables, checkpoints, folds and text as bytes."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, shared_folder

__all__ = ["as_bytes", "batch_of", "cut", "fold", "settled", "slices", "table", "table_in_shared_folder", "text_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, n: int = 5) -> Column:
    """crc32 of the id as text, modulo n; a null id is in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def text_bytes(column: str = "text") -> Column:
    """The text in UTF-8; a null text is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def as_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).to_pylist()]


def batch_of(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def slices(batch: pa.RecordBatch, name: str, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose binary column has about `most` bytes, one row at least."""
    column = batch.column(name)
    ends = np.cumsum(np.asarray([len(x) if x is not None else 0 for x in (v.as_buffer() for v in column)], dtype=np.int64)) if len(column) else []
    start = 0
    while start < len(column):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


#: Whether Spark removes what a query shuffled as soon as it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table_in_shared_folder(df: DataFrame, tidy: bool = False) -> DataFrame:
    """The rows written as Parquet in the folder that all machines share, and read again: later readers take only the columns they need.

    Like checkpoints, the files are left to whoever keeps that folder. tidy: what writing shuffled is removed at once, not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark.sparkContext)}/lattica-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    try:
        if tidy:
            spark.conf.set(TIDY, "true")
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """The rows with no lineage behind them, as cut() gives, and no shuffle either: a checkpoint's stays until the driver collects garbage, three files for each task and exchange."""
    return table_in_shared_folder(df, tidy=True)
