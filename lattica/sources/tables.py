"""Reading and writing tables, and capturing payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.catalog import catalog, schema_of


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resource_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the catalogue from Parquet, under its declared schema."""
    return spark.read.schema(schema_of(catalog()[name])).parquet(f"{root}/{name}")


def register(spark: SparkSession, root: str) -> list[str]:
    """Makes a namespace for each schema of the catalogue, and in it its tables, empty or from the folder `root`, under their declared columns; returns their names."""
    names = []
    for name, table in catalog().items():
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name.split('.')[0]} LOCATION '{root}/{name.split('.')[0]}.db'")
        spark.catalog.createTable(name, path=f"{root}/{name}", source="parquet", schema=schema_of(table))
        names.append(name)
    return names


def write_snapshot(rows: DataFrame, root: str, name: str, snapshot: str) -> None:
    """The rows as one snapshot of the table; others stay as they are."""
    rows.withColumn("snapshot", F.lit(snapshot)).write.partitionBy("snapshot").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{root}/{name}")


def assets(spark: SparkSession, path: str) -> DataFrame:
    """Binary files with their size and digest; the reader passes over files without bytes."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def captured(rows: DataFrame, payload: Column) -> DataFrame:
    return rows.withColumn("payload_hash", F.sha2(payload, 256))
