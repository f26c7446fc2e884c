"""Versions of a row: the latest, numbers, gaps, transitions, and values at a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given; state where nulls go."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "revision_no") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def gaps(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """keys, after, before: numbers that miss between two of a key."""
    before = F.lag(number).over(Window.partitionBy(*keys).orderBy(number))
    return rows.withColumn("_before", before).filter(F.col(number) - F.col("_before") > 1).select(*keys, F.col("_before").alias("after_no"), F.col(number).alias("before_no"))


def transitions(rows: DataFrame, keys: list[str], state: str, order: list[Column]) -> DataFrame:
    """rows with from_state: the state of the key's row before."""
    return rows.withColumn("from_state", F.lag(state).over(Window.partitionBy(*keys).orderBy(*order)))


def deltas(rows: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    return rows.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def state_at(changes: DataFrame, keys: list[str], at: str, moment, value: str, tie: str) -> DataFrame:
    """keys, value: the last one not later than the moment. An aggregate: nothing is sorted."""
    return changes.filter(F.col(at) <= moment).groupBy(*keys).agg(F.max_by(value, F.struct(at, tie)).alias(value))
