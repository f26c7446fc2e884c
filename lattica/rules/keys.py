"""Unique keys and references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model.defs import Reference, Unique


def repeated(rows: DataFrame, key: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Key values that occur more than once, with n. Rows with a null in the key are never equal to others."""
    kept = rows if where is None else rows.filter(where)
    named = kept.select(*(c.alias(name) for name, c in key.items())).dropna()
    return named.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def repeated_of(rows: DataFrame, unique: Unique) -> DataFrame:
    return repeated(rows, {f"k{i}": F.expr(k) for i, k in enumerate(unique.key)}, F.expr(unique.where) if unique.where else None)


def dangling(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference is set and points to no parent."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti").select(*child.columns)


def dangling_count(child: DataFrame, column: str, parent: DataFrame, key: str, name: str) -> DataFrame:
    """reference, checked, dangling: one row."""
    marked = child.filter(F.col(column).isNotNull()).select(column).join(parent.select(F.col(key).alias(column)).distinct().withColumn("found", F.lit(True)), column, "left")
    return marked.agg(F.count("*").alias("checked"), F.count_if(F.col("found").isNull()).alias("dangling")).select(F.lit(name).alias("reference"), "checked", "dangling")


def dangling_of(tables: dict[str, DataFrame], reference: Reference, key: str) -> DataFrame:
    return dangling(tables[reference.table], reference.column, tables[reference.target], key)
