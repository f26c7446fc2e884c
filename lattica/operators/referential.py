"""What deleting rows does to the rows that refer to them: cascade, restrict, set null; as plans, nothing is deleted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model.defs import Reference


@dataclass(frozen=True)
class Deletion:
    """doomed: keys by table that the cascade takes; blocked: by reference, doomed keys that rows which stay refer to; cleared: by reference, keys of rows whose reference becomes null."""

    doomed: dict[str, DataFrame]
    blocked: dict[Reference, DataFrame]
    cleared: dict[Reference, DataFrame]


def plan(tables: dict[str, DataFrame], keys: dict[str, str], references: list[Reference], start: str, gone: DataFrame) -> Deletion:
    """gone: keys (one column) of rows of table `start`. keys: the key column of each table.

    The cascade is followed to its end before restrictions are looked at, over all that it takes. Tables
    that cascade in a circle would never end and are refused.
    """
    doomed = {start: gone.select(F.col(gone.columns[0]).alias("key")).distinct()}
    order, at = [start], 0
    while at < len(order):
        for r in references:
            if r.target == order[at] and r.action == "C":
                if r.table in order[: at + 1]:
                    raise ValueError(f"{r.table} cascades in a circle")
                own = tables[r.table].join(doomed[r.target].select(F.col("key").alias(r.column)), r.column, "left_semi").select(F.col(keys[r.table]).alias("key"))
                doomed[r.table] = own if r.table not in doomed else doomed[r.table].unionByName(own).distinct()
                if r.table not in order:
                    order.append(r.table)
        at += 1
    blocked, cleared = {}, {}
    for r in references:
        if r.target in doomed and r.action in "RN":
            rows = tables[r.table].select(F.col(keys[r.table]).alias("child"), F.col(r.column).alias("key")).join(doomed[r.target], "key", "left_semi")
            if r.table in doomed:
                rows = rows.join(doomed[r.table].select(F.col("key").alias("child")), "child", "left_anti")
            if r.action == "R":
                blocked[r] = rows.select("key").distinct()
            else:
                cleared[r] = rows.select(F.col("child").alias("key"))
    return Deletion(doomed, blocked, cleared)


def null_where_gone(child: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """child with the reference made null where its target goes."""
    hit = gone.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    return child.join(hit, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*child.columns)
