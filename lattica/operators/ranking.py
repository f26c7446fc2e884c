"""Running sums and numbers in an order, where a group may be larger than a task.

Groups are counted first. Where none has more than LARGE rows, a window over each does. Else rows are sorted
over all tasks by group and order, each task sums up its own part of a group, and what lies before that part
comes from the sums of earlier tasks: one row for each task and group. One order over all rows always goes
the second way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Rows of a group that one task sorts.
LARGE = 1_000_000


def running_sum(rows: DataFrame, by: Sequence[str], order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """rows with the sum of `weight` (whole numbers) over the group's rows up to and with their own.

    order: values, the least first and nulls before all; rows equal in them come in any order. A null in `by` is a group like others.
    """
    if by and rows.groupBy(*by).count().filter(F.col("count") > LARGE).isEmpty():
        return rows.withColumn(name, F.sum(weight.cast("long")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    own, ways = [f"_rank_by{i}" for i in range(len(by))], [f"_rank_order{i}" for i in range(len(order))]
    values = {o: F.col(c) for o, c in zip(own, by, strict=True)} | dict(zip(ways, order, strict=True)) | {"_rank_weight": weight.cast("long"), "_rank_tie": F.xxhash64(F.monotonically_increasing_id())}
    # By the tie, rows that are equal in group and order can be parted too.
    placed = cut(rows.withColumns(values).repartitionByRange(*own, *ways, "_rank_tie").withColumn("_rank_part", F.spark_partition_id()))
    window = Window.partitionBy("_rank_part", *own).orderBy(*ways, "_rank_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_rank_sum", F.sum("_rank_weight").over(window))
    sums = placed.groupBy("_rank_part", *own).agg(F.sum("_rank_weight").alias("_rank_all"))
    earlier = Window.partitionBy(*own).orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_rank_part").alias("_rank_at"), *(F.col(c).alias(f"{c}_") for c in own), F.coalesce(F.sum("_rank_all").over(earlier), F.lit(0)).alias("_rank_before"))
    same = F.col("_rank_part") == F.col("_rank_at")
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return local.join(before, same).select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_rank_sum") + F.col("_rank_before")).alias(name))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """rows with their number in the group, from 1."""
    return running_sum(rows, by, order, F.lit(1), name)
