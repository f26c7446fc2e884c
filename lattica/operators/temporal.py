"""Validity intervals and facts in time. Intervals are closed; a missing end is open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .ranking import numbered, running_sum


def valid_at(start: Column, end: Column, at: Column) -> Column:
    return (start.isNull() | (start <= at)) & (end.isNull() | (at <= end))


#: Numbers that one row is spread over at a time.
RUN = 4096


def counted(spans: DataFrame, points: DataFrame) -> DataFrame:
    """spans (_entity, _row, _from, _to) with _low and _high: how many of their entity's points (_entity, _at, _n) lie before them, and until their end.

    A span's start comes before the points of its moment, its end after them; a missing start is before all, a
    missing end after. One running sum over both kinds of rows counts, however long an entity's history is.
    """
    kind = F.explode(F.array(F.lit(0), F.lit(2))).alias("_kind")
    ends = spans.select("_entity", "_row", "_from", "_to", kind).withColumn("_at", F.when(F.col("_kind") == 0, F.col("_from")).otherwise(F.col("_to")))
    both = ends.select("_entity", "_kind", "_at", "_row").unionByName(points.select("_entity", F.lit(1).alias("_kind"), "_at", F.lit(None).cast("long").alias("_row")))
    order = [F.when(F.col("_at").isNotNull(), 1).otherwise(F.col("_kind")), F.col("_at"), F.col("_kind")]
    seen = running_sum(both, ["_entity"], order, F.when(F.col("_kind") == 1, 1).otherwise(0), "_seen").filter("_kind != 1")
    limits = seen.groupBy("_row").agg(*(F.max(F.when(F.col("_kind") == k, F.col("_seen"))).alias(n) for k, n in ((0, "_low"), (2, "_high"))))
    return spans.join(limits, "_row")


def spread(rows: DataFrame, first: Column, last: Column, name: str) -> DataFrame:
    """A row for each number from first to last; long runs are dealt out in pieces."""
    pieces = rows.withColumn("_piece", F.explode(F.sequence(F.floor(first / RUN), F.floor(last / RUN))))
    low, high = F.greatest(first, F.col("_piece") * RUN), F.least(last, F.col("_piece") * RUN + RUN - 1)
    return pieces.withColumn(name, F.explode(F.sequence(low.cast("long"), high.cast("long")))).drop("_piece")


def covering(rows: DataFrame, entity: str, start: str, end: str, points: DataFrame, by: str, at: str) -> DataFrame:
    """Each of rows with each of the points of its entity that lies in it: columns span (of rows) and point (of points).

    An entity's points are numbered in time; those in an interval are a run of numbers, so nothing is formed but
    what is returned. Points without a moment or an entity lie nowhere; intervals that end before they start hold none.
    """
    whole = lambda side, names: F.struct(*(F.col(f"_{side}{i}").alias(n) for i, n in enumerate(names))).alias(side)
    flat = lambda side, names: [F.col(f"`{n}`").alias(f"_{side}{i}") for i, n in enumerate(names)]
    spans = rows.select(F.col(entity).alias("_entity"), F.col(start).alias("_from"), F.col(end).alias("_to"), *flat("span", rows.columns)).filter("_entity is not null")
    spans = cut(spans.withColumn("_row", F.monotonically_increasing_id()))
    known = points.select(F.col(by).alias("_entity"), F.col(at).alias("_at"), *flat("point", points.columns)).filter("_entity is not null and _at is not null")
    numbers = cut(numbered(known, ["_entity"], [F.col("_at")], "_n"))
    limits = counted(spans.select("_entity", "_row", "_from", "_to"), numbers).filter("_high > _low").select("_row", "_low", "_high")
    runs = spread(limits.join(spans.drop("_from", "_to"), "_row").drop("_row"), F.col("_low") + 1, F.col("_high"), "_n").drop("_low", "_high")
    return runs.join(numbers.drop("_at"), ["_entity", "_n"]).select(whole("span", rows.columns), whole("point", points.columns))


def overlapping(rows: DataFrame, entity: str, key: str, start: str, end: str) -> DataFrame:
    """entity, a, b (keys, a < b) of intervals of one entity that share a moment.

    An entity's intervals are numbered by their starts; those that begin while one lasts are a run of
    numbers after its own. So only pairs that overlap are formed, however many intervals an entity has.
    """
    spans = rows.select(F.col(entity).alias("_entity"), F.col(key).alias("_key"), F.col(start).alias("_from"), F.col(end).alias("_to")).filter("_entity is not null").withColumn("_row", F.monotonically_increasing_id())
    ends = spans.withColumn("_end", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_at", F.when(F.col("_end") == 1, F.col("_to")).otherwise(F.col("_from")))
    # A missing start is before all others, a missing end after; what ends when another begins still meets it.
    order = [F.when(F.col("_at").isNotNull(), 1).otherwise(2 * F.col("_end")), F.col("_at"), F.col("_end")]
    seen = cut(running_sum(ends, ["_entity"], order, 1 - F.col("_end"), "_n").drop("_at"))
    begun, ended = seen.filter("_end = 0"), seen.filter("_end = 1").select("_row", F.col("_n").alias("_last"))
    runs = spread(begun.join(ended, "_row").filter("_last > _n"), F.col("_n") + 1, F.col("_last"), "_next").drop("_n")
    other = begun.select("_entity", F.col("_n").alias("_next"), F.col("_key").alias("_other"), F.col("_to").alias("_other_to"))
    meet = F.col("_from").isNull() | F.col("_other_to").isNull() | (F.col("_from") <= F.col("_other_to"))
    pairs = runs.join(other, ["_entity", "_next"]).filter(meet & (F.col("_key") != F.col("_other")))
    return pairs.select(F.col("_entity").alias(entity), F.least("_key", "_other").alias("a"), F.greatest("_key", "_other").alias("b"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, value: str, tie: str) -> DataFrame:
    """left with the latest right value at or before its moment.

    Both sides go through one window over the entity, ordered by time, so no pair of rows is ever
    formed: an entity with n and m rows costs their sum. Of equal moments the largest tie counts.
    """
    names = left.columns
    a = left.select(F.col(by).alias("_by"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[tie].dataType).alias("_tie"), F.lit(None).cast(right.schema[value].dataType).alias("_value"), F.struct(*names).alias("_row"))
    b = right.select(F.col(by).alias("_by"), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(tie).alias("_tie"), F.col(value).alias("_value"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy("_by").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("_side") == 0, F.struct("_value", "_at")), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("_seen", seen).filter("_side = 1").select("_row.*", F.col("_seen._value").alias(f"as_of_{value}"), F.col("_seen._at").alias(f"as_of_{right_at}"))


def closed_by_next(rows: DataFrame, entity: str, start: str, tie: str) -> DataFrame:
    """rows with implied_end: the start of the entity's next row."""
    return rows.withColumn("implied_end", F.lead(start).over(Window.partitionBy(entity).orderBy(start, tie)))


def islands(rows: DataFrame, entity: str, start: str, end: str) -> DataFrame:
    """entity, island_start, island_end, n_rows: intervals of an entity that overlap or touch, as one.

    Intervals without a start come last and belong to the entity's last island; where no end is known yet, an island of its own begins.
    """
    w = Window.partitionBy(entity).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    marked = rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(entity, "_island").agg(F.min(start).alias("island_start"), F.max(end).alias("island_end"), F.count("*").alias("n_rows")).drop("_island")


def moments(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone; the session's zone must be UTC."""
    return F.unix_micros(c.cast("timestamp"))
