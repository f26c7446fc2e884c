"""Boxes and geometries that meet, by cells of a tree of squares.

A box belongs to the level whose cells are just larger than it, and lies in four of them at most, whatever its
size. Two boxes that meet share a cell of the coarser one's level; so a box is also looked for on the coarser
levels that the other side has boxes on: four rows for each at most. A pair is given by one cell only, that of the
corner where both begin. A cell of very many pairs is dealt into parts.

Parts of geometries are dealt by their cells too, many cells to a bucket, and meet within it in NumPy: no row is
formed for a pair but where the geometries themselves share a point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ..functions.geo import Sides, boxes_meet, pieces, runs
from ..plans.lineage import cut

SIDES = ("west", "south", "east", "north")
#: Levels of halving from the whole extent down.
LEVELS = 24
#: Pairs of a cell that one part is to test.
PAIRS = 5_000_000
#: Parts of geometries (one of many points counts for one more each POINTS) that a block of a crowded cell holds of a side, and that a bucket is to hold.
BLOCK = 1024
POINTS = 8
HELD = 16_384
#: Pairs that are compared at once, pairs that a task is to compare, and tasks at most.
AT_ONCE = 1 << 16
OF_A_TASK = 5_000_000
MOST_TASKS = 10_000


def _cells(level: Column, extent: tuple[float, float, float], box: str) -> Column:
    """The cells (x, y) of a level that a box lies in."""
    x0, y0, size = extent
    step = F.lit(size) / F.pow(F.lit(2.0), level)
    at = lambda side, start: F.floor((F.col(f"{box}.{side}") - F.lit(start)) / step)
    xs, ys = F.sequence(at("west", x0), at("east", x0)), F.sequence(at("south", y0), at("north", y0))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _by_cells(left: DataFrame, right: DataFrame) -> tuple[tuple[float, float, float], list[tuple[DataFrame, DataFrame]]] | None:
    """The extent, and rows (level, x, y, own, row): those of left in the cells of their own level beside those of right that are no coarser, then those of right beside those of left that are finer. None where no row of either side has a sound box."""
    sound = F.expr("west <= east and south <= north and not isnan(cast(east as double)) and not isnan(cast(north as double))")
    a, b = (d.filter(sound).select(F.struct(*d.columns).alias("row")) for d in (left, right))
    sides = [d.select(*(F.col(f"row.{s}").cast("double").alias(s) for s in SIDES)) for d in (a, b)]
    ends = sides[0].unionByName(sides[1]).agg(*(F.min(s).alias(s) for s in SIDES[:2]), *(F.max(s).alias(s) for s in SIDES[2:])).first()
    if ends["west"] is None:
        return None
    size = max(ends["east"] - ends["west"], ends["north"] - ends["south"]) or 1.0
    extent = (ends["west"], ends["south"], size * (1 + 1e-9))
    wide = F.greatest(F.col("row.east") - F.col("row.west"), F.col("row.north") - F.col("row.south")).cast("double")
    # The finest level whose cells are no smaller than the box.
    own = F.when(wide > 0, F.least(F.floor(F.log2(F.lit(extent[2]) / wide)), F.lit(LEVELS))).otherwise(LEVELS).cast("int")
    a, b = (d.withColumn("own", F.greatest(own, F.lit(0))) for d in (a, b))
    levels = [sorted(r["own"] for r in d.select("own").distinct().collect()) for d in (a, b)]  # LEVELS + 1 numbers at most

    def at_levels(d: DataFrame, level: Column) -> DataFrame:
        cells = d.select("own", "row", level.alias("level")).withColumn("cell", F.explode(_cells(F.col("level"), extent, "row")))
        return cells.select("level", F.col("cell.x").alias("x"), F.col("cell.y").alias("y"), "own", "row")

    # Only the coarser box's own cells are looked in, so finer ones that are looked for there don't meet each other.
    out = []
    for one, two, asked, finer in ((a, b, levels[0], F.col("level") <= F.col("own")), (b, a, levels[1], F.col("level") < F.col("own"))):
        sought = F.explode(F.filter(F.lit(asked) if asked else F.array().cast("array<int>"), lambda x, y=finer: x <= F.col("own")))
        out.append((at_levels(one, F.col("own")), at_levels(two.select("row", "own", sought.alias("level")).filter(finer), F.col("level"))))
    return extent, out


def meeting(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns a and b: the rows of left and right whose boxes (columns west, south, east, north) share a point.

    Boxes with a missing side, or that end before they begin, meet nothing; points are boxes of no size.
    """
    found = _by_cells(left, right)
    if found is None:
        a, b = (d.select(F.struct(*d.columns).alias(n), F.lit(0).alias("k")).filter("false") for d, n in ((left, "a"), (right, "b")))
        return a.join(b, "k").drop("k")
    (west, south, size), ways = found
    step = F.lit(size) / F.pow(F.lit(2.0), F.col("level"))
    corner = [F.floor((F.greatest(F.col(f"a.{s}"), F.col(f"b.{s}")) - F.lit(at)) / step) for s, at in (("west", west), ("south", south))]
    meet = boxes_meet(tuple(F.col(f"a.{s}") for s in SIDES), tuple(F.col(f"b.{s}") for s in SIDES))
    pairs = [_in_parts(own, others, *names).filter(meet & (F.col("x") == corner[0]) & (F.col("y") == corner[1])).select("a", "b") for (own, others), names in zip(ways, ("ab", "ba"), strict=True)]
    return pairs[0].unionByName(pairs[1])


def _in_parts(own: DataFrame, others: DataFrame, first: str, second: str) -> DataFrame:
    """The rows (row) joined by their cell, under the names first and second. A cell of more than PAIRS pairs is dealt into parts: each of its larger side's rows lies in one, the smaller side's in all."""
    cell = ["level", "x", "y"]
    n = own.groupBy(*cell).agg(F.count("*").alias("n_own")).join(others.groupBy(*cell).agg(F.count("*").alias("n_others")), cell)
    parts = F.least(F.ceil(F.col("n_own") * F.col("n_others") / PAIRS), F.greatest("n_own", "n_others")).cast("int")
    heavy = cut(n.select(*cell, parts.alias("parts"), (F.col("n_own") > F.col("n_others")).alias("own_larger")).filter("parts > 1"))

    def dealt(d: DataFrame, larger: Column, name: str) -> DataFrame:
        some = d.join(heavy, cell, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        whole = F.array(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
        part = F.when(F.col("parts") == 1, F.array(F.lit(0))).when(larger, whole).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
        return some.withColumn("part", F.explode(part)).select(*cell, "part", F.col("row").alias(name))

    return dealt(own, F.col("own_larger"), first).join(dealt(others, ~F.col("own_larger"), second), [*cell, "part"])


def geometries_meeting(left: DataFrame, right: DataFrame | None, key: str, shape: str) -> DataFrame:
    """a, b: the keys of rows whose shapes (as of geo.wkb_shape) share a point: parts whose boxes meet are compared exactly. Without a right side, pairs a < b of the left."""

    def parts(d: DataFrame) -> DataFrame:
        points = F.aggregate("part.rings", F.lit(0), lambda n, ring: n + F.size(ring["xs"]))
        rows = d.select(F.col(key).alias("key"), F.explode(f"{shape}.parts").alias("part")).select("key", "part", *(F.col(f"part.{s}").alias(s) for s in SIDES))
        return cut(rows.withColumns({"weight": F.greatest(F.lit(1.0), points / POINTS), "number": F.monotonically_increasing_id()}))

    kinds = [d.schema[key].dataType for d in (left, left if right is None else right)]
    one = parts(left)
    found = _by_cells(one, one if right is None else parts(right))
    if found is None:
        return left.sparkSession.createDataFrame([], StructType([StructField(n, k) for n, k in zip("ab", kinds, strict=True)]))
    extent, ways = found
    if right is None:  # of parts that are both on a level the one of the smaller number is first
        pairs = _compared(*ways[0], extent, *kinds, alone=True)
        return pairs.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).filter("a < b").distinct()
    pairs = _compared(*ways[0], extent, *kinds).select(F.col("one").alias("a"), F.col("two").alias("b"))
    return pairs.unionByName(_compared(*ways[1], extent, *reversed(kinds)).select(F.col("two").alias("a"), F.col("one").alias("b"))).distinct()


def _compared(own: DataFrame, others: DataFrame, extent: tuple[float, float, float], kind: DataType, kind_of_others: DataType, alone: bool = False) -> DataFrame:
    """Columns one and two: keys of own and of others, of these kinds, that have a cell in common and parts there that share a point.

    Cells are dealt into buckets, crowded ones in blocks: each block of the one side meets each of the other. alone: both are the same parts, and those of one level are to meet once.
    """
    cell = ["level", "x", "y"]
    weigh = lambda d, name: d.groupBy(*cell).agg(F.sum("row.weight").alias(name))
    n = cut(weigh(own, "own_weight").join(weigh(others, "others_weight"), cell, "full_outer").fillna(0.0, ["own_weight", "others_weight"]))
    mine, theirs = F.col("own_weight"), F.col("others_weight")
    pairs, held = n.agg(F.coalesce(F.sum(mine * theirs), F.lit(0.0)), F.coalesce(F.sum(mine + theirs), F.lit(0.0))).first()
    heavy = n.filter((mine * theirs > BLOCK * BLOCK) | (mine + theirs > HELD))
    heavy = cut(heavy.select(*cell, *(F.greatest(F.lit(1), F.ceil(w / BLOCK)).cast("int").alias(f"{s}_blocks") for s, w in (("own", mine), ("others", theirs)))))
    # The exact test takes far longer than its bytes tell: a set number of tasks, so that few bytes aren't given to one.
    tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(pairs // OF_A_TASK), MOST_TASKS))
    buckets = max(8 * tasks, int(held // HELD))
    step = F.lit(extent[2]) / F.pow(F.lit(2.0), F.col("level"))
    west, south = ((F.col(c) == F.floor((F.col(f"row.{s}") - F.lit(at)) / step)).cast("int") for c, s, at in (("x", "west", extent[0]), ("y", "south", extent[1])))
    number = F.when(F.col("own") == F.col("level"), F.col("row.number")).otherwise((1 << 63) - 1)

    def dealt(d: DataFrame, mine: bool) -> DataFrame:
        of_own, of_others = (F.coalesce(f"{s}_blocks", F.lit(1)) for s in ("own", "others"))
        one, all_of_others = F.pmod(F.xxhash64("row.number"), (of_own if mine else of_others).cast("long")), F.sequence(F.lit(0).cast("long"), (of_others if mine else of_own).cast("long") - 1)
        blocks = F.transform(all_of_others, lambda other: one * (1 << 31) + other if mine else other * (1 << 31) + one)
        rows = d.join(heavy, cell, "left").withColumn("block", F.explode(blocks))
        key, none = F.col("row.key"), F.lit(None)
        return rows.select(
            ((F.col("level").cast("long") * (1 << 26) + F.col("x")) * (1 << 26) + F.col("y")).alias("cell"), "block", F.lit(mine).alias("mine"), (west + 2 * south).cast("tinyint").alias("begins"),
            (number if alone else F.lit(0 if mine else 1).cast("long")).alias("number"), (key if mine else none).cast(kind).alias("one"), (none if mine else key).cast(kind_of_others).alias("two"), "row.part",
        )

    rows = dealt(own, True).unionByName(dealt(others, False)).withColumn("bucket", F.pmod(F.xxhash64("cell", "block"), F.lit(buckets)).cast("int"))
    return rows.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_compare, StructType([StructField("one", kind), StructField("two", kind_of_others)]))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's rows as pairs of one and two: in each block of a cell its own parts (mine) with the others."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    west = rows["part"].combine_chunks().field("west").to_numpy()
    rows = rows.take(np.lexsort([west, ~rows["mine"].to_numpy(), rows["block"].to_numpy(), rows["cell"].to_numpy()])).combine_chunks()
    cell, block, mine, begins, number = (rows[c].to_numpy() for c in ("cell", "block", "mine", "begins", "number"))
    sides = Sides(rows["part"].combine_chunks())
    new = np.append(True, (cell[1:] != cell[:-1]) | (block[1:] != block[:-1]))
    group, (west, east) = np.cumsum(new) - 1, sides.box[0]
    own, others = np.flatnonzero(mine), np.flatnonzero(~mine)
    # Of the others, which lie from west to east, those that begin no further west of an own part than the widest of them reaches, up to its end.
    reach = np.maximum.reduceat(np.where(mine, 0.0, east - west), np.flatnonzero(new))[group[own]]
    low, high = (np.searchsorted(_ordered(group[others], west[others]), _ordered(group[own], to), side) for to, side in ((west[own] - reach - 1e-9 * (np.abs(west[own]) + reach), "left"), (east[own], "right")))
    n = np.maximum(high - low, 0)
    for some in pieces(n, AT_ONCE):
        i, j = runs(low[some], n[some])
        i, j = own[some][i], others[j]
        # One of both begins in this cell, from the west and from the south.
        keep = ((begins[i] | begins[j]) == 3) & (number[i] < number[j])
        i, j = i[keep], j[keep]
        hit = sides.meet(i, j)
        if hit.any():
            yield pa.RecordBatch.from_arrays([rows["one"].take(i[hit]).combine_chunks(), rows["two"].take(j[hit]).combine_chunks()], ["one", "two"])


def _ordered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Numbers that are in order by first, and then by second."""
    out = np.empty(len(first), dtype=complex)
    out.real, out.imag = first, second
    return out
