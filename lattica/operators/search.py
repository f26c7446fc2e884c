"""Fuzzy text search by trigrams, and boxes by cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORDS, similarity, trigrams
from ..plans.lineage import cut


def codes(grams: Column) -> Column:
    """Trigrams as numbers, 21 bits a sign: sets of them are compared faster than sets of strings."""
    sign = lambda g, i: F.ascii(F.substring(g, F.lit(i), F.lit(1))).cast("long")
    return F.transform(grams, lambda g: F.shiftleft(sign(g, 1), 42) + F.shiftleft(sign(g, 2), 21) + sign(g, 3))


def rarest(rows: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """k, h, n, t, at: of each row (k, h, g) the rarest of its n trigrams, n - ceil(least * n) + 1 of them, numbered from 0.

    Rows of similarity `least` share at least least * n of either's trigrams. With all trigrams in one
    order, those of each without its last ceil(least * n) - 1 then have one in common.
    """
    n = F.size("g")
    each = rows.select("k", "h", n.alias("n"), F.explode("g").alias("t")).join(counts, "t")
    kept = F.col("n") - F.greatest(F.ceil(F.col("n") * least - 1e-9), F.lit(1)).cast("int") + 1
    ordered = each.groupBy("k", "h", "n").agg(F.sort_array(F.collect_list(F.struct("rows", "t"))).alias("ts"))
    return ordered.select("k", "h", "n", F.posexplode(F.slice("ts", F.lit(1), kept)).alias("at", "x")).select("k", "h", "n", F.col("x.t").alias("t"), "at")


def similar(left: DataFrame, left_key: str, left_text: str, right: DataFrame | None = None, right_key: str | None = None, right_text: str | None = None, least: float = 0.3, separators: str = WORDS) -> DataFrame:
    """left_key, right_key, similarity of texts that share trigrams enough: rows meet by their rarest trigrams, and are then compared whole.

    Rows that meet go on only if their sizes, and what is left of both after the place where they meet, can still
    reach the likeness; a pair that meets several times must pass at the first. Without a right side the left is
    compared with itself: trigrams are counted and ordered once, and of two rows that with the smaller key is on the
    left; the keys are then named a_ and b_.
    """
    alone = right is None

    def prepared(df: DataFrame, key: str, text: str) -> DataFrame:
        return cut(df.select(F.col(key).alias("k"), codes(trigrams(F.col(text), separators)).alias("g")).filter(F.size("g") > 0).withColumn("h", F.xxhash64(F.array_sort("g"))).dropDuplicates(["k", "h"]))

    a = prepared(left, left_key, left_text)
    b = a if alone else prepared(right, right_key, right_text)
    counts = (a if alone else a.unionByName(b)).select(F.explode("g").alias("t")).groupBy("t").agg(F.count("*").alias("rows"))
    x = cut(rarest(a, counts, least))
    y = x if alone else cut(rarest(b, counts, least))
    x, y = (d.select("t", *(F.col(c).alias(f"{side}{c}") for c in ("k", "h", "n", "at"))) for d, side in ((x, "l"), (y, "r")))
    needed = F.col("least") * (F.col("ln") + F.col("rn")) / (1 + F.col("least"))  # shared trigrams of two sets that are just alike
    reach = F.least(F.col("ln") - F.col("lat"), F.col("rn") - F.col("rat"))
    fits = (F.col("ln") >= F.col("least") * F.col("rn") - 1e-9) & (F.col("rn") >= F.col("least") * F.col("ln") - 1e-9) & (reach >= needed - 1e-9)
    meet = x.withColumn("least", F.lit(least)).join(y, "t").filter(fits)
    pairs = (meet.filter("lk < rk") if alone else meet).select("lk", "lh", "rk", "rh").distinct()
    one, two = (d.select(F.col("k").alias(f"_{side}"), F.col("h").alias(f"_{side}h"), F.col("g").alias(f"{side}g")) for d, side in ((a, "l"), (b, "r")))
    whole = pairs.join(one, F.col("lk").eqNullSafe(F.col("_l")) & (F.col("lh") == F.col("_lh"))).join(two, F.col("rk").eqNullSafe(F.col("_r")) & (F.col("rh") == F.col("_rh")))
    names = ("a_" + left_key, "b_" + left_key) if alone else (left_key, right_key)
    return whole.select(F.col("lk").alias(names[0]), F.col("rk").alias(names[1]), similarity(F.col("lg"), F.col("rg")).alias("similarity")).filter(F.col("similarity") >= least)


def in_cells(points: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """points with the cell that each lies in, to join by and then test exactly."""
    return points.withColumn("cell_x", F.floor(x / size)).withColumn("cell_y", F.floor(y / size))


def points_in_boxes(points: DataFrame, x: str, y: str, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs of points and boxes (west, south, east, north) that hold them: an equi-join by cell, then the exact test."""
    cells = boxes.withColumn("cell_x", F.explode(F.sequence(F.floor(F.col("west") / size), F.floor(F.col("east") / size))))
    cells = cells.withColumn("cell_y", F.explode(F.sequence(F.floor(F.col("south") / size), F.floor(F.col("north") / size))))
    near = in_cells(points, F.col(x), F.col(y), size).join(cells, ["cell_x", "cell_y"])
    return near.filter(F.col(x).between(F.col("west"), F.col("east")) & F.col(y).between(F.col("south"), F.col("north"))).drop("cell_x", "cell_y")
