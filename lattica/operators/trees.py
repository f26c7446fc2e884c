"""Labelled trees: numbers by which descendants, ancestors and depth are comparisons, not walks.

A tour goes down and up every edge once. Each step knows the next one: down to a node's first child, else up again;
from there down to the next sibling, else up to the parent. The steps that are left from each one to the end are
counted by doubling, in two stages: each counts to the next ruler first, one step of SPARSE being one by its hash, so
that a few rounds do; then rulers are counted among themselves in the same way, in one task once they are few. So a
chain takes no more rounds than a bush of as many nodes. From these counts come the numbers of a node in pre- and post-order, and its depth.

Joins are sorted: a side that passes for small as it is shuffled, compressed, can be too large for the driver
once it is to be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.lineage import cut
from .ranking import numbered
from .temporal import spread


#: Of so many steps one is a ruler; steps that one task counts.
SPARSE, SMALL = 16, 200_000


def ranked(tour: DataFrame, level: int = 0) -> DataFrame:
    """step, steps, downs: both summed from each step to the end of its list (step, next, steps, downs). Steps on rings are left out."""
    count = tour.count()
    if count <= SMALL:
        return tour.repartition(1).mapInArrow(_walked, _ranks(tour)).select("step", "steps", "downs")
    ruler = lambda c: F.pmod(F.xxhash64(F.lit(level), c), F.lit(SPARSE)) == 0
    going = F.col("next").isNotNull() & ~ruler("next")
    for _ in range(count.bit_length()):
        # What has reached a ruler or the end is only looked up; the rest jumps.
        ahead = tour.filter(~ruler("step")).select(F.col("step").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"), F.col("downs").alias("_downs"))
        jumped = tour.filter(going).join(ahead.hint("merge"), "next").select("step", F.col("_next").alias("next"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("downs") + F.col("_downs")).alias("downs"))
        tour = cut(tour.filter(~going).unionByName(jumped))
        if tour.filter(going).isEmpty():
            break
    # Steps that still go on are on rings without a ruler.
    tour = tour.filter(~going)
    rulers = cut(ranked(tour.filter(ruler("step")), level + 1))
    known = rulers.select(F.col("step").alias("next"), F.col("steps").alias("_steps"), F.col("downs").alias("_downs"))
    rest = tour.filter(~ruler("step"))
    onward = rest.filter("next is not null").join(known.hint("merge"), "next").select("step", (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("downs") + F.col("_downs")).alias("downs"))
    return rulers.unionByName(rest.filter("next is null").select("step", "steps", "downs")).unionByName(onward)


def _ranks(tour: DataFrame) -> StructType:
    return StructType([tour.schema["step"], tour.schema["steps"], tour.schema["downs"]])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of whole lists, by doubling."""
    held = list(batches)
    if not held:
        return
    whole = pa.Table.from_batches(held)
    names = [[None if x is None else (x["up"], x["node"]) for x in whole[c].to_pylist()] for c in ("step", "next")]
    n, at = len(whole), {x: i for i, x in enumerate(names[0])}
    # Place n is the end, n + 1 what is not there.
    ahead = np.asarray([*(n if x is None else at.get(x, n + 1) for x in names[1]), n, n + 1])
    sums = np.zeros((2, n + 2), dtype=np.int64)
    sums[:, :n] = [whole[c].to_numpy() for c in ("steps", "downs")]
    for _ in range(n.bit_length()):
        sums, ahead = sums + sums[:, ahead], ahead[ahead]
    ended = ahead[:n] == n
    for step in whole.select(["step"]).append_column("steps", pa.array(sums[0, :n])).append_column("downs", pa.array(sums[1, :n])).filter(pa.array(ended)).to_batches():
        yield step


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, parent, pre, post, size, depth of every node of a forest; children in the order of their keys.

    edges (child, parent): each child has one parent. Nodes (node) without an edge above are roots, in the order of
    their keys; pre and post number all nodes of the forest, a subtree's from pre to pre + size - 1. Nodes that no root
    is above (of rings) get no row; edges to nodes that are not there make these roots.
    """
    links = edges.select("child", "parent").dropna().distinct()
    known = nodes.select(F.col("node").alias("child")).unionByName(links.select("child")).unionByName(links.select(F.col("parent").alias("child"))).filter("child is not null").distinct()
    up = cut(known.join(links, "child", "left"))
    # The roots are the children of a null above them; siblings are numbered without a task for each parent.
    placed = cut(numbered(up, ["parent"], [F.col("child")], "place"))
    sibling = placed.select(F.col("parent").alias("above"), (F.col("place") - 1).alias("before"), F.col("child").alias("next_child"))
    same = placed["parent"].eqNullSafe(sibling["above"]) & (placed["place"] == sibling["before"])
    first = placed.filter("place = 1 and parent is not null").select(F.col("parent").alias("owner"), F.col("child").alias("first_child"))
    around = placed.join(sibling.hint("merge"), same, "left").join(first.hint("merge"), placed["child"] == first["owner"], "left").select("child", "parent", "next_child", "first_child")
    # Steps are named by their node and a sign: 0 down to it, 1 up from it.
    step = lambda sign, c: F.when(c.isNotNull(), F.struct(F.lit(sign).alias("up"), c.alias("node")))
    down = around.select(step(0, F.col("child")).alias("step"), F.coalesce(step(0, F.col("first_child")), step(1, F.col("child"))).alias("next"))
    back = around.select(step(1, F.col("child")).alias("step"), F.coalesce(step(0, F.col("next_child")), step(1, F.col("parent"))).alias("next"))
    tour = cut(down.unionByName(back).withColumn("steps", F.lit(1).cast("long")).withColumn("downs", (1 - F.col("step.up")).cast("long")))
    done = cut(ranked(tour))
    total = done.agg(F.count_if(F.col("step.up") == 0)).first()[0]
    per = done.groupBy(F.col("step.node").alias("node")).agg(*(F.max(F.when(F.col("step.up") == k, F.col(c))).alias(f"{c}{k}") for k in (0, 1) for c in ("steps", "downs")))
    pre, post = total - F.col("downs0") + 1, total - (F.col("steps1") - F.col("downs1")) + 1
    size = F.floor((F.col("steps0") - F.col("steps1") + 1) / 2).cast("long")
    # Before a step down, `pre - 1` steps went down; those that went up are what is left of all steps before it.
    depth = (pre - 1) - (2 * F.lit(total) - F.col("steps0") - (pre - 1))
    numbers = per.select("node", pre.cast("long").alias("pre"), post.cast("long").alias("post"), size.alias("size"), depth.cast("int").alias("depth"))
    return numbers.join(up.select(F.col("child").alias("node"), "parent").hint("merge"), "node").select("node", "parent", "pre", "post", "size", "depth")


def below(labels: DataFrame, start: DataFrame) -> DataFrame:
    """start, node, distance: what lies below each node of start (column node): the numbers after its own, which have no gaps."""
    tops = start.select("node").distinct().join(labels, "node").filter("size > 1").select(F.col("node").alias("start"), F.col("depth").alias("_depth"), F.col("pre").alias("_pre"), "size")
    runs = spread(tops, F.col("_pre") + 1, F.col("_pre") + F.col("size") - 1, "pre").select("start", "_depth", "pre")
    return runs.join(labels.select("node", "depth", "pre").hint("merge"), "pre").select("start", "node", (F.col("depth") - F.col("_depth")).alias("distance"))


def is_above(a_pre, a_size, b_pre):
    """Whether a node with pre and size lies above another."""
    return (a_pre < b_pre) & (b_pre < a_pre + a_size)
