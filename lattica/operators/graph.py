"""Trees, chains and provenance graphs, by doubling: paths of length up to 2n are joins of paths of length up to n.

A chain of depth d takes log2(d) joins. Lineage is cut after each, so plans stay small.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def closure(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """child, ancestor, distance: everything reachable from a child over edges (child, parent), by its shortest way.

    Cycles end by themselves, since a pair is kept once; a node in one reaches itself.
    """
    paths = cut(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    for _ in range(most_rounds):
        step = paths.alias("a").join(paths.alias("b"), F.col("a.ancestor") == F.col("b.child"))
        step = step.select(F.col("a.child").alias("child"), F.col("b.ancestor").alias("ancestor"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        longer = cut(paths.unionByName(step).groupBy("child", "ancestor").agg(F.min("distance").alias("distance")))
        if longer.count() == paths.count():
            return longer
        paths = longer
    raise RuntimeError(f"paths still grow after {most_rounds} rounds")


#: Rounds of doubling after which paths are looked at for rings.
DEEP = 10


def ancestor_paths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, path (root first, the node last, joined by '/'), depth, for a forest.

    A node has the way up to one above it, and takes on that one's way: each round doubles it, with one row for a node. Nodes that no root is above (of rings) get no row.
    """
    links = edges.select("child", "parent").dropna().filter("child != parent").distinct()
    known = nodes.select("node").unionByName(links.select(F.col("child").alias("node"))).unionByName(links.select(F.col("parent").alias("node"))).dropna().distinct()
    going = known.join(links.withColumnRenamed("child", "node").hint("merge"), "node", "left")
    # The way starts below the node's own name: `way` has those above it from `above` on, which leads it.
    up = cut(going.select("node", F.col("parent").alias("above"), F.when(F.col("parent").isNull(), F.array().cast(f"array<{going.schema['node'].dataType.simpleString()}>")).otherwise(F.array("parent")).alias("way")))
    rounds = 0
    while not (moving := up.filter("above is not null")).isEmpty():
        if rounds == DEEP:  # ways along rings would double for ever
            up = cut(up.join(below_roots(links, up.filter("above is null").select("node")), "node", "left_semi"))
            moving = up.filter("above is not null")
        ahead = up.select(F.col("node").alias("above"), F.col("above").alias("_above"), F.col("way").alias("_way"))
        up = cut(up.filter("above is null").unionByName(moving.join(ahead.hint("merge"), "above").select("node", F.col("_above").alias("above"), F.concat("_way", "way").alias("way"))))
        rounds += 1
    own = F.array(F.col("node").cast("string"))
    return nodes.join(up.hint("merge"), "node").select("node", F.array_join(F.concat(F.transform("way", lambda x: x.cast("string")), own), "/").alias("path"), F.size("way").alias("depth"))


def descendants(edges: DataFrame, start: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """node, distance: what lies below the nodes of start (column node), level by level; nothing else of the forest is touched."""
    level = cut(start.select("node").distinct())
    known, found, distance = level, None, 0
    while distance < most_rounds:
        distance += 1
        below = edges.join(level.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node")).distinct()
        level = cut(below.join(known if found is None else found, "node", "left_anti"))
        reached = level.withColumn("distance", F.lit(distance))
        found = reached if found is None else found.unionByName(reached)
        if level.isEmpty():
            return found
    raise RuntimeError(f"still deeper after {most_rounds} levels")


def below_roots(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node: the roots, and what leads to one of them over edges (child, parent).

    Jumps double: after k rounds they span 2**k edges, and all nodes nearer to a root are known. Where
    each child has one parent there are never more jumps than edges.
    """
    jumps, linked = cut(edges.select("child", "parent").distinct()), cut(roots.select("node").distinct())
    while True:
        new = jumps.join(linked.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"))
        more = cut(linked.unionByName(new).distinct())
        if more.count() == linked.count():
            return more
        linked = more
        further = jumps.withColumnRenamed("parent", "via").join(jumps.select(F.col("child").alias("via"), "parent"), "via")
        jumps = cut(further.select("child", "parent").distinct())


def heads(rows: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no other row supersedes."""
    return rows.join(rows.select(F.col(supersedes).alias(key)).dropna(), key, "left_anti")


def on_cycles(edges: DataFrame) -> DataFrame:
    """node, cycle_length: nodes that reach themselves, with the shortest way round.

    Where each child has one parent, jumps double until they are longer than any way: where they end lies
    on cycles, and the smallest node that a jump passes names the cycle. Else the components of the graph are
    found first, and ways are followed within those only.
    """
    edges = cut(edges.select("child", "parent").dropna().distinct())
    if not edges.groupBy("child").count().filter("count > 1").isEmpty():
        members = cut(strong_components(edges))
        own = edges.join(members.withColumnRenamed("node", "child"), "child").join(members.select(F.col("node").alias("parent"), F.col("component").alias("_c")), "parent").filter("component = _c")
        return closure(own.select("child", "parent")).filter("child = ancestor").select(F.col("child").alias("node"), F.col("distance").alias("cycle_length"))
    jumps, n, span = edges.withColumn("least", F.col("parent")), edges.count(), 1
    while span <= n:
        onward = jumps.select(F.col("child").alias("via"), "parent", F.col("least").alias("onward"))
        jumps = cut(jumps.withColumnRenamed("parent", "via").join(onward, "via").select("child", "parent", F.least("least", "onward").alias("least")))
        span *= 2
    ends = jumps.select(F.col("parent").alias("child")).distinct()
    named = jumps.join(ends, "child").select(F.col("child").alias("node"), "least")
    return named.join(named.groupBy("least").agg(F.count("*").cast("int").alias("cycle_length")), "least").select("node", "cycle_length")


def _spread_least(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after every node has taken the least label of those that reach it over edges (a, b); only labels that changed go on."""
    fresh = labels
    while True:
        offered = edges.join(fresh.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("offer"))
        joined = cut(labels.join(offered, "node", "left").select("node", F.least("label", "offer").alias("label"), (F.col("offer") < F.col("label")).alias("moved")))
        fresh, labels = joined.filter("moved").select("node", "label"), joined.select("node", "label")
        if fresh.isEmpty():
            return labels


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """edges (a, b) without nodes that have one way in and one out; (node, head, tail) of those, and (node, component) of those on rings of nothing else. By doubling."""
    only = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("before")).join(edges.groupBy(F.col("b").alias("node")).count().filter("count = 1").select("node"), "node")
    only = only.join(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("after"), F.count("*").alias("n")).filter("n = 1").drop("n"), "node")
    inner = cut(only.select("node", F.col("before").alias("head"), F.col("after").alias("tail"), F.least("node", "after").alias("least")))
    rounds = inner.count().bit_length() + 1
    keys = cut(inner.select("node"))
    for _ in range(rounds):
        ahead = inner.select(F.col("node").alias("tail"), F.col("tail").alias("_tail"), F.col("least").alias("_least"))
        back = inner.select(F.col("node").alias("head"), F.col("head").alias("_head"))
        inner = cut(inner.join(ahead, "tail", "left").join(back, "head", "left").select("node", F.coalesce("_head", "head").alias("head"), F.coalesce("_tail", "tail").alias("tail"), F.least("least", "_least").alias("least")))
        if inner.join(keys.withColumnRenamed("node", "tail"), "tail", "left_semi").isEmpty():
            break
    ring = inner.join(keys.withColumnRenamed("node", "tail"), "tail", "left_semi")
    rings = ring.select("node", F.col("least").alias("component"))
    chains = inner.join(ring.select("node"), "node", "left_anti").select("node", "head", "tail")
    direct = edges.join(keys.withColumnRenamed("node", "a"), "a", "left_anti").join(keys.withColumnRenamed("node", "b"), "b", "left_anti")
    return cut(direct.select("a", "b").unionByName(chains.select(F.col("head").alias("a"), F.col("tail").alias("b"))).distinct()), cut(chains), cut(rings)


#: Edges of a graph, or of what is left of one, whose components one task finds.
SMALL = 100_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node, component of a small edge table (a, b without loops): a walk that numbers nodes as they are met, and closes a component where no earlier number can be reached."""
    schema = pa.schema([("node", pa.int64()), ("component", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways: dict[int, list[int]] = {}
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                ways.setdefault(a, []).append(b)
        number: dict[int, int] = {}
        low: dict[int, int] = {}
        open_, out = [], []
        for start in ways:
            walk = [] if start in number else [(start, None)]
            while walk:
                node, rest = walk.pop()
                if rest is None:
                    number[node] = low[node] = len(number)
                    open_.append(node)
                    rest = iter(ways.get(node, ()))
                for b in rest:
                    if b not in number:
                        walk += [(node, rest), (b, None)]
                        break
                    if b in low:
                        low[node] = min(low[node], number[b])
                else:
                    if low[node] == number[node]:
                        at = len(open_) - 1
                        while open_[at] != node:
                            at -= 1
                        whole, open_[at:] = open_[at:], []
                        if len(whole) > 1:
                            out += [(n, min(whole)) for n in whole]
                        for n in whole:
                            del low[n]
                    if walk and node in low:
                        low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=pa.int64()) for i in (0, 1)], schema=schema)

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).repartition(1).mapInArrow(run, "node long, component long")


def strong_components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """node, component: the nodes that lie on cycles over edges (child, parent), with the least node among those that they reach and that reach them.

    Nodes that nothing leads to, or that lead nowhere, are trimmed; chains are made one edge, so a long ring costs
    log rounds. Then every node takes the least node that reaches it for its colour, and those of a colour that reach
    that node are its component; edges between colours are on no cycle and go. No round has more rows than edges.
    Once no more than SMALL edges are left, one task finds the rest. Nodes are longs.
    """
    own = edges.select(F.col("child").cast("long").alias("a"), F.col("parent").cast("long").alias("b")).dropna().distinct()
    loops = [own.filter("a = b").select(F.col("a").alias("node"))]
    rest, found, stack = cut(own.filter("a != b")), [], []
    for _ in range(most_rounds):
        if rest.count() <= SMALL:
            found.append(_in_one_task(rest))
            break
        before = None
        while before != (now := rest.count()) and now:
            before = now
            rest = cut(rest.join(rest.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(rest.select(F.col("a").alias("b")).distinct(), "b", "left_semi"))
            if now - rest.count() < 0.1 * now:  # the colours part what is left of chains in fewer rounds
                break
        if rest.isEmpty():
            break
        rest, chains, rings = _chains(rest)
        stack.append(chains)
        found.append(rings)
        loops.append(rest.filter("a = b").select(F.col("a").alias("node")))
        rest = cut(rest.filter("a != b"))
        if rest.count() <= SMALL:
            found.append(_in_one_task(rest))
            break
        nodes = rest.select(F.col("a").alias("node")).unionByName(rest.select(F.col("b").alias("node"))).distinct()
        colours = cut(_spread_least(nodes.withColumn("label", F.col("node")), rest))
        inside = rest.join(colours.select(F.col("node").alias("a"), F.col("label").alias("colour")), "a").join(colours.select(F.col("node").alias("b"), F.col("label").alias("_other")), "b").filter("colour = _other").select("a", "b", "colour")
        inside = cut(inside)
        reach, fresh = None, cut(colours.filter("node = label").select("node", F.col("label").alias("colour")))
        while not fresh.isEmpty():
            reach = fresh if reach is None else cut(reach.unionByName(fresh))
            fresh = cut(inside.join(fresh.withColumnRenamed("node", "b"), ["b", "colour"]).select(F.col("a").alias("node"), "colour").distinct().join(reach.select("node"), "node", "left_anti"))
        several = reach.groupBy("colour").count().filter("count > 1").select("colour")
        found.append(cut(reach.join(several, "colour", "left_semi").select("node", F.col("colour").alias("component"))))
        gone = reach.select("node")
        rest = cut(inside.select("a", "b").join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti"))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    none = own.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    members = cut(reduce(DataFrame.unionByName, found, none))

    def with_loops(members: DataFrame, own: DataFrame) -> DataFrame:
        alone = own.distinct().join(members.select("node"), "node", "left_anti")
        return cut(members.unionByName(alone.select("node", F.col("node").alias("component"))))

    # A node that leads to itself is a component only if none holds it once later rounds' chains are back: it may lie on one.
    for chains, own_loops in zip(reversed(stack), reversed(loops[1:]), strict=True):  # a chain belongs to a component where both its ends do
        members = with_loops(members, own_loops)
        ends = chains.join(members.select(F.col("node").alias("head"), "component"), "head").join(members.select(F.col("node").alias("tail"), F.col("component").alias("_tail")), "tail").filter("component = _tail")
        members = cut(members.unionByName(ends.select("node", "component")))
    members = with_loops(members, loops[0])
    least = members.groupBy("component").agg(F.min("node").alias("least"))
    return members.join(least, "component").select("node", F.col("least").alias("component"))


def shares(inputs: DataFrame, most_layers: int = 10_000) -> DataFrame:
    """sample, source, share: what part of each sample comes from each source, along the processes between them.

    inputs (sample, origin, proportion): what a sample was made from; proportions are kept as given, so those of a
    sample add up to the product of what its processes hand on. A sample that is made from nothing is a source, wholly
    of itself. Samples are worked out layer by layer, a layer being those whose origins are all known: a product of
    sparse tables each, whose rows are those of the result. A ring of processes is an error.
    """
    edges = cut(inputs.select("sample", "origin", F.col("proportion").cast("double").alias("p")).dropna(subset=["sample", "origin"]).groupBy("sample", "origin").agg(F.sum("p").alias("p")))
    made = edges.select("sample").distinct()
    sources = edges.select(F.col("origin").alias("sample")).distinct().join(made, "sample", "left_anti")
    layer = cut(sources.select("sample", F.col("sample").alias("source"), F.lit(1.0).alias("share")))
    known, waiting, partial = layer, edges, None
    for _ in range(most_layers):
        if waiting.isEmpty():
            return known
        # What the newest layer gives to samples that wait, added to what they have had.
        ready_from = layer.select(F.col("sample").alias("origin")).distinct()
        given = waiting.join(layer.withColumnRenamed("sample", "origin"), "origin").groupBy("sample", "source").agg(F.sum(F.col("p") * F.col("share")).alias("share"))
        waiting = cut(waiting.join(ready_from, "origin", "left_anti"))
        partial = cut((given if partial is None else partial.unionByName(given)).groupBy("sample", "source").agg(F.sum("share").alias("share")))
        still = waiting.select("sample").distinct()
        layer = cut(partial.join(still, "sample", "left_anti"))
        if layer.isEmpty() and not waiting.isEmpty():
            raise ValueError("processes in a ring: some samples are made from themselves")
        partial = cut(partial.join(still, "sample", "left_semi"))
        known = cut(known.unionByName(layer))
    raise RuntimeError(f"more than {most_layers} layers")


def symmetrized(edges: DataFrame, a: str, b: str, kind: str, inverse: dict[str, str]) -> DataFrame:
    """Edges with their inverses: kinds that `inverse` names are turned round under the inverse kind."""
    pairs = F.create_map(*(F.lit(x) for p in inverse.items() for x in p))
    flipped = edges.filter(F.col(kind).isin(list(inverse))).select(F.col(b).alias(a), F.col(a).alias(b), pairs[F.col(kind)].alias(kind))
    return edges.select(a, b, kind).unionByName(flipped).distinct()


def tree_faults(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """fault, n: repeated keys, missing parents, and nodes that no root is above."""
    keyed = nodes.select(F.col(key).alias("node"), F.col(parent).alias("parent"))
    repeated = keyed.groupBy("node").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated_id").alias("fault"), "n")
    edges = keyed.dropna()
    missing = edges.join(keyed.select(F.col("node").alias("parent")), "parent", "left_anti").agg(F.count("*").alias("n")).select(F.lit("missing_parent").alias("fault"), "n")
    roots = keyed.filter("parent is null").select("node").distinct()
    linked = below_roots(edges.select(F.col("node").alias("child"), "parent"), roots)
    loose = keyed.select("node").distinct().join(linked, "node", "left_anti").agg(F.count("*").alias("n")).select(F.lit("not_linked").alias("fault"), "n")
    return repeated.unionByName(missing).unionByName(loose)
