"""Peeling and contracting many directed graphs at once.

Money often runs down long chains, one wallet after the other, with a small payment
leaving at each. Peeling such a graph from its ends takes as many rounds as the chain is
long. Here a round does three things: wallets that nothing reaches any more hand their
layer on, wallets that reach nothing are put aside, and every run of wallets with one way
in and one way out becomes a single edge. A run is found by pointer doubling, so a chain of n
wallets takes log n steps.

An edge holds a function of the layer of its start, ``max(floor, layer + add)``. Functions of
this form compose and join to functions of this form, so a contracted edge says exactly
what its chain would have said. What was put aside is worked out at the end, last
removed first.

Edges are ``scope..., a, b`` without parallel ones; ``scope`` names the graph.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivermark.scale import cut


def _ends(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Per wallet how many edges lead in and out."""
    side = lambda own, i, o: edges.select(*scope, F.col(own).alias("node"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    return side("b", 1, 0).unionByName(side("a", 0, 1)).groupBy(*scope, "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))


def _doubled(ways: DataFrame, scope: list[str]) -> DataFrame:
    """Each wallet's way back, twice as far where it ends inside a run."""
    further = ways.select(*scope, F.col("node").alias("a"), F.col("a").alias("_a"), F.col("add").alias("_add"), F.col("floor").alias("_floor"))
    return cut(ways.drop("moved").join(further, [*scope, "a"], "left").select(
        *scope, "node", F.coalesce("_a", "a").alias("a"), (F.col("add") + F.coalesce("_add", F.lit(0))).alias("add"),
        F.greatest("floor", F.col("_floor") + F.col("add")).alias("floor"), F.col("_a").isNotNull().alias("moved"),
    ))


def contracted(edges: DataFrame, scope: list[str], keep: DataFrame | None = None, base: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Edges with every run as one edge, and per wallet inside a run its way from the run's start.

    ``keep`` lists wallets that are never taken in, ``base`` holds floors of wallets. Closed
    rings have no start and stay as they are.
    """
    inner = _ends(edges, scope).filter("i = 1 AND o = 1").select(*scope, "node")
    if keep is not None:
        inner = inner.join(keep.select(*scope, "node"), [*scope, "node"], "left_anti")
    ways = edges.filter("a <> b").withColumnRenamed("b", "node").join(inner, [*scope, "node"])
    if base is not None:
        ways = ways.join(base, [*scope, "node"], "left").withColumn("floor", F.greatest("floor", "base")).drop("base")
    ways = cut(ways.select(*scope, "node", "a", "add", "floor").withColumn("moved", F.lit(True)))
    n = ways.count()
    if not n:
        return edges, None
    inside = ways.select(*scope, F.col("node").alias("a"))
    for _ in range(math.ceil(math.log2(n + 1)) + 1):
        ways = _doubled(ways, scope)
        if ways.filter("moved").isEmpty():
            break
    done = cut(ways.drop("moved").join(inside, [*scope, "a"], "left_anti"))
    via = done.select(*scope, F.col("node").alias("a"), F.col("a").alias("_a"), F.col("add").alias("_add"), F.col("floor").alias("_floor"))
    left = edges.join(done.select(*scope, F.col("node").alias("b")), [*scope, "b"], "left_anti").join(via, [*scope, "a"], "left")
    whole = left.select(
        *scope, F.coalesce("_a", "a").alias("a"), "b", (F.col("add") + F.coalesce("_add", F.lit(0))).alias("add"),
        F.greatest("floor", F.col("_floor") + F.col("add")).alias("floor"),
    )
    return whole, done


def peel(links: DataFrame, scope: list[str], nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Edges that a cycle holds, and the longest-path layer of all ``nodes`` of graphs without one.

    Graphs with remaining edges are cyclic; their layers mean nothing. Without ``nodes`` only
    the edges are worked out.
    """
    key = [*scope, "node"]
    edges = cut(links.select(*scope, "a", "b", F.lit(1).cast("long").alias("add"), F.lit(0).cast("long").alias("floor")))
    aside: list[DataFrame] = []
    base: DataFrame | None = None
    count = edges.count()
    while count:
        ends = cut(_ends(edges, scope))
        first = ends.filter("i = 0").select(*key)
        last = ends.filter("o = 0").select(*scope, F.col("node").alias("b"), F.lit(True).alias("_last"))
        marked = edges.join(first.select(*scope, F.col("node").alias("a"), F.lit(True).alias("_first")), [*scope, "a"], "left").join(last, [*scope, "b"], "left")
        marked = cut(marked)
        if nodes is not None:
            given = marked.filter("_first").withColumnRenamed("a", "node")
            given = given.withColumn("base", F.lit(0).cast("long")) if base is None else given.join(base, key, "left")
            told = given.select(*scope, F.col("b").alias("node"), F.greatest("floor", F.coalesce("base", F.lit(0)) + F.col("add")).alias("base"))
            base = cut((told if base is None else told.unionByName(base)).groupBy(*key).agg(F.max("base").alias("base")))
            aside.append(marked.filter("_first IS NULL AND _last").select(*scope, "a", F.col("b").alias("node"), "add", "floor"))
        edges = marked.filter("_first IS NULL AND _last IS NULL").drop("_first", "_last")
        edges, ways = contracted(edges, scope, base=base)
        if ways is not None and nodes is not None:
            aside.append(ways)
        edges = cut(edges.groupBy(*scope, "a", "b").agg(F.max("add").alias("add"), F.max("floor").alias("floor")))
        before, count = count, edges.count()
        if count == before:
            break
    if nodes is None:
        return edges, None
    known = nodes.select(*key)
    for rows in aside:
        known = known.join(rows.select(*key), key, "left_anti")
    floors = base if base is not None else nodes.select(*key).limit(0).withColumn("base", F.lit(0).cast("long"))
    known = cut(known.join(floors, key, "left").select(*key, F.coalesce("base", F.lit(0)).cast("long").alias("layer")))
    for rows in reversed(aside):
        start = known.select(*scope, F.col("node").alias("a"), "layer")
        found = rows.join(start, [*scope, "a"]).select(*key, F.greatest("floor", F.col("layer") + F.col("add")).alias("layer"))
        found = found.unionByName(floors.join(rows.select(*key).distinct(), key, "left_semi").withColumnRenamed("base", "layer"))
        known = cut(known.unionByName(found.groupBy(*key).agg(F.max("layer").alias("layer"))))
    return edges, known


def distances(links: DataFrame, scope: list[str], seeds: DataFrame) -> DataFrame:
    """``scope..., node, layer``: fewest steps from the seed of a graph to every wallet it reaches."""
    key = [*scope, "node"]
    edges = cut(links.filter("a <> b").select(*scope, "a", "b", F.lit(1).cast("long").alias("add"), F.lit(0).cast("long").alias("floor")))
    seeds = cut(seeds.select(*key))
    aside: list[DataFrame] = []
    count = edges.count()
    # Side payments hide chains, so ends are put aside before each contraction.
    while count:
        last = _ends(edges, scope).filter("o = 0").select(*key).join(seeds, key, "left_anti").select(*scope, F.col("node").alias("b"), F.lit(True).alias("_last"))
        marked = cut(edges.join(last, [*scope, "b"], "left"))
        aside.append(marked.filter("_last").select(*scope, "a", F.col("b").alias("node"), "add"))
        edges, ways = contracted(marked.filter("_last IS NULL").drop("_last"), scope, seeds)
        if ways is not None:
            aside.append(ways.select(*scope, "a", "node", "add"))
        edges = cut(edges.groupBy(*scope, "a", "b").agg(F.min("add").alias("add"), F.min("floor").alias("floor")))
        before, count = count, edges.count()
        if 2 * count > before:
            break
    found = front = cut(seeds.withColumn("layer", F.lit(0).cast("long")))
    while not front.isEmpty():
        step = edges.join(front.withColumnRenamed("node", "a"), [*scope, "a"]).groupBy(*scope, F.col("b").alias("node")).agg(F.min(F.col("layer") + F.col("add")).alias("_new"))
        front = cut(step.join(found, key, "left").filter("layer IS NULL OR _new < layer").select(*key, F.col("_new").alias("layer")))
        found = cut(reduce(DataFrame.unionByName, [found, front]).groupBy(*key).agg(F.min("layer").alias("layer")))
    for rows in reversed(aside):
        more = rows.join(found.withColumnRenamed("node", "a"), [*scope, "a"]).groupBy(*key).agg(F.min(F.col("layer") + F.col("add")).alias("layer"))
        found = cut(found.unionByName(more.join(found, key, "left_anti")))
    return found
