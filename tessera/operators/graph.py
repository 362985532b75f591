"""Operators on directed graphs of (src, dst) edges, in rounds of joins; no list of edges reaches the driver. Rounds are staged
tables, so a lost executor loses none of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged


def topological_levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest path into a node. Nodes on a cycle, and those behind one, have level -1."""
    edges = staged(edges.select("src", "dst").distinct(), "edges")
    nodes = _ends(edges)
    done = staged(nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("level", F.lit(0)), "levels")
    left = staged(nodes.join(done, "node", "left_anti"), "left")
    level = 0
    while True:
        # a node is next if none of its sources is left
        blocked = edges.join(left.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        level += 1
        new = staged(left.join(blocked, "node", "left_anti").withColumn("level", F.lit(level)), "levels")
        if new.isEmpty():
            return done.union(left.withColumn("level", F.lit(-1)))
        done = done.union(new)
        left = staged(left.join(new, "node", "left_anti"), "left")


def reachable(edges: DataFrame, start: DataFrame, node: str = "node") -> DataFrame:
    """(node, round): what can be reached from the start nodes, with the round of the expansion in which it comes up."""
    edges = staged(edges.select("src", "dst").distinct(), "edges")
    new = staged(start.select(F.col(node).alias("node")).distinct().withColumn("round", F.lit(0)), "frontier")
    seen, n = new, 0
    while True:
        n += 1
        out = edges.join(new.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        new = staged(out.join(seen, "node", "left_anti").withColumn("round", F.lit(n)), "frontier")
        if new.isEmpty():
            return seen
        seen = staged(seen.union(new), "seen")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that a node reaches and is reached from. Nodes that nothing leads to, or that lead
    nowhere, are components by themselves and leave the graph. Then in each round every node gets the smallest node that reaches
    it; the nodes of that colour which reach it back are a component and leave the graph."""
    edges = staged(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    nodes, n = _ends(edges), edges.count()
    while True:
        entered, left_from = edges.select(F.col("dst").alias("src")), edges.select(F.col("src").alias("dst"))
        edges = staged(edges.join(entered, "src", "left_semi").join(left_from, "dst", "left_semi").select("src", "dst"), "edges")
        n, before = edges.count(), n
        if n == before:
            break
    left = staged(_ends(edges), "nodes")
    alone = nodes.join(left, "node", "left_anti").select("node", F.col("node").alias("component"))
    out = None
    while not left.isEmpty():
        colour = _spread(left.select("node", F.col("node").alias("c")), edges)
        # back from each colour's own node, inside the colour
        inside = edges.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst", "cs")
        inside = staged(inside, "inside")
        mine = staged(colour.where("node = c"), "component")
        new = mine
        while True:
            back = inside.join(new.select(F.col("node").alias("dst"), F.col("c").alias("cs")), ["dst", "cs"], "left_semi").select(F.col("src").alias("node"), F.col("cs").alias("c")).distinct()
            new = staged(back.join(mine, "node", "left_anti"), "component")
            if new.isEmpty():
                break
            mine = staged(mine.union(new), "component")
        found = mine.select("node", F.col("c").alias("component"))
        out = found if out is None else out.union(found)
        left = staged(left.join(mine, "node", "left_anti"), "nodes")
        edges = staged(edges.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "edges")
    return alone if out is None else alone.union(out)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest colour that reaches each node along the edges."""
    now = staged(colour, "colour")
    while True:
        came = edges.join(now.select(F.col("node").alias("src"), "c"), "src").select(F.col("dst").alias("node"), "c")
        after = staged(now.union(came).groupBy("node").agg(F.min("c").alias("c")), "colour")
        if after.join(now.withColumnRenamed("c", "old"), "node").where("c <> old").isEmpty():
            return after
        now = after
