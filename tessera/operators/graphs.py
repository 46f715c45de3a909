"""Colour refinement of labelled graphs, and isomorphism by an explicit mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import dealt, running
from tessera.session import kept


def _total(h: Column) -> Column:
    return F.sum(h.cast("decimal(38,0)"))


def refine(nodes: DataFrame, edges: DataFrame, max_rounds: int = 256) -> DataFrame:
    """node and colour (a hash): nodes end with one colour if no round of refinement tells them apart.

    nodes: node, label. edges: src, dst, label (of the connection). A round gives each node the hash of its colour and of the
    multiset of (direction, label, colour) of its connections, taken as two sums of 64-bit hashes: sums need no order, combine
    before the shuffle, and never hold a node's neighbours together. Rounds end when the number of colours stands still; each
    is written to the checkpoint folder. Edges to unknown nodes count as connections without a colour.
    """
    way = lambda here, there, name: edges.select(F.col(here).alias("node"), F.col(there).alias("_to"), F.xxhash64(F.lit(name), "label").alias("_e"))
    both = kept(way("dst", "src", "in").unionByName(way("src", "dst", "out")))
    colour = kept(nodes.select("node", F.xxhash64("label").alias("colour")))
    count = colour.select("colour").distinct().count()
    for _ in range(max_rounds):
        seen = both.join(colour.withColumnsRenamed({"node": "_to", "colour": "_c"}), "_to", "left")
        signs = seen.groupBy("node").agg(_total(F.xxhash64("_e", "_c")).alias("_a"), _total(F.xxhash64("_c", F.lit(1), "_e")).alias("_b"))
        colour = kept(colour.join(signs, "node", "left").select("node", F.xxhash64("colour", "_a", "_b").alias("colour")))
        now = colour.select("colour").distinct().count()
        if now == count:
            return colour
        count = now
    raise RuntimeError("colours have not settled")


def classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, class (its smallest node) and size of the class, by colour refinement."""
    colour = refine(nodes, edges)
    named = colour.groupBy("colour").agg(F.min("node").alias("class"), F.count("*").alias("size"))
    return colour.join(named, "colour").select("node", "class", "size")


def isomorphic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and colours of the first graph, and whether graphs 0 and 1 (column `graph` of both inputs) are found
    isomorphic. node is a long.

    Both are refined together. If their colours differ in number they are not; else the nodes of a colour are mapped in order
    of id, and the answer is yes only if that mapping carries every connection over. A graph with symmetric nodes may so be
    missed, never wrongly matched.
    """
    both = lambda df, *ids: df.select(*[F.struct("graph", F.col(c).alias("node")).alias(c) for c in ids], "label")
    colour = refine(both(nodes, "node"), both(edges, "src", "dst")).select("node.graph", "node.node", "colour", F.lit(1).alias("_one"))
    colour = kept(colour)
    uneven = colour.groupBy("colour").agg(F.sum(F.when(F.col("graph") == 0, 1).otherwise(-1)).alias("d")).where("d <> 0")
    placed = running(dealt(colour, key=["graph", "colour"], by="node"), key=["graph", "colour"], order=["node"], sums={"place": "_one"})
    image = placed.where("graph = 0").select("colour", "place", F.col("node").alias("a")).join(placed.where("graph = 1").select("colour", "place", F.col("node").alias("b")), ["colour", "place"])
    image = kept(image.select("a", "b"))
    of = lambda name: image.select(F.col("a").alias(name), F.col("b").alias(f"_{name}"))
    moved = edges.where("graph = 0").join(of("src"), "src").join(of("dst"), "dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "label", F.lit(1).alias("w"))
    there = edges.where("graph = 1").select("src", "dst", "label", F.lit(-1).alias("w"))
    broken = moved.unionByName(there).groupBy("src", "dst", "label").agg(F.sum("w").alias("w")).where("w <> 0")
    counts = colour.where("graph = 0").agg(F.count("*").alias("nodes"), F.count_distinct("colour").alias("colours"))
    lost = edges.groupBy("graph").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("graph") == 0, F.col("n")).otherwise(-F.col("n"))), F.lit(0)).alias("_lost"))
    one = counts.join(uneven.agg(F.count("*").alias("_u"))).join(broken.agg(F.count("*").alias("_b"))).join(lost)  # four rows of one
    return one.select("nodes", "colours", ((F.col("_u") == 0) & (F.col("_b") == 0) & (F.col("_lost") == 0)).alias("isomorphic"))
