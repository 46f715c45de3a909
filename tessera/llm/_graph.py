"""Connected components over an edge table, without collecting edges or nodes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import shared_dir


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (root, node) with the same components as the edges (a, b), at most one a node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = label.copy()
        np.minimum.at(low, x, label[y])
        np.minimum.at(low, y, label[x])
        np.minimum.at(low, label, low)
        low = low[low]
        if (low == label).all():
            break
        label = low
    other = label != np.arange(len(nodes))
    return nodes[label[other]], nodes[other]


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of the component (longs).

    Alternates two star contractions: each node links its larger neighbours to its smallest neighbour, then itself and
    its smaller neighbours to the smallest of those. Every round is written to the checkpoint folder.
    """
    shared_dir(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct().checkpoint()
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).withColumnsRenamed({"hi": "u", "lo": "v"})
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # now hi > lo holds: small stars hang each node and its smaller neighbours on the smallest
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x")).select("x.*").where("hi <> lo").distinct()
        e = small.checkpoint()
        state = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components have not settled")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
