"""Connected components of a graph that is held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import Scratch, heavy_keys, spread_join


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node in edges (a, b); component is the smallest node reachable.

    Every round offers the smaller label across each edge, to the node and to the node's label, and then jumps from
    labels to their labels; the number of rounds grows with the logarithm of a component's size. Labels and edges stay
    in tables; each round's labels are written to the shared folder. Minima are taken before the shuffle, so a node
    with many edges costs its task no more than one row from each other task; joins deal such nodes, and labels that
    many nodes have, to several tasks.
    """
    edges = scratch.save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    both = edges.union(edges.select("b", "a"))
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    heavy_a, heavy_b = heavy_keys(edges, ["a"]), heavy_keys(edges, ["b"])
    while True:
        at_a = labels.select(F.col("node").alias("a"), F.col("component").alias("la"))
        at_b = labels.select(F.col("node").alias("b"), F.col("component").alias("lb"))
        ends = spread_join(spread_join(edges, at_a, ["a"], heavy_a), at_b, ["b"], heavy_b).where("la <> lb")
        low, high = F.least("la", "lb").alias("offer"), F.greatest("la", "lb").alias("node")
        to_node = F.when(F.col("la") > F.col("lb"), F.col("a")).otherwise(F.col("b")).alias("node")
        offers = scratch.save(ends.select(F.explode(F.array(F.struct(high, low), F.struct(to_node, low))).alias("o")).select("o.*").groupBy("node").agg(F.min("offer").alias("offer")), "offers")
        if offers.isEmpty():
            scratch.drop(offers, edges)
            return labels
        lower = labels.join(offers, "node", "left").select("node", F.least("component", "offer").alias("component"))
        up = lower.select(F.col("node").alias("component"), F.col("component").alias("up"))
        # labels that are common now tell which will be: if one is not foreseen, its task is only longer
        jumped = spread_join(lower, up, ["component"], heavy_keys(labels, ["component"]), "left")
        new = scratch.save(jumped.select("node", F.least("component", "up").alias("component")), "labels")
        scratch.drop(labels, offers)
        labels = new
