"""Iterative set computations: components, minimum ancestors and list ranking.

All of them move labels over edges with equi-joins and partial aggregates; a round costs one pass
over the remaining edges, and labels are shortcut so that rounds grow with the logarithm of the
longest path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.session import cut


def propagate_min(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node that reaches each node along ``src`` -> ``dst``, within ``keys``.

    Returns (keys..., node, label) for the nodes on edges."""
    keys = list(keys)
    edges = cut(edges.select(*keys, "src", "dst").distinct())
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).distinct()
    labels = cut(ends.join(edges.groupBy(*keys, F.col("dst").alias("node")).agg(F.min("src").alias("low")), [*keys, "node"], "left")
                 .select(*keys, "node", F.least("node", "low").alias("label")))
    while True:
        heard = (edges.join(labels.withColumnRenamed("node", "src"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node"))
                 .agg(F.min("label").alias("heard")))
        lower = labels.join(heard, [*keys, "node"], "left").select(*keys, "node", "label", F.least("label", "heard").alias("low"))
        via = labels.select(*keys, F.col("node").alias("low"), F.col("label").alias("far"))
        step = cut(lower.join(via, [*keys, "low"], "left")
                   .select(*keys, "node", F.least("low", "far").alias("label"), (F.least("low", "far") != F.col("label")).alias("moved")))
        labels = step.drop("moved")
        if step.filter("moved").isEmpty():
            return labels


def components(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Connected components: each node on an edge with the smallest node of its component.

    Every round hooks labels onto their smallest neighbouring label, follows labels twice and
    replaces edges by edges between labels, so the edges melt away geometrically."""
    keys = list(keys)
    both = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    edges = cut(edges.select(*keys, F.explode(both).alias("e")).select(*keys, "e.a", "e.b").filter("a <> b").distinct())
    labels = edges.groupBy(*keys, F.col("a").alias("node")).agg(F.min("b").alias("low")).select(*keys, "node", F.least("node", "low").alias("label"))

    def followed(rows):
        via = rows.select(*keys, F.col("node").alias("label"), F.col("label").alias("far"))
        return rows.join(via, [*keys, "label"], "left").select(*keys, "node", F.coalesce("far", "label").alias("label"))

    labels = cut(followed(cut(labels)))
    while True:
        at_a = labels.select(*keys, F.col("node").alias("a"), F.col("label").alias("la"))
        at_b = labels.select(*keys, F.col("node").alias("b"), F.col("label").alias("lb"))
        edges = cut(edges.join(at_a, [*keys, "a"]).join(at_b, [*keys, "b"]).filter("la <> lb").select(*keys, F.col("la").alias("a"), F.col("lb").alias("b")).distinct())
        hooks = edges.filter("a < b").groupBy(*keys, F.col("b").alias("node")).agg(F.min("a").alias("low"))
        hooked = cut(labels.join(hooks, [*keys, "node"], "left").select(*keys, "node", F.least("label", "low").alias("label")))
        flat = followed(hooked)
        if edges.isEmpty():
            moved = flat.join(hooked.withColumnRenamed("label", "old"), [*keys, "node"]).filter("label <> old")
            if moved.isEmpty():
                return hooked
        labels = cut(flat)


def count_to_end(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes on the path from each node to the end of its chain (itself included), and that end.

    ``nodes`` has (keys..., node, next); ``next`` is null at the end and chains have no cycles.
    Pointers double each round."""
    keys = list(keys)
    state = cut(nodes.select(*keys, "node", F.col("next").alias("ptr"), F.lit(1).cast("bigint").alias("steps"), F.col("node").alias("last")))
    while not state.filter("ptr is not null").isEmpty():
        ahead = state.select(*keys, F.col("node").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("steps").alias("more"), F.col("last").alias("far"))
        state = cut(state.join(ahead, [*keys, "ptr"], "left")
                    .select(*keys, "node", F.col("ptr2").alias("ptr"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("far", "last").alias("last")))
    return state.select(*keys, "node", "steps", "last")
