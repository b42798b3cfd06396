"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import materialize


def relabel(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (a, b) between the labels of their ends; nodes without a label stand for themselves, loops go."""
    ends = edges
    for end in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(end), F.col("component").alias("_to")), end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return ends.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def compose(labels: DataFrame, further: DataFrame) -> DataFrame:
    """``labels`` (node, component) with components replaced by their own in ``further``."""
    up = further.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return labels.join(up, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) for every node of ``edges`` (a, b).

    Each level hooks every node to the smallest of itself and its neighbours, follows the hooks to
    their roots by doubling, and contracts the edges to the roots; what is left of them shrinks from
    level to level.  All steps are aggregates with partial minima and equi-joins; no node's
    neighbours are gathered anywhere.
    """
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        hooks = materialize(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("component")), "hooks")
        while True:
            further = materialize(compose(hooks, hooks), "hooks")
            moved = further.join(hooks.select("node", F.col("component").alias("_was")), "node").filter("component <> _was").limit(1).count()
            hooks = further
            if not moved:
                break
        labels = hooks if labels is None else materialize(compose(labels, hooks), "labels")
        edges = materialize(relabel(edges, hooks), "edges")
        if not edges.limit(1).count():
            return labels
