"""Connected components by repeated contraction, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storegrain.workspace import stage, stage_counted


def _hooked(edges: DataFrame) -> DataFrame:
    """Each end of an edge and the least of itself and its neighbours."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    return both.groupBy("u").agg(F.min("v").alias("least")).select(
        F.col("u").alias("node"), F.least("u", "least").alias("root")
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of an edge ``(u, v)``; ``root`` is the least node reachable.

    Each round hooks every node to its least neighbour and relabels the edges, so
    a chain shrinks by half at least and a star in one step. Rounds are staged,
    hence lost executors repeat one round only. Minima are merged before the
    shuffle, which spares nodes with very many edges.
    """
    edges = stage(edges.where("u <> v").distinct(), "edges")
    labels = stage(_hooked(edges), "labels")
    hooks = labels
    while True:
        left = hooks.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        right = hooks.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        relabelled = edges.join(left, "u").join(right, "v").where("ru <> rv")
        pairs = relabelled.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v"))
        edges, n_edges = stage_counted(pairs.distinct(), "edges")
        if not n_edges:
            return labels
        hooks = stage(_hooked(edges), "hooks")
        moved = hooks.select(F.col("node").alias("root"), F.col("root").alias("new_root"))
        labels = stage(
            labels.join(moved, "root", "left").select("node", F.coalesce("new_root", "root").alias("root")),
            "labels",
        )
