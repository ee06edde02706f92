"""Connected components and pointer jumping over edge DataFrames, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravela.plans.lineage import cut


def jump_to_roots(parent: DataFrame) -> DataFrame:
    """parent(node, root): follow root links until they stop moving; returns (node, root).

    Nodes that are their own parent may be absent. Each round doubles the distance covered.
    """
    parent = cut(parent)
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = parent.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved"))
        step = cut(step)
        moved = step.where("moved").limit(1).count()
        parent = step.select("node", "root")
        if not moved:
            return parent


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b), undirected, of one orderable type -> (node, root), root the smallest node reachable.

    Rows with a null end and self-loops are ignored; nodes without an edge are absent from the result.
    Each round hooks every node to its smallest neighbour, flattens the forest and contracts the
    edges to roots, so that the edges left shrink geometrically. Hubs meet only map-side combined
    aggregates and joins whose hot side the adaptive planner can split.
    """
    left = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    found = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        roots = jump_to_roots(hook)
        if found is None:
            found = roots
        else:
            on = roots.select(F.col("node").alias("root"), F.col("root").alias("new"))
            found = cut(found.join(on, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
        ra = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = cut(left.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return left.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
