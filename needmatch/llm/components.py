"""Connected components of a large sparse graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node that has an edge (a, b); comp is the same for all nodes of a component.

    Contracts the graph until no edge is left: each node takes the smallest of itself and its neighbours as parent,
    parents are followed once more, and edges are moved to the parents. Each round is written, so lineage stays short;
    nothing is collected but a count of edges.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    both = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    mapping = both.select("node", F.col("node").alias("comp"))
    while edges.limit(1).count():
        sides = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = sides.groupBy("a").agg(F.least("a", F.min("b")).alias("up"))
        upper = parents.select(F.col("a").alias("up"), F.col("up").alias("top"))
        parents = materialize(parents.join(upper, "up", "left").select("a", F.coalesce("top", "up").alias("up")), "parents")
        mapping = materialize(
            mapping.join(parents, mapping["comp"] == parents["a"], "left")
            .select("node", F.coalesce("up", "comp").alias("comp")), "components")
        ends = parents.select(F.col("a").alias("b"), F.col("up").alias("b_up"))
        edges = materialize(
            edges.join(parents, "a").join(ends, "b")
            .select(F.least("up", "b_up").alias("a"), F.greatest("up", "b_up").alias("b")).where("a <> b").distinct(),
            "edges")
    return mapping
