"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentweave.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``vertex``, ``component`` (its smallest vertex) for every vertex of ``links`` (``a``, ``b``).

    Every round each vertex points to the smallest of its neighbours and itself, and links move to what their ends point
    to, so a component shrinks by half at least. Counts and minima are folded before they are shuffled; a vertex with very many
    links is one row of a join, which splits on the other side. Each round is written, so a lost task repeats that round only.
    """
    links = written(links.select("a", "b").where("a <> b"), "links")
    names: DataFrame | None = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("to")), "nearest")
        # A vertex that points to one that points on follows it at once.
        further = nearest.select(F.col("v").alias("to"), F.col("to").alias("on"))
        step = written(nearest.join(further, "to", "left").select("v", F.coalesce("on", "to").alias("to")), "step")
        if names is None:
            names = step.select(F.col("v").alias("vertex"), F.col("to").alias("component"))
        else:
            names = written(
                names.join(step, names["component"] == step["v"], "left")
                .select("vertex", F.coalesce("to", "component").alias("component")), "components")
        left = links.join(step, links["a"] == step["v"]).select(F.col("to").alias("a"), "b")
        moved = left.join(step, left["b"] == step["v"]).select("a", F.col("to").alias("b")).where("a <> b")
        links = written(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    if names is None:
        return links.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    # Names of components are their smallest vertex.
    smallest = names.groupBy("component").agg(F.min("vertex").alias("_small"))
    return names.join(smallest, "component").select("vertex", F.col("_small").alias("component"))
