"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageledger.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` for every id of ``edges(a, b)``; the component is the smallest id that can be reached.

    Every round each edge hooks the root of its larger side below the smallest root met, then all labels jump to their label's label, so
    the rounds grow with the logarithm of a component's width. Only aggregates (combined map-side) and equi-joins are used; each round's labels are stored in the
    shared folder. Nothing goes to the driver but a count of the edges left. Null ends and loops are left out.
    """
    edges = edges.where("a <> b")
    both = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = both.select(F.col("a").alias("id")).union(both.select("b")).groupBy("id").agg(F.col("id").alias("component"))
    left = both
    while not left.isEmpty():
        # the smallest label across an edge hooks the larger root
        hooks = left.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("to"))
        labels = materialize(
            labels.join(hooks.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        )
        labels = settle(labels)
        ends = labels.select(F.col("id").alias("a"), F.col("component").alias("x"))
        others = labels.select(F.col("id").alias("b"), F.col("component").alias("y"))
        left = materialize(
            both.join(ends, "a").join(others, "b").where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
        )
    return labels


def settle(labels: DataFrame) -> DataFrame:
    """Jump until every label is a root; hooks only lead to smaller ids, so chains have no circle."""
    while True:
        parent = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        jumped = labels.join(parent, "component").select("id", F.col("up").alias("component"), (F.col("up") != F.col("component")).alias("moved"))
        jumped = materialize(jumped)
        labels = jumped.select("id", "component")
        if jumped.where("moved").isEmpty():
            return labels
