"""Connected components of an edge table, as rounds of joins.

Each round hooks every label onto the smallest label its edges reach and then
follows the hooks, so labels shrink along paths of doubling length. Edges that
ended inside one component leave the next round. Labels and edges stay in tables
of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges(a, b)`; label is the component's smallest node."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(
        both.groupBy("a").agg(F.min("b").alias("least")).select(
            F.col("a").alias("node"), F.least("a", "least").alias("label")
        ),
        "labels",
    )
    while True:
        # Labels as nodes of their own: two hops a round.
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        labels = materialize(
            labels.join(up, "label", "left").select("node", F.coalesce("higher", "label").alias("label")), "labels"
        )
        named = (
            edges.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a")
            .join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            .filter("la <> lb")
            .select("a", "b", F.least("la", "lb").alias("low"), F.greatest("la", "lb").alias("high"))
        )
        edges = materialize(named, "edges")
        if edges.isEmpty():
            deeper = labels.join(
                labels.select(F.col("node").alias("label"), F.col("label").alias("higher")), "label"
            ).filter("higher <> label")
            if deeper.isEmpty():
                return labels
            continue
        hooks = edges.groupBy("high").agg(F.min("low").alias("low"))
        labels = materialize(
            labels.join(hooks.withColumnRenamed("high", "label"), "label", "left").select(
                "node", F.coalesce("low", "label").alias("label")
            ),
            "labels",
        )
