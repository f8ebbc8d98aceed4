"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.common import stash


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``): the component is its smallest node.

    In each round every label moves to its neighbour of lowest random priority, and links between labels are
    contracted; the labels left shrink by a constant share in expectation, on chains as on dense groups. Each
    step is a grouped minimum with map-side combining or a join whose large side Spark can split, so
    neither a hub nor a huge component meets in one task. Self-links and repeated links are harmless.
    """
    edges = stash(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links"
    )
    labels, turn = None, 0
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        priority = lambda c: F.xxhash64(F.col(c), F.lit(turn))  # noqa: B023, E731
        moves = stash(
            both.groupBy(F.col("a").alias("node"))
            .agg(F.min_by("b", priority("b")).alias("near"), F.min(priority("b")).alias("first"))
            .select("node", F.when(F.col("first") < priority("node"), F.col("near")).otherwise(F.col("node")).alias("to")),
            "moves",
        )
        if labels is None:
            labels = moves.select("node", F.col("to").alias("label"))
        else:
            step = moves.select(F.col("node").alias("label"), "to")
            labels = stash(
                labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels"
            )
        for end in ("a", "b"):
            edges = edges.join(moves.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}")), end)
        edges = stash(
            edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).where("a <> b").distinct(),
            "links",
        )
        turn += 1
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    smallest = stash(labels.groupBy("label").agg(F.min("node").alias("component")), "smallest")
    return labels.join(smallest, "label").select("node", "component")
