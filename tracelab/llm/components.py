"""Connected components of a large graph by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelab.llm.store import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for the nodes of (a, b) edges; the label is the smallest node of the component.

    In a round each node takes the smallest label next to it and then the label of that label; rounds
    grow with the logarithm of the longest path. Minima are aggregated map-side, so that
    a node may have any number of edges. Every round is a table in the shared folder.
    """
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-edges")
    near = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = scratch.save(near.select(F.col("a").alias("node"), F.least("a", "b").alias("label")), f"{name}-0")
    turn, changed = 0, labels.count()
    while changed:
        turn += 1
        known = labels.select(F.col("node").alias("b"), F.col("label").alias("other"))
        nearest = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        taken = labels.join(nearest, "node").select("node", F.col("label").alias("old"), F.least("label", "other").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        jumped = taken.join(jump, "label").select("node", "old", F.least("label", "further").alias("label"))
        new = scratch.save(jumped, f"{name}-{turn}")
        changed = new.where(F.col("label") != F.col("old")).count()
        scratch.drop(f"{name}-{turn - 1}")
        labels = new.select("node", "label")
    scratch.drop(f"{name}-edges")
    return labels
