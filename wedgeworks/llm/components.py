"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(v, c) for every vertex of edges (a, b): c is the smallest vertex of its component.

    Every round a vertex takes the smallest label around it, then that label's own label of the round before. Rounds are written to
    the shared folder, so lineage stays short; their number grows with the logarithm of the longest path.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).withColumnRenamed("a", "v"), "labels")
    rounds = labels
    while True:
        around = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy("a").agg(F.min("c").alias("m"))
        lower = labels.join(around.withColumnRenamed("a", "v"), "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jumped = lower.join(labels.select(F.col("v").alias("c"), F.col("c").alias("next")), "c")
        moved = stored(jumped.select("v", "old", F.least("c", "next").alias("c")), "labels")
        still = moved.where("c <> old").isEmpty()
        discard(rounds)
        labels, rounds = moved.select("v", "c"), moved
        if still:
            discard(both)
            labels._stored_at = moved._stored_at
            return labels


def joined(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """classes (v, c) after more edges: only the components that the edges touch are worked on. Takes the place of classes."""
    label = lambda x: F.coalesce(F.col(x), F.col(x[-1])).alias(x[-1])
    of = lambda x: classes.select(F.col("v").alias(x), F.col("c").alias("c" + x))
    between = edges.join(of("a"), "a", "left").join(of("b"), "b", "left").select(label("ca"), label("cb"))
    merged = components(between)
    moved = classes.join(merged.select(F.col("v").alias("c"), F.col("c").alias("to")), "c", "left").select("v", F.coalesce("to", "c").alias("c"))
    fresh = merged.join(classes.select("v"), "v", "left_anti")
    out = stored(moved.unionByName(fresh.select("v", "c")), "classes")
    discard(merged, classes)
    return out
