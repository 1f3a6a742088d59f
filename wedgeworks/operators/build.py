"""From raw pairs to a simple graph: symmetrise, drop loops, drop repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse."""
    return edges.select("src", "dst").unionByName(reverse(edges))


def drop_loops(edges: DataFrame) -> DataFrame:
    """P1."""
    return edges.where("src <> dst")


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge of the simple graph once, src < dst: loops and repeats dropped before anything is doubled."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.where("src <> dst").select(low.alias("src"), high.alias("dst")).distinct()


def clean(edges: DataFrame) -> DataFrame:
    """The simple symmetric graph; one shuffle, on half of its edges."""
    return symmetrise(undirected(edges))


def quality(raw: DataFrame) -> DataFrame:
    """One row: raw rows, loops, and rows that repeat an edge in either direction."""
    keyed = raw.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).groupBy("a", "b").count()
    return keyed.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("raw_rows"),
        F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("count"))), F.lit(0)).alias("loop_rows"),
        F.coalesce(F.sum(F.when(F.col("a") != F.col("b"), F.col("count") - 1)), F.lit(0)).alias("repeat_rows"),
    )
