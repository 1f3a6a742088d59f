"""Giving each undirected edge one direction. Input: edges given once, src < dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import precedes
from .degree import degree_undirected


def with_degrees(pairs: DataFrame) -> DataFrame:
    """(src, dst, ds, dd); degrees are joined to half of the symmetric edges."""
    deg = degree_undirected(pairs)
    return pairs.join(deg.select(F.col("v").alias("src"), F.col("deg").alias("ds")), "src").join(deg.select(F.col("v").alias("dst"), F.col("deg").alias("dd")), "dst").select("src", "dst", "ds", "dd")


def directed(pairs: DataFrame, forward: Column) -> DataFrame:
    """src -> dst where forward holds, else dst -> src."""
    return pairs.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("dst"))


def by_id(pairs: DataFrame) -> DataFrame:
    """P5: low id to high id."""
    return pairs.select("src", "dst").where("src < dst")


def by_degree(pairs: DataFrame) -> DataFrame:
    """Ascending (degree, id). Out-degrees stay below the square root of twice the edges."""
    return directed(with_degrees(pairs), precedes("ds", "src", "dd", "dst"))


def by_reverse_degree(pairs: DataFrame) -> DataFrame:
    """Descending degree, ties by ascending id."""
    return directed(with_degrees(pairs), (F.col("ds") > F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst"))))


def trimmed(pairs: DataFrame, k: int = 16, side: str = "low") -> DataFrame:
    """P8, approximate: of the degree order, only edges whose low (or high) end has degree over k, and ties.

    Counts on it fall short of the true number; side "high" is the older sibling, and k = 2 the other one.
    """
    both = with_degrees(pairs)
    both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("dd").alias("ds"), F.col("ds").alias("dd")))
    tie = (F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst"))
    order = {"low": F.col("ds") < F.col("dd"), "high": F.col("ds") > F.col("dd")}[side]
    return both.where(((F.col("ds") > k) & order) | tie).select("src", "dst")
