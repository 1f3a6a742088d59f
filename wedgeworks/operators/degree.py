"""Degrees, CSR offsets and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def degree(edges: DataFrame) -> DataFrame:
    """(v, deg): rows per source (A2)."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("deg"))


def degree_undirected(pairs: DataFrame) -> DataFrame:
    """(v, deg) of edges that are given once; both ends are counted in one aggregation."""
    return pairs.select(F.explode(F.array("src", "dst")).alias("v")).groupBy("v").agg(F.count("*").alias("deg"))


def in_degree(edges: DataFrame) -> DataFrame:
    """(v, indeg): rows per target (A3)."""
    return edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("indeg"))


def histogram(degrees: DataFrame) -> DataFrame:
    """(deg, n_vertices), ascending."""
    return degrees.groupBy("deg").agg(F.count("*").alias("n_vertices")).orderBy("deg")


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: vertices, directed edges, id range, degree range (A10)."""
    return degree(edges).agg(
        F.count("*").alias("n_vertices"), F.sum("deg").alias("n_edges"), F.min("v").alias("min_id"),
        F.max("v").alias("max_id"), F.min("deg").alias("min_degree"), F.max("deg").alias("max_degree"),
    )


def running_total(rows: DataFrame, key: str, value: str, by: tuple[str, ...] = (), blocks: int = 256) -> DataFrame:
    """Adds total: the sum of value up to and with each row, in order of an integer key that is unique for each by.

    Two levels: keys are cut into blocks of about equally many rows at approximate quantiles, so clustered
    ids are spread as well; sums of blocks are added up first (at most ``blocks`` rows for each by), then
    rows within a block. No window spans all rows.
    """
    cuts = rows.agg(F.array_sort(F.array_distinct(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], 20 * blocks)))).scalar()
    # a row's block is the number of cuts below its key, coarse cuts first
    step = 16
    coarse = step * F.size(F.filter(F.filter("_cuts", lambda c, i: i % step == step - 1), lambda c: c < F.col(key)))
    block = coarse + F.size(F.filter(F.slice("_cuts", coarse + 1, F.lit(step)), lambda c: c < F.col(key)))
    placed = rows.withColumn("_cuts", F.coalesce(cuts, F.array().cast("array<bigint>"))).withColumn("_block", block).drop("_cuts")
    sums = placed.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*by).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*by, "_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*by, "_block").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    total = F.col("_before") + F.sum(value).over(inside)
    return placed.join(starts, [*by, "_block"]).withColumn("total", total).drop("_block", "_before")


def csr_offsets(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(v, deg, begin_pos) of the vertices that have edges, or of all ids given (v) (O2)."""
    degrees = degree(edges)
    if ids is not None:
        degrees = ids.join(degrees, "v", "left").select("v", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))
    return running_total(degrees, "v", "deg").select("v", "deg", (F.col("total") - F.col("deg")).alias("begin_pos"))


def neighbour_rank(edges: DataFrame) -> DataFrame:
    """(src, dst, pos): position from 0 in the sorted neighbour list."""
    return edges.select("src", "dst", (F.row_number().over(W.partitionBy("src").orderBy("dst")) - 1).cast("long").alias("pos"))


def preview(edges: DataFrame, n: int) -> DataFrame:
    """The first n edges in order."""
    return edges.orderBy("src", "dst").limit(n)
