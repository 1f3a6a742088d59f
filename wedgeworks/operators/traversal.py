"""Breadth-first levels, shortest-path counts and betweenness, for many sources at once.

The driver only steps through levels. Edges are written once, bucketed by source, so that no level shuffles
them again. Each level is one join of the frontier with the edges, a sum, and an anti-join with what was
visited; it is written to the scratch folder, so lineage stays short and a lost executor costs no more than
a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import bucketed, kept


def search(u: DataFrame, sources: DataFrame, max_level: int | None = None, symmetric: bool = True) -> list[DataFrame]:
    """Frontiers by level: (s, v, sigma), sigma the number of shortest paths from s (J24, A15). sources: (s).

    In a symmetric graph a vertex's neighbours lie on its own level, the one before and the one after, so what
    is new is told by the last two frontiers alone; with symmetric=False by all.
    """
    u = bucketed(u.select("src", "dst"), "edges", "src")
    return _search(u, sources, max_level, symmetric)


def _search(u: DataFrame, sources: DataFrame, max_level: int | None, symmetric: bool) -> list[DataFrame]:
    frontier = kept(sources.select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma")), "frontier")
    out = [frontier]
    while max_level is None or len(out) <= max_level:
        reached = frontier.join(u, F.col("v") == F.col("src")).groupBy("s", "dst").agg(F.sum("sigma").alias("sigma"))
        visited = out[-1].select("s", "v")
        for f in out[-2:-1] if symmetric else out[:-1]:
            visited = visited.unionByName(f.select("s", "v"))
        fresh = reached.withColumnRenamed("dst", "v").join(visited, ["s", "v"], "left_anti").select("s", "v", "sigma")
        frontier = kept(fresh, "frontier")
        if frontier.isEmpty():
            break
        out.append(frontier)
    return out


def levels(u: DataFrame, sources: DataFrame, max_level: int | None = None, symmetric: bool = True) -> DataFrame:
    """(s, v, level, sigma) of every vertex reached."""
    found = [f.withColumn("level", F.lit(n).cast("long")) for n, f in enumerate(search(u, sources, max_level, symmetric))]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select("s", "v", "level", "sigma")


def betweenness(u: DataFrame, sources: DataFrame, max_level: int | None = None) -> DataFrame:
    """(v, bc): dependencies summed over the sources, deepest level first (A14); u is symmetric.

    max_level: of paths of at most that length.
    """
    edges = bucketed(u.select("src", "dst"), "edges", "src")
    frontiers = _search(edges, sources, max_level, True)
    done = below = frontiers[-1].withColumn("delta", F.lit(0.0))
    for f in reversed(frontiers[:-1]):
        # what a vertex below hands up goes along its edges to all neighbours; those of the level above keep it
        share = below.select("s", "v", ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
        got = share.join(edges, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("share").alias("share"))
        own = f.join(got, ["s", "v"], "left").select("s", "v", "sigma", F.coalesce(F.col("sigma") * F.col("share"), F.lit(0.0)).alias("delta"))
        below = kept(own, "delta")
        done = done.unionByName(below)
    return done.where("s <> v").groupBy("v").agg(F.sum("delta").alias("bc"))
