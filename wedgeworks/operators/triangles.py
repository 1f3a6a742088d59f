"""Counting and listing triangles.

Input ``o`` is an oriented graph (each edge once, acyclic order), so each triangle a -> b, a -> c, b -> c is
found once. Counting intersects neighbour arrays; listing joins. The kernels that a hand-written engine
offers for the intersection (merge, binary search, pivots, heaps) are one operator here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import common, search_steps
from ..sources.scratch import is_kept, kept, scratch_path
from . import unreduced

#: Edges whose lists may be broadcast: 16 MB of ids.
SMALL_GRAPH = 2_000_000
#: Elements of the longest neighbour list that a row may hold where the order sets no bound.
LONGEST = 100_000


def adjacency(o: DataFrame) -> DataFrame:
    """(src, nbrs): sorted neighbour arrays."""
    return o.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))


def edge_lists(o: DataFrame, how: str = "inner") -> DataFrame:
    """(src, dst, na, nb) for edges whose ends both have neighbours (P14); with how="left" for all edges.

    The source's list travels with its exploded edges, so only the target's list is joined. If o is a kept
    table of at most SMALL_GRAPH edges by its own count, the lists are broadcast and no edge travels at all.
    """
    adj = adjacency(o)
    edges = adj.select("src", F.explode("nbrs").alias("dst"), F.col("nbrs").alias("na"))
    lists = adj.select(F.col("src").alias("dst"), F.col("nbrs").alias("nb"))
    small = is_kept(o) and o.count() <= SMALL_GRAPH
    return edges.join(F.broadcast(lists) if small else lists, "dst", how)


def kept_lists(o: DataFrame) -> tuple[DataFrame, int]:
    """adjacency, written once, and into how many blocks of about SMALL_GRAPH edges its lists are to be dealt."""
    lists = kept(adjacency(o), "lists")
    n = lists.agg(F.sum(F.size("nbrs").cast("long"))).first()[0] or 0
    return lists, max(1, -(-n // SMALL_GRAPH))


def by_blocks(edges: DataFrame, key: str, targets: DataFrame, blocks: int, take: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What take makes of edges joined to targets, a written table; targets' rows are broadcast in blocks, by a hash of key.

    Every block is a pass over edges, which are read and not shuffled: the disk that a pass needs is its result.
    """
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    path = scratch_path(edges.sparkSession, "blocks")
    for b in range(blocks):
        out = take(edges.where(block == b).join(F.broadcast(targets.where(block == b)), key))
        out.write.mode("append").parquet(path)
    return edges.sparkSession.read.schema(out.schema).parquet(path)


def over_lists(o: DataFrame, take: Callable[[DataFrame], DataFrame], lists: tuple[DataFrame, int] | None = None) -> DataFrame:
    """What take makes of (src, dst, na, nb), the rows of edge_lists, block by block of the targets' lists."""
    adj, blocks = lists or kept_lists(o)
    edges = adj.select("src", F.explode("nbrs").alias("dst"), F.col("nbrs").alias("na"))
    return by_blocks(edges, "dst", adj.select(F.col("src").alias("dst"), F.col("nbrs").alias("nb")), blocks, take)


def total(counts: DataFrame) -> DataFrame:
    """One row, n_triangles, of counts (n)."""
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_triangles"))


def is_small(o: DataFrame) -> bool:
    return is_kept(o) and o.count() <= SMALL_GRAPH


def count_array(o: DataFrame) -> DataFrame:
    """One row, n_triangles."""
    count = lambda t: t.agg(F.sum(common("na", "nb")).alias("n"))
    return total(count(edge_lists(o)) if is_small(o) else over_lists(o, count))


def closed_edges(o: DataFrame, lists: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(src, dst, thirds): edges with the third corners of the triangles that their ends' lists close; may be empty."""
    closed = lambda t: t.select("src", "dst", F.array_intersect("na", "nb").alias("thirds"))
    return closed(edge_lists(o)) if is_small(o) else over_lists(o, lambda t: closed(t).where(F.size("thirds") > 0), lists)


def list_triangles(o: DataFrame) -> DataFrame:
    """(a, b, c) with a -> b, a -> c, b -> c, from the intersections: no wedge that isn't closed leaves its task."""
    return closed_edges(o).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.explode("thirds").alias("c"))


def list_by_wedges(o: DataFrame) -> DataFrame:
    """list_triangles as a join: wedges at a, closed by the edge from b.

    Wedges come from arrays: each neighbour with those after it in vertex order; the closing edge may run
    either way, so it is looked up by its unordered pair.
    """
    wedges = adjacency(o).select(F.col("src").alias("a"), F.posexplode("nbrs").alias("i", "x"), "nbrs").select(
        "a", "x", F.explode(F.slice("nbrs", F.col("i") + 2, F.size("nbrs"))).alias("y")
    )
    closing = o.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), F.col("src").alias("b"), F.col("dst").alias("c"))
    return wedges.join(closing, ["x", "y"]).select("a", "b", "c")


def count_join(o: DataFrame) -> DataFrame:
    """The count as a join of wedges with the edges that close them, where intersections are not wanted.

    Wedges are made where their lists are read, and closing edges broadcast in blocks: no wedge travels.
    """
    lists, blocks = kept_lists(o)
    top = lists.agg(F.max(F.greatest("src", F.array_max("nbrs")))).first()[0] or 0
    id_type = "int" if top < 1 << 31 else "long"  # a pair of ints is one long to a hash join
    adj = lists.select(F.col("nbrs").cast(f"array<{id_type}>").alias("nbrs"))
    ends = adj.select(F.posexplode("nbrs").alias("i", "x"), "nbrs")
    closing = o.select(F.least("src", "dst").cast(id_type).alias("x"), F.greatest("src", "dst").cast(id_type).alias("y"))
    block = lambda: F.pmod(F.xxhash64("x"), F.lit(blocks))
    closing = kept(closing, "closing")
    path = scratch_path(o.sparkSession, "blocks")
    for b in range(blocks):
        wedges = ends.where(block() == b).select("x", F.explode(F.slice("nbrs", F.col("i") + 2, F.size("nbrs"))).alias("y"))
        closed = wedges.join(F.broadcast(closing.where(block() == b)), ["x", "y"])
        closed.agg(F.count("*").alias("n")).write.mode("append").parquet(path)
    return total(o.sparkSession.read.schema("n long").parquet(path))


def count_split(edges: DataFrame, limit: int = LONGEST) -> DataFrame:
    """One row, n_triangles: the sum of all edges' intersections, for orders that don't bound the lists.

    If a list is longer than limit, lists are cut by a hash of their elements into parts that aren't, and the
    parts' intersections are added up; no row holds a hub's whole list.
    """
    longest = edges.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    parts = 2 * -(-longest // limit)  # twice, as hashed parts are uneven
    if longest <= limit:
        return count_array(edges)
    from .partition import column_counts

    return column_counts(edges, lambda v: F.pmod(F.xxhash64(v), F.lit(parts))).agg(F.coalesce(F.sum("n_triangles"), F.lit(0)).cast("long").alias("n_triangles"))


def count_unreduced(u: DataFrame, limit: int = unreduced.PART) -> DataFrame:
    """On the symmetric graph each triangle is met six times (J9). Loops and repeats in u are dropped.

    Lists are packed into parts that meet pair by pair; if a list is longer than limit, all are cut as in count_split.
    """
    parts = unreduced.parts_for(u.count(), u.sparkSession.sparkContext.defaultParallelism)
    lists = unreduced.packed_lists(u, parts)
    if (lists.agg(F.max("longest")).first()[0] or 0) <= limit:
        six = total(unreduced.common_neighbours(lists, parts))
    else:
        six = count_split(u.where("src <> dst").distinct(), limit)
    return six.select(F.call_function("div", F.col("n_triangles"), F.lit(6)).alias("n_triangles"))


def count_hybrid(o: DataFrame, limit: int = 256) -> DataFrame:
    """One row, n_triangles: short lists are intersected whole, and where the shorter list exceeds limit its elements are probed in a table of the longer one."""
    m, n = F.size("na"), F.size("nb")
    probed = F.when(m <= n, common("na", "nb")).otherwise(common("nb", "na"))  # the second list is the table, the first one's elements are looked up
    return total(over_lists(o, lambda t: t.agg(F.sum(F.when(F.least(m, n) <= limit, common("na", "nb")).otherwise(probed)).alias("n"))))


def edge_support(o: DataFrame) -> DataFrame:
    """(src, dst, support): triangles on each oriented edge (A5): its own intersection, and one for each intersection that it is a side of.

    An intersection travels whole to each end of its edge, where its credits are made and added up.
    """
    adj, blocks = kept_lists(o)
    t = closed_edges(o, (adj, blocks))
    to = lambda v, d, to, n: [F.col(v).alias("src"), d.alias("d"), F.col(to).alias("to"), F.lit(n).cast("long").alias("n")]
    none = F.lit(None).cast("long")
    sent = adj.select(*to("src", none, "nbrs", 0)).unionByName(t.select(*to("src", F.col("dst"), "thirds", 1))).unionByName(t.select(*to("dst", none, "thirds", 1)))
    own = F.struct(F.col("d").alias("dst"), F.size("to").cast("long").alias("n"))
    credits = F.concat(F.when(F.col("d").isNull(), F.array().cast("array<struct<dst:bigint,n:bigint>>")).otherwise(F.array(own)), F.transform("to", lambda c: F.struct(c.alias("dst"), F.col("n").alias("n"))))
    return sent.repartition("src").select("src", F.inline(credits)).groupBy("src", "dst").agg(F.sum("n").alias("support"))


def source_credit(o: DataFrame) -> DataFrame:
    """(v, credit): common neighbours summed at each edge's source."""
    return edge_lists(o, "left").groupBy(F.col("src").alias("v")).agg(F.sum(F.coalesce(common("na", "nb"), F.lit(0))).cast("long").alias("credit"))


def vertex_triangles(o: DataFrame) -> DataFrame:
    """(v, n_triangles) of vertices on a triangle: each corner counts (A4); an edge's ends are credited its whole intersection at once."""
    one = F.lit(1).cast("long").alias("n")
    n = F.size("thirds").cast("long").alias("n")
    ends = F.array(F.struct(F.col("src").alias("v"), n), F.struct(F.col("dst").alias("v"), n))
    credits = closed_edges(o).select(F.inline(F.concat(ends, F.transform("thirds", lambda c: F.struct(c.alias("v"), one)))))
    return credits.groupBy("v").agg(F.sum("n").alias("n_triangles")).where("n_triangles > 0")


def triangle_edges(o: DataFrame) -> DataFrame:
    """One row, n_edges: directed edges with a common neighbour, twice the undirected ones.

    An edge's intersection marks the edge and its triangles' other two sides. Marks meet in the tasks that make
    them; only distinct ones travel. An edge alone could stop at its first match, but its other matches are the
    other sides' marks.
    """
    third = closed_edges(o).select("src", "dst", F.explode("thirds").alias("c"))
    side = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"))
    marks = third.select(F.explode(F.array(side("src", "dst"), side("src", "c"), side("dst", "c"))).alias("e")).select("e.*").distinct()
    return o.join(marks, ["src", "dst"], "left_semi").agg((F.count("*") * 2).alias("n_edges"))


def clustering(pairs: DataFrame, o: DataFrame) -> DataFrame:
    """(v, deg, n_triangles, local): local clustering coefficients, 0 below two neighbours."""
    from .degree import degree_undirected

    pairs_of = F.col("deg") * (F.col("deg") - 1) / 2
    n = F.coalesce("n_triangles", F.lit(0)).cast("long")
    return degree_undirected(pairs).join(vertex_triangles(o), "v", "left").select("v", "deg", n.alias("n_triangles"), F.when(F.col("deg") > 1, n / pairs_of).otherwise(F.lit(0.0)).alias("local"))


def list_sizes(o: DataFrame) -> DataFrame:
    """(src, dst, m, n): out-degrees of both ends, 0 if none."""
    deg = o.groupBy("src").agg(F.count("*").alias("m"))
    return o.join(deg, "src").join(deg.select(F.col("src").alias("dst"), F.col("m").alias("n")), "dst", "left").select("src", "dst", "m", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def work_class(o: DataFrame, small: int = 256, large: int = 1024, drop_empty: bool = False) -> DataFrame:
    """(src, dst, class): by the shorter list (A12, O4); small < limit <= mid < limit <= large."""
    sizes = list_sizes(o).withColumn("short", F.least("m", "n"))
    if drop_empty:
        sizes = sizes.where("short > 0")
    kind = F.when(F.col("short") < small, "small").when(F.col("short") < large, "mid").otherwise("large")
    return sizes.select("src", "dst", kind.alias("class"))


def work_class_hist(o: DataFrame, small: int = 256, large: int = 1024) -> DataFrame:
    return work_class(o, small, large).groupBy("class").agg(F.count("*").alias("n_edges"))


def hybrid_switch_share(o: DataFrame, limit: int = 256) -> DataFrame:
    """One row, share of edges whose shorter list exceeds limit and would be searched, not merged."""
    return list_sizes(o).agg(F.avg(F.when(F.least("m", "n") > limit, 1.0).otherwise(0.0)).alias("share"))


def intersection_cost(o: DataFrame) -> DataFrame:
    """One row: comparisons of merging all lists, and of searching the shorter in the longer."""
    short, long_ = F.least("m", "n"), F.greatest("m", "n")
    return list_sizes(o).agg(F.sum(F.col("m") + F.col("n")).alias("merge_cost"), F.sum(short * search_steps(long_)).alias("search_cost"))
