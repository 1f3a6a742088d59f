"""Splitting a graph so that partial counts over the parts add up to the whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import common
from ..sources.scratch import kept
from .degree import in_degree, running_total


def cut_points(weights: DataFrame, parts: int) -> DataFrame:
    """(part, hi): the last vertex of each part, the smallest v whose running weight reaches its share.

    weights: (v, w). Cuts may coincide on heavy vertices; the last part ends at the largest vertex.
    """
    run = running_total(weights, "v", "w")
    whole = weights.agg(F.sum("w")).scalar()
    part = F.least(F.floor((F.col("total") - 1) * parts / F.col("_all")), F.lit(parts - 1)).cast("long")
    return run.withColumn("_all", whole).select("v", part.alias("part")).groupBy("part").agg(F.max("v").alias("hi"))


def column_cuts(o: DataFrame, parts: int) -> DataFrame:
    """R2: columns with about equal oriented in-degree; a row for each part."""
    return cut_points(in_degree(o).withColumnRenamed("indeg", "w"), parts)


def id_weights(o: DataFrame) -> DataFrame:
    """(v, w) of every id from 0 to the largest: edges + 2, as a part's offsets span all ids of its range, with edges or without."""
    top = o.agg(F.max(F.greatest("src", "dst"))).first()[0]
    ids = o.sparkSession.range(0 if top is None else top + 1).withColumnRenamed("id", "v")
    return ids.join(o.groupBy(F.col("src").alias("v")).count(), "v", "left").select("v", (F.coalesce("count", F.lit(0)) + 2).alias("w"))


def row_cuts(o: DataFrame, parts: int) -> DataFrame:
    """R1, R3 by share: rows with about equal weight, edges + 2 * vertices of the id range."""
    return cut_points(id_weights(o), parts)


def part_of(v: Column, cuts: list[int]) -> Column:
    """Number of cuts below v: a range lookup in a few constants."""
    return F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c < v)).cast("long")


def bounds(cuts: DataFrame) -> list[int]:
    """Upper ends of all parts but the last; a row per part, as many as asked for."""
    return [r.hi for r in cuts.orderBy("part").collect()][:-1]


def greedy_row_cuts(o: DataFrame, columns: Column, size: int) -> list[int]:
    """Rows taken as long as in every column edges + 2 * ids of the range stay within size; each row part's last id.

    columns: a number for each edge's column part. Each cut is one aggregation over running edge counts by
    column: in a column the weight grows with every id, so the last id that fits lies between two rows with
    edges, or right before the first that doesn't fit. Only a row a column comes to the driver for each cut.
    """
    cells = o.groupBy(F.col("src").alias("v"), columns.alias("k")).agg(F.count("*").alias("w"))
    run = kept(running_total(cells, "v", "w", ("k",)).withColumnRenamed("total", "cum"), "row-weights")
    ids = o.agg(F.max(F.greatest("src", "dst"))).first()[0]
    out: list[int] = []
    low = 0
    while ids is not None and low <= ids:
        past = run.where(F.col("v") < low).groupBy("k").agg(F.max("cum").alias("base"))
        rest = run.where(F.col("v") >= low).join(past, "k", "left").withColumn("n", F.col("cum") - F.coalesce("base", F.lit(0)))
        fits = F.col("n") + 2 * (F.col("v") - low + 1) <= size
        found = rest.groupBy("k").agg(F.max(F.when(fits, F.col("n"))).alias("held"), F.min(F.when(~fits, F.col("v"))).alias("over")).collect()
        ends = [min(r.over - 1 if r.over is not None else ids, low - 1 + (size - (r.held or 0)) // 2) for r in found]
        last = min([ids, low - 1 + size // 2, *ends])
        out.append(max(last, low))  # an id that alone exceeds the size still makes a part
        low = out[-1] + 1
    return out


def per_column_row_cuts(o: DataFrame, columns: Column, parts: int) -> DataFrame:
    """(k, part, hi): balanced rows inside each column part."""
    cells = o.groupBy(columns.alias("k"), F.col("src").alias("v")).agg(F.count("*").alias("w"))
    whole = cells.groupBy("k").agg(F.sum("w").alias("_all"))  # a row a part
    part = F.least(F.floor((F.col("total") - 1) * parts / F.col("_all")), F.lit(parts - 1)).cast("long")
    run = running_total(cells, "v", "w", ("k",)).join(F.broadcast(whole), "k")
    return run.select("k", "v", part.alias("part")).groupBy("k", "part").agg(F.max("v").alias("hi"))


def uniform_step(max_id: int, parts: int) -> int:
    """Ids per part, for ids 0..max_id."""
    return max_id // parts + 1


def uniform_part(v: Column, step: int) -> Column:
    return F.floor(v / F.lit(step)).cast("long")


def parts_for_budget(edges: int, cell_size: int) -> int:
    """Parts per side so that a cell of the grid fits the size."""
    return 1 + int(math.sqrt(max(0, edges - 1) / cell_size / 2))


def part_count(edges: Column, cell_size: int) -> Column:
    """parts_for_budget of a column of edge numbers."""
    return (F.floor(F.sqrt(F.floor(F.floor((edges - 1) / F.lit(cell_size)) / 2))) + 1).cast("long")


def cell_sizes(edges: DataFrame, row: Column, column: Column) -> DataFrame:
    """(i, j, n_edges) (K7, K8)."""
    return edges.groupBy(row.alias("i"), column.alias("j")).agg(F.count("*").alias("n_edges"))


def lists_by_column(o: DataFrame, column) -> DataFrame:
    """(src, dst, k, na, nb): edges with both ends' neighbours in each column part, where both have some."""
    part = o.withColumn("k", column(F.col("dst"))).groupBy("src", "k").agg(F.collect_list("dst").alias("nbrs"))
    mine = o.select("src", "dst").join(part.withColumnRenamed("nbrs", "na"), "src")
    return mine.join(part.select(F.col("src").alias("dst"), "k", F.col("nbrs").alias("nb")), ["dst", "k"])


def cell_counts(o: DataFrame, row, column) -> DataFrame:
    """(i, j, k, n_triangles): triangles by row parts of both edge ends and column part of the third.

    row, column: functions from a vertex column to its part. Edge cell (i, j) meets list cells (i, k) and
    (j, k) by vertex and column, so lists of other columns don't meet and no triangle is listed.
    """
    t = lists_by_column(o, column).select(row(F.col("src")).alias("i"), row(F.col("dst")).alias("j"), "k", common("na", "nb").alias("n"))
    return t.where("n > 0").groupBy("i", "j", "k").agg(F.sum("n").alias("n_triangles"))


def one_cell(edge_cells: DataFrame, i: int, j: int, k: int) -> DataFrame:
    """One row, n_triangles of subproblem (i, j, k): edge cells (src, dst, row_part, dst_part, col_part) as written by keys.

    Reads the edges of cell (i, j) and the lists of (i, k) and (j, k) alone, if the cells are folders.
    """
    lists = lambda r: edge_cells.where((F.col("row_part") == r) & (F.col("col_part") == k)).groupBy("src").agg(F.collect_list("dst").alias("nbrs"))
    edges = edge_cells.where((F.col("row_part") == i) & (F.col("dst_part") == j)).select("src", "dst")
    both = edges.join(lists(i).withColumnRenamed("nbrs", "na"), "src").join(lists(j).select(F.col("src").alias("dst"), F.col("nbrs").alias("nb")), "dst")
    return both.agg(F.coalesce(F.sum(common("na", "nb")), F.lit(0)).cast("long").alias("n_triangles"))


def subproblem(i: Column, j: Column, k: Column, rows: int) -> Column:
    """Number of subproblem (i, j, k): rows varies fastest."""
    return (i + rows * (j + rows * k)).cast("long")


def _div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by))


def subproblem_cell(t: Column, rows: int) -> tuple[Column, Column, Column]:
    """(i, j, k) of a subproblem's number."""
    return t % rows, _div(t, rows) % rows, _div(t, rows * rows)


def _triangular(x: Column) -> Column:
    return F.shiftright(x * (x + 1), 1)


def pair_subproblem(lo: Column, hi: Column, k: Column, rows: int) -> Column:
    """Number of the subproblem of cells (lo, hi) and (hi, lo) together: row by row of a triangle, column after column."""
    return (k * (rows * (rows + 1) // 2) + _triangular(hi.cast("long")) + lo).cast("long")


def pair_subproblem_cell(t: Column, rows: int) -> tuple[Column, Column, Column]:
    """(lo, hi, k) of a pair subproblem's number."""
    size = rows * (rows + 1) // 2
    p = (t % size).cast("long")
    near = F.floor((F.sqrt(8 * p + 1) - 1) / 2).cast("long")  # then set right, should the root be rounded
    hi = near + F.when(_triangular(near + 1) <= p, 1).when(_triangular(near) > p, -1).otherwise(0)
    return p - _triangular(hi), hi, _div(t, size)


def pair_counts(cells: DataFrame) -> DataFrame:
    """Cells (i, j) and (j, i) together."""
    return cells.groupBy(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "k").agg(F.sum("n_triangles").alias("n_triangles"))


def column_counts(o: DataFrame, column) -> DataFrame:
    """(k, n_triangles): J22, by part of the common neighbour; lists are split by column, so none is long."""
    return lists_by_column(o, column).groupBy("k").agg(F.sum(common("na", "nb")).cast("long").alias("n_triangles"))


def part_chunk_counts(o: DataFrame, column, size: int) -> DataFrame:
    """(k, chunk, n_triangles): the matrix of partial counts by column part and chunk of the edge list.

    An edge's chunk is told by its place in its source's sorted list and by where that list begins, so edges
    are not joined to their chunks; targets' lists are met block by block, and a pass leaves partial counts.
    """
    from .triangles import by_blocks, kept_lists

    lists, blocks = kept_lists(o)
    starts = running_total(lists.select(F.col("src").alias("v"), F.size("nbrs").cast("long").alias("deg")), "v", "deg").select(F.col("v").alias("src"), (F.col("total") - F.col("deg")).alias("_begin"))
    placed = kept(lists.join(starts, "src"), "placed-lists")
    edges = placed.select("_begin", F.posexplode("nbrs").alias("pos", "dst"), F.col("nbrs").alias("na"))
    targets = lists.select(F.col("src").alias("dst"), F.col("nbrs").alias("nb"))

    def counts(t: DataFrame) -> DataFrame:
        chunk = F.floor((F.col("_begin") + F.col("pos")) / F.lit(size)).cast("long")
        thirds = t.select(chunk.alias("chunk"), F.explode(F.array_intersect("na", "nb")).alias("c"))
        return thirds.groupBy(column(F.col("c")).alias("k"), "chunk").agg(F.count("*").alias("n"))

    return by_blocks(edges, "dst", targets, blocks, counts).groupBy("k", "chunk").agg(F.sum("n").alias("n_triangles"))


def cell_check(edges: DataFrame, row: Column, column: Column, cells: DataFrame) -> DataFrame:
    """One row, n_violations: edges outside the id ranges of the cell that holds them.

    cells: (axis, part, lo, hi), a row for each part.
    """
    placed = edges.withColumns({"i": row, "j": column})
    rows = cells.where("axis = 'row'").select(F.col("part").alias("i"), F.col("lo").alias("rlo"), F.col("hi").alias("rhi"))
    columns = cells.where("axis = 'column'").select(F.col("part").alias("j"), F.col("lo").alias("clo"), F.col("hi").alias("chi"))
    inside = F.col("src").between(F.col("rlo"), F.col("rhi")) & F.col("dst").between(F.col("clo"), F.col("chi"))
    joined = placed.join(rows, "i", "left").join(columns, "j", "left")
    return joined.agg(F.coalesce(F.sum(F.when(F.coalesce(inside, F.lit(False)), 0).otherwise(1)), F.lit(0)).alias("n_violations"))


def chunk_of(edges: DataFrame, size: int) -> DataFrame:
    """(src, dst, chunk): runs of size edges in order (R10, S15); numbered by running degree, no global sort."""
    from .degree import degree, neighbour_rank

    starts = running_total(degree(edges), "v", "deg").select(F.col("v").alias("src"), (F.col("total") - F.col("deg")).alias("_begin"))
    return neighbour_rank(edges).join(starts, "src").select("src", "dst", F.floor((F.col("_begin") + F.col("pos")) / F.lit(size)).cast("long").alias("chunk"))


def chunk_counts(o: DataFrame, size: int) -> DataFrame:
    """(chunk, n_edges, n_triangles): partial counts by chunk."""
    from .triangles import edge_lists

    lists = edge_lists(o, "left").select("src", "dst", F.coalesce(F.size(F.array_intersect("na", "nb")), F.lit(0)).alias("t"))
    t = lists.withColumn("t", F.greatest("t", F.lit(0)))
    return chunk_of(o, size).join(t, ["src", "dst"]).groupBy("chunk").agg(F.count("*").alias("n_edges"), F.sum("t").cast("long").alias("n_triangles"))
