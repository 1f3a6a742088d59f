"""Edge lists: SNAP-style text, packed binary tuples, CSR folders, and graphs from order lines."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edge_text(spark: SparkSession, path: str, shift: bool = False, symmetric: bool = False, skip_rows: int = 0) -> DataFrame:
    """(src, dst) from text: two numbers by blanks or tabs; further columns ignored.

    Lines that begin with % or # and lines without two numbers are skipped wherever they stand. path may be
    a file or a folder of files. shift subtracts the smallest id; symmetric adds every edge's reverse;
    skip_rows drops that many leading data lines of a single file (a matrix size line).
    """
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*[%#]"))
    if skip_rows:
        # the size line is the first data line of its file; blocks of a file keep their order
        lines = lines.withColumns({"_file": F.input_file_name(), "_block": F.input_file_block_start(), "_at": F.monotonically_increasing_id()})
        first = lines.where("_block = 0").groupBy("_file").agg(F.sort_array(F.collect_list("_at"))[skip_rows - 1].alias("_last")) if skip_rows > 1 else lines.where(
            "_block = 0"
        ).groupBy("_file").agg(F.min("_at").alias("_last"))
        lines = lines.join(first, "_file").where((F.col("_block") > 0) | (F.col("_at") > F.col("_last")))
    parts = F.split(F.trim(F.translate("value", "\t\r", "  ")), " +")
    edges = lines.select(F.get(parts, 0).try_cast("bigint").alias("src"), F.get(parts, 1).try_cast("bigint").alias("dst")).where("src is not null and dst is not null")
    if symmetric:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return shift_ids(edges) if shift else edges


def shift_ids(edges: DataFrame) -> DataFrame:
    """Subtracts the smallest id from all (P4); the minimum is a scalar subquery."""
    low = edges.agg(F.min(F.least("src", "dst"))).scalar()
    return edges.select((F.col("src") - low).alias("src"), (F.col("dst") - low).alias("dst"))


def read_records(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(pos, record): fixed-length binary records of the files of a path or pattern, numbered on through the files in order of their names.

    There is no DataFrame source of fixed-length records; this is Spark's own, which splits files between
    records and reads from any store, wrapped without Python.
    """
    encoders = spark._jvm.org.apache.spark.sql.Encoders
    numbered = spark.sparkContext._jsc.binaryRecords(path, width).zipWithIndex()
    made = spark._jsparkSession.createDataset(numbered.rdd(), encoders.tuple(encoders.BINARY(), encoders.LONG()))
    return DataFrame(made.toDF(), spark).select(F.col("_2").alias("pos"), F.col("_1").alias("record"))


def little_endian(record: Column, at: int, width: int) -> Column:
    """The integer in bytes at .. at + width of a record; unsigned below 8 bytes."""
    digits = F.concat(*[F.hex(F.substr(record, F.lit(at + i + 1), F.lit(1))) for i in reversed(range(width))])
    return F.conv(digits, 16, -10).cast("long")


def read_tuple_bin(spark: SparkSession, path: str, width: int = 4) -> DataFrame:
    """(src, dst) from files of packed little-endian integer pairs of width bytes each (S18), split between pairs."""
    record = F.col("record")
    return read_records(spark, path, 2 * width).select(little_endian(record, 0, width).alias("src"), little_endian(record, width, width).alias("dst"))


def read_csr(folder: str, spark: SparkSession, offset: int = 8, vertex: int = 4, head: bool = False, names: tuple[str, str, str] = ("begin*.bin", "adjacent*.bin", "head*.bin"), block: int = 1 << 16) -> DataFrame:
    """(src, dst) from a folder of offsets and neighbours, in one file each or in parts in order.

    With head, sources are read from their own file; else an offset's neighbours lie up to the next offset.
    Fails if offsets don't end at the number of neighbours. Neighbours are joined to their sources by
    position; a hub's positions are made in blocks, so no row is longer than block.
    """
    numbers = lambda name, width: read_records(spark, f"{folder}/{name}", width).select("pos", little_endian(F.col("record"), 0, width).alias("x"))
    begin, adjacent = numbers(names[0], offset), numbers(names[1], vertex)
    end, n = begin.agg(F.max_by("x", "pos")).first()[0] or 0, adjacent.count()
    if end != n:
        raise ValueError(f"offsets end at {end}, but there are {n} neighbours")
    targets = adjacent.select("pos", F.col("x").alias("dst"))
    if head:
        return targets.join(numbers(names[2], vertex).select("pos", F.col("x").alias("src")), "pos").select("src", "dst")
    spans = begin.join(begin.select((F.col("pos") - 1).alias("pos"), F.col("x").alias("end")), "pos").where("x < end")
    blocks = spans.select(F.col("pos").alias("src"), "x", "end", F.explode(F.sequence(F.floor(F.col("x") / block), F.floor((F.col("end") - 1) / block))).alias("b"))
    places = F.sequence(F.greatest("x", F.col("b") * block), F.least(F.col("end"), (F.col("b") + 1) * block) - 1)
    return blocks.select("src", F.explode(places).alias("pos")).join(targets, "pos").select("src", "dst")


def copurchase_pairs(spark: SparkSession, sf_dir: str, sparse: bool = False, loops: bool = False) -> DataFrame:
    """Pairs of parts in one order, repeats kept: (src, dst) with src < dst.

    loops: instead all pairs of an earlier and a later line, in that direction, the same part twice included.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber")
    if sparse:  # the second test graph: one order in eight, by definition of that graph
        items = items.where("l_orderkey % 8 = 0")
    other = items.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("n"))
    pairs = items.join(other, "l_orderkey").where("l_linenumber < n" if loops else "l_partkey < dst")
    return pairs.select(F.col("l_partkey").alias("src"), "dst")


def write_edges(edges: DataFrame, path: str) -> None:
    """Columnar edge list (K1, K3)."""
    edges.select("src", "dst").write.parquet(path)


def write_edge_text(edges: DataFrame, path: str) -> None:
    edges.select(F.concat_ws("\t", "src", "dst")).write.text(path)


def write_cells(edges: DataFrame, path: str, *keys: str) -> None:
    """Edges in folders by partition columns, so that a reader prunes to the cells it needs."""
    edges.repartition(*keys).sortWithinPartitions(*keys, "src", "dst").write.partitionBy(*keys).parquet(path)


def write_column_cells(edges: DataFrame, path: str, cuts: dict[int, list[int]]) -> None:
    """Edge cells (i, j, k) by row cuts of each column part k: the edge list is dealt out once for each column.

    cuts: for each column part, the last ids of its row parts but the last.
    """
    from ..operators.partition import part_of

    def placed(k: int) -> Column:
        return F.struct(F.lit(k).alias("k"), part_of(F.col("src"), cuts[k]).alias("i"), part_of(F.col("dst"), cuts[k]).alias("j"))

    cells = edges.select("src", "dst", F.inline(F.array(*[placed(k) for k in sorted(cuts)])))
    write_cells(cells, path, "k", "i", "j")


def adjacency_lines(edges: DataFrame) -> DataFrame:
    """(line, value): the text form of K2, numbered from 0: header, V, E, then V offsets, then E neighbours."""
    from ..operators.degree import csr_offsets, neighbour_rank

    last, e = edges.agg(F.max(F.greatest("src", "dst")), F.count("*")).first()
    v = 0 if last is None else last + 1
    ids = edges.sparkSession.range(v).withColumnRenamed("id", "v")
    head = edges.sparkSession.range(3).select(F.col("id").alias("line"), F.get(F.array(F.lit("AdjacencyGraph"), F.lit(str(v)), F.lit(str(e))), F.col("id").cast("int")).alias("value"))
    starts = csr_offsets(edges, ids)
    offsets = starts.select((F.col("v") + 3).alias("line"), F.col("begin_pos").cast("string").alias("value"))
    placed = neighbour_rank(edges).join(starts.select(F.col("v").alias("src"), "begin_pos"), "src")
    return head.unionByName(offsets).unionByName(placed.select((F.col("begin_pos") + F.col("pos") + 3 + v).alias("line"), F.col("dst").cast("string").alias("value")))


def write_adjacency_text(edges: DataFrame, path: str) -> None:
    """adjacency_lines as text, in order."""
    adjacency_lines(edges).orderBy("line").select("value").write.text(path)


def _put(url: str, pieces: Iterable[bytes]) -> int:
    """Writes a file by a task: under a name of its own first, so that a task that is run again leaves one file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own, size = f"{path}.{uuid.uuid4().hex[:8]}", 0
    with store.open_output_stream(own) as out:
        for piece in pieces:
            out.write(piece)
            size += len(piece)
    store.move(own, path)
    return size


def write_csr(edges: DataFrame, folder: str, part_edges: int = 1 << 23, offset: int = 8, vertex: int = 4, prefix: str = "") -> DataFrame:
    """(part, lo, hi, begin, n_edges): writes a CSR folder by row parts of about part_edges edges, a task a part (K1, K3, K4).

    Part p holds ids lo..hi in begin-p.bin, adjacent-p.bin, head-p.bin and degree-p.bin (names after prefix).
    Offsets run on through the parts and the last one ends them, so the parts in order, one after the other,
    are the files of a single machine's CSR. A directed graph's incoming lists are a second call with
    reversed edges and prefix "in-". folder: a URI of a store that tasks can write to.
    """
    from ..operators.partition import bounds, cut_points, part_of

    url = folder if "://" in folder else f"file://{os.path.abspath(folder)}"
    top, n = edges.agg(F.max(F.greatest("src", "dst")), F.count("*")).first()
    schema = "part bigint, lo bigint, hi bigint, begin bigint, n_edges bigint"
    if top is None:
        _put(f"{url}/{prefix}begin-00000.bin", [bytes(offset)])
        for name in ("adjacent", "head", "degree"):
            _put(f"{url}/{prefix}{name}-00000.bin", [])
        return edges.sparkSession.createDataFrame([], schema)
    cuts = bounds(cut_points(edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("w")), max(1, -(-n // part_edges))))
    cuts = sorted(set(cuts))
    placed = edges.select(part_of(F.col("src"), cuts).alias("part"), "src", "dst")
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}  # a row a part
    layout, at = {}, 0
    for p in range(len(cuts) + 1):
        layout[p] = (cuts[p - 1] + 1 if p else 0, cuts[p] if p < len(cuts) else top, at)
        at += sizes.get(p, 0)

    def put(rows: pa.Table) -> pa.Table:
        p = rows.column("part")[0].as_py()
        lo, hi, start = layout[p]
        src, dst = rows.column("src").to_numpy(), rows.column("dst").to_numpy()
        order = np.lexsort((dst, src))
        degree = np.bincount(src - lo, minlength=hi - lo + 1)
        begin = start + np.concatenate([[0], np.cumsum(degree)])
        files = {"begin": (begin if p == len(cuts) else begin[:-1], offset), "adjacent": (dst[order], vertex), "head": (src[order], vertex), "degree": (degree, 4)}
        for name, (values, width) in files.items():
            _put(f"{url}/{prefix}{name}-{p:05d}.bin", [values.astype(f"<i{width}").tobytes()])
        return pa.table({"part": [p], "lo": [lo], "hi": [hi], "begin": [start], "n_edges": [len(src)]})

    from .scratch import kept

    return kept(placed.groupBy("part").applyInArrow(put, schema), "csr-parts")


def write_tuples(edges: DataFrame, folder: str, vertex: int = 4) -> int:
    """Packed pairs in a file a task, part-<task>.bin, in a folder (S5, S6); returns how many."""
    url = folder if "://" in folder else f"file://{os.path.abspath(folder)}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pieces = (np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1).astype(f"<i{vertex}").tobytes() for b in batches)
        size = _put(f"{url}/part-{TaskContext.get().partitionId():05d}.bin", pieces)
        yield pa.RecordBatch.from_arrays([pa.array([size // (2 * vertex)], pa.int64())], names=["n"])

    return edges.select("src", "dst").mapInArrow(put, "n bigint").agg(F.sum("n")).first()[0] or 0
