"""Command line: convert, clean, orient, split and count graphs.

    python -m wedgeworks.cli MODE INPUT [OUTPUT] [options]

Modes: text (edge text, a file or a folder, to columns), tuples (columns to binary tuples), tuples2csr (a folder of
binary tuples to a CSR folder in row parts, of any size; undirected unless --directed, which writes the incoming
lists as well), csr (binary CSR folder to columns), clean, orient, cells, count, degrees, show.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import build, degree, orient, partition, triangles
from .sources import edges as source


def oriented(edges: DataFrame, order: str) -> DataFrame:
    pairs = build.undirected(edges)
    return {"degree": orient.by_degree, "id": orient.by_id, "reverse": orient.by_reverse_degree}[order](pairs)


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame | None:
    if args.mode == "text":
        out = source.read_edge_text(spark, args.input, args.shift, args.undirected, args.skip_rows)
    elif args.mode == "csr":
        out = source.read_csr(args.input, spark)
    elif args.mode == "tuples2csr":
        edges = source.read_tuple_bin(spark, f"{args.input}/part-*.bin")
        if args.directed:
            source.write_csr(edges, args.output, args.part_edges)
            source.write_csr(build.reverse(edges), args.output, args.part_edges, prefix="in-")
        else:
            source.write_csr(build.symmetrise(edges), args.output, args.part_edges)
        return None
    else:
        edges = spark.read.parquet(args.input)
        if args.mode == "tuples":
            source.write_tuples(edges, args.output)
            return None
        if args.mode == "count":
            return triangles.count_split(oriented(edges, args.order))
        if args.mode == "degrees":
            return degree.degree(edges).orderBy("deg", "v")
        if args.mode == "show":
            return triangles.adjacency(edges).orderBy("src")
        if args.mode == "cells":
            step = partition.uniform_step(edges.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0, args.parts)
            placed = edges.withColumns({"row_part": partition.uniform_part(F.col("src"), step), "col_part": partition.uniform_part(F.col("dst"), step)})
            source.write_cells(placed, args.output, "row_part", "col_part")
            return None
        out = build.clean(edges) if args.mode == "clean" else oriented(edges, args.order)
    source.write_edges(out, args.output)
    return None


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="wedgeworks", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("mode", choices=["text", "tuples", "tuples2csr", "csr", "clean", "orient", "cells", "count", "degrees", "show"])
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("--undirected", action="store_true", help="add every edge's reverse")
    p.add_argument("--shift", action="store_true", help="subtract the smallest id")
    p.add_argument("--skip-rows", type=int, default=0, help="leading data lines to drop, such as a matrix size line")
    p.add_argument("--order", choices=["degree", "id", "reverse"], default="degree")
    p.add_argument("--parts", type=int, default=4)
    p.add_argument("--directed", action="store_true", help="keep directions, and write incoming lists too")
    p.add_argument("--part-edges", type=int, default=1 << 23, help="edges of a row part of a CSR folder")
    args = p.parse_args(argv)
    if args.mode in ("text", "tuples", "tuples2csr", "csr", "clean", "orient", "cells") and not args.output:
        p.error("this mode needs an output path")
    spark = SparkSession.builder.appName("wedgeworks").getOrCreate()
    out = run(spark, args)
    if out is not None:
        out.show(50, truncate=False)


if __name__ == "__main__":
    main()
