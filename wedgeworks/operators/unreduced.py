"""The count on the symmetric graph, in which no edge is left out and none has a direction.

Without an order every list is as long as its vertex's degree, so lists that travel with edges, or a pass over
all of them for each small block, cost far more than the graph. Here lists are packed into parts of about PART
edges each by a hash of their vertex, as two arrays: one shuffle of ids. Every pair of parts then meets once in
a task that reads both from where they were written; nothing is shuffled, broadcast or written but its count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import scratch_path

#: Directed edges of a part: 16 MB of ids below 2^31.
PART = 4_000_000
SMALL_PART = 100_000
#: Rows and slots a row (as bits) of the table in which a batch of lists is looked up: 2 MB.
ROWS, BITS = 64, 13
#: Elements of targets' lists that are looked up at once, beyond a single list.
WEDGES = 1 << 20
#: Bytes of an Arrow batch: no more than a pair of parts at a time.
BATCH = 16 << 20


def parts_for(edges: int, cores: int) -> int:
    """Parts of PART edges; fewer each where the pairs would leave cores idle, but SMALL_PART at least."""
    return max(1, -(-edges // PART), min(edges // SMALL_PART, math.isqrt(2 * cores) + 1))


def part_of(v: np.ndarray, parts: int) -> np.ndarray:
    """Part of each vertex: the high half of a multiplicative hash, scaled."""
    h = v.astype("u8")
    h *= np.uint64(0x9E3779B97F4A7C15)
    h >>= np.uint64(32)
    h *= np.uint64(parts)
    h >>= np.uint64(32)
    return h


def packed(a: np.ndarray) -> bytes:
    """Ids in 4 bytes each if all fit, else in 8; the last byte says which."""
    width = 4 if not len(a) or (a.min() >= 0 and a.max() < 1 << 31) else 8
    return a.astype(f"i{width}").tobytes() + bytes([width])


def unpacked(value: pa.BinaryScalar) -> np.ndarray:
    b = memoryview(value.as_buffer())
    return np.frombuffer(b, f"i{b[-1]}", len(b) // b[-1])


def dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(part, srcs, dsts): a task's edges by part of their source, packed; loops are dropped."""

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        src, dst = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("src", "dst"))
        part = part_of(src, parts).astype("u2" if parts <= 1 << 16 else "u8")
        part[loops := src == dst] = 0
        order = np.argsort(part, kind="stable")
        order = order[~loops[order]]
        ends = np.searchsorted(part[order], np.arange(parts), "right")
        cut = [(p, order[a:b]) for p, (a, b) in enumerate(zip([0, *ends[:-1]], ends)) if a < b]
        return pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in cut], pa.int32()), "srcs": pa.array([packed(src[x]) for _, x in cut], pa.binary()), "dsts": pa.array([packed(dst[x]) for _, x in cut], pa.binary())})

    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= PART:
            yield rows(held)
            held, n = [], 0
    if held:
        yield rows(held)


def listed(part: int, edges: pa.Table) -> pa.Table:
    """A part's sorted lists, one after the other: repeated edges are dropped here, where they meet."""
    src, dst = (np.concatenate([unpacked(x) for x in edges.column(c)]) for c in ("srcs", "dsts"))
    del edges
    if src.itemsize == dst.itemsize == 4:
        key = src.astype("i8") << 32
        key |= dst
        key.sort()
        src, dst = (key >> 32).astype("i4"), (key & 0x7FFFFFFF).astype("i4")
        del key
    else:
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
    new = np.ones(len(src), bool)
    new[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    if not new.all():
        src, dst = src[new], dst[new]
    first = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
    sizes = np.diff(np.append(first, len(src)))
    row = {"part": [part], "longest": [int(sizes.max())], "srcs": [packed(src[first])], "sizes": [packed(sizes)], "nbrs": [packed(dst)]}
    return pa.table({k: pa.array(v, {"part": pa.int32(), "longest": pa.int64()}.get(k, pa.binary())) for k, v in row.items()})


def shared(sizes: np.ndarray, nbrs: np.ndarray, to: int, to_srcs: np.ndarray, to_sizes: np.ndarray, to_nbrs: np.ndarray, parts: int) -> int:
    """Common neighbours of both ends, summed over the edges from the lists of one part to the vertices of part to.

    A batch of lists is written into a table by row and low bits of the id; the elements of all its targets'
    lists look themselves up there. A slot that holds another id is settled by binary search, so the sum is exact.
    """
    ends, to_ends = np.cumsum(sizes, dtype="i8"), np.cumsum(to_sizes, dtype="i8")
    starts = ends - sizes
    at = np.flatnonzero(part_of(nbrs, parts) == to)
    row = np.searchsorted(to_srcs, nbrs[at])
    is_there = to_srcs[np.minimum(row, len(to_srcs) - 1)] == nbrs[at]
    at, row = at[is_there], row[is_there]
    u = np.searchsorted(ends, at, "right")
    lens = to_sizes[row].astype("i8")
    upto = np.cumsum(lens)
    shift = to_ends[row] - upto  # from an element's place in the batch's lists to its place in to_nbrs
    table = np.full(ROWS << BITS, -1, "i4")
    steps, mask = np.arange(WEDGES), (1 << BITS) - 1
    found, i, done = 0, 0, 0
    while i < len(at):
        j = max(i + 1, min(int(np.searchsorted(u, u[i] + ROWS)), int(np.searchsorted(upto, done + WEDGES, "right"))))
        low, high, n = u[i], u[j - 1] + 1, int(upto[j - 1]) - done
        held = nbrs[starts[low] : ends[high - 1]]
        slots = np.repeat(np.arange(high - low) << BITS, sizes[low:high]) + (held & mask)
        table[slots] = np.arange(starts[low], ends[high - 1])
        places = np.repeat(shift[i:j] + done, lens[i:j])
        places += steps[:n] if n <= WEDGES else np.arange(n)
        w = to_nbrs[places]
        asked = np.repeat((u[i:j] - low) << BITS, lens[i:j])
        asked += w & mask
        place = table[asked]
        hit = np.flatnonzero(place >= 0)
        wanted = w[hit]
        same = nbrs[place[hit]] == wanted
        found += int(np.count_nonzero(same))
        other = ~same
        wanted, line = wanted[other], low + (asked[hit[other]] >> BITS)
        a, b = starts[line], ends[line]
        for _ in range(int(sizes[low:high].max()).bit_length()):
            middle = np.minimum((a + b) >> 1, len(nbrs) - 1)
            before = (nbrs[middle] < wanted) & (a < b)
            a, b = np.where(before, middle + 1, a), np.where(before, b, np.minimum(middle, b))
        found += int(np.count_nonzero((a < ends[line]) & (nbrs[np.minimum(a, len(nbrs) - 1)] == wanted)))
        table[slots] = -1
        i, done = j, done + n
    return found


def met(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(n): shared of each pair of parts."""
    for b in batches:
        for i in range(b.num_rows):
            get = lambda c: unpacked(b.column(c)[i])  # noqa: B023, E731
            n = shared(get("sizes"), get("nbrs"), b.column("to")[i].as_py(), get("to_srcs"), get("to_sizes"), get("to_nbrs"), parts)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})


def packed_lists(u: DataFrame, parts: int) -> DataFrame:
    """(part, longest, srcs, sizes, nbrs), a written table with a file for each part; longest: its longest list."""
    schema = "part int, longest long, srcs binary, sizes binary, nbrs binary"
    edges = u.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).mapInArrow(lambda bs: dealt(bs, parts), "part int, srcs binary, dsts binary")
    lists = edges.groupBy("part").applyInArrow(lambda key, t: listed(key[0].as_py(), t), schema)
    path = scratch_path(u.sparkSession, "parts")
    lists.write.option("maxRecordsPerFile", 1).parquet(path)
    return u.sparkSession.read.schema(schema).parquet(path)


def common_neighbours(lists: DataFrame, parts: int) -> DataFrame:
    """(n): common neighbours summed over directed edges, a row for each pair of parts; each triangle is met six times."""
    conf = lists.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "2147483647")) > BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    to = lists.select(F.col("part").alias("to"), *[F.col(c).alias(f"to_{c}") for c in ("srcs", "sizes", "nbrs")])
    pairs = lists.select("sizes", "nbrs").hint("shuffle_replicate_nl").crossJoin(to)
    return pairs.mapInArrow(lambda bs: met(bs, parts), "n long")
