import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wedgeworks import cli
from wedgeworks.operators import build, degree, orient, partition, traversal, triangles
from wedgeworks.sources import edges as source
from wedgeworks.sources.scratch import kept

TOYS = {  # edges, vertices, undirected edges, triangles, directed edges on a triangle
    "two_tails": ([(0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (1, 4), (3, 4), (5, 6), (1, 0), (2, 0)], 7, 8, 3, 14),
    "loops": ([(1, 1), (2, 3), (4, 4), (3, 5), (9, 9)], 3, 2, 0, 0),
    "k5": (list(itertools.combinations(range(5), 2)), 5, 10, 10, 20),
    "star": ([(0, i) for i in range(1, 8)], 8, 7, 0, 0),
    "repeats": ([(7, 8), (8, 9), (9, 7), (8, 7), (7, 8), (7, 9)], 3, 3, 1, 6),
    "large_ids": ([(1_000_001, 2_000_002), (2_000_002, 3_000_003), (3_000_003, 1_000_001)], 3, 3, 1, 6),
    "one_edge": ([(1, 2)], 2, 1, 0, 0),
    "empty": ([], 0, 0, 0, 0),
}


def frame(spark, rows):
    return spark.createDataFrame([(int(a), int(b)) for a, b in rows], "src long, dst long")


def rows(df):
    return sorted(map(tuple, df.collect()))


def brute(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near, sorted(t for t in itertools.combinations(sorted(near), 3) if t[1] in near[t[0]] and t[2] in near[t[0]] and t[2] in near[t[1]])


def random_graph(seed, n=25, m=90):
    rng = random.Random(seed)
    return [(rng.randrange(n), min(rng.randrange(n), rng.randrange(n))) for _ in range(m)]


@pytest.mark.parametrize("name", TOYS)
def test_toys(spark, name):
    raw, v, e, t, on = TOYS[name]
    pairs = build.undirected(frame(spark, raw))
    assert pairs.count() == e and degree.degree_undirected(pairs).count() == v
    assert triangles.count_array(orient.by_degree(pairs)).first()[0] == t
    assert triangles.triangle_edges(orient.by_degree(pairs)).first()[0] == on


@pytest.mark.parametrize("seed", [1, 2])
def test_every_algorithm_agrees_with_brute_force(spark, seed):
    raw = random_graph(seed)
    near, want = brute(raw)
    pairs = build.undirected(frame(spark, raw)).cache()
    for o in (orient.by_degree(pairs), orient.by_id(pairs), orient.by_reverse_degree(pairs), orient.trimmed(pairs, 0)):
        assert o.count() == pairs.count()
        assert {f(o).first()[0] for f in (triangles.count_array, triangles.count_join, triangles.count_split)} == {len(want)}
        assert triangles.count_split(o, 3).first()[0] == triangles.count_hybrid(o, 2).first()[0] == len(want)
    u = build.clean(frame(spark, raw))
    assert triangles.count_unreduced(u).first()[0] == triangles.count_unreduced(u, 4).first()[0] == len(want)
    o = orient.by_degree(pairs)
    assert rows(triangles.list_triangles(o)) == rows(triangles.list_by_wedges(o))
    assert sorted(tuple(sorted(t)) for t in triangles.list_triangles(o).collect()) == want
    side = lambda a, b: sum({a, b} <= set(t) for t in want)
    assert rows(triangles.edge_support(o)) == sorted((a, b, side(a, b)) for a, b in rows(o))
    assert triangles.triangle_edges(o).first()[0] == 2 * sum(side(a, b) > 0 for a, b in rows(o))
    assert triangles.source_credit(o).agg(F.sum("credit")).first()[0] == len(want)
    per = dict(rows(triangles.vertex_triangles(o)))
    assert per == {v: n for v in near if (n := sum(v in t for t in want))}
    for r in triangles.clustering(pairs, o).collect():
        d = len(near[r.v])
        assert r.local == (per.get(r.v, 0) / (d * (d - 1) / 2) if d > 1 else 0)
    pairs.unpersist()


@pytest.mark.parametrize(("rows_", "columns"), [(1, 1), (3, 2), (4, 5)])
def test_parts_add_up(spark, rows_, columns):
    raw = random_graph(3)
    want = len(brute(raw)[1])
    o = orient.by_degree(build.undirected(frame(spark, raw)))
    rc, cc = partition.bounds(partition.row_cuts(o, rows_)), partition.bounds(partition.column_cuts(o, columns))
    cells = partition.cell_counts(o, lambda v: partition.part_of(v, rc), lambda v: partition.part_of(v, cc))
    total = F.sum("n_triangles")
    assert cells.agg(total).first()[0] == partition.pair_counts(cells).agg(total).first()[0] == want
    assert partition.column_counts(o, lambda v: partition.part_of(v, cc)).agg(total).first()[0] == want
    matrix = partition.part_chunk_counts(o, lambda v: partition.part_of(v, cc), 7)
    assert matrix.agg(total).first()[0] == want
    counted = {tuple(r)[:3]: r[3] for r in cells.collect()}
    t = partition.subproblem(F.col("i"), F.col("j"), F.col("k"), rows_)
    for r in cells.select("i", "j", "k", *partition.subproblem_cell(t, rows_)).collect():
        assert tuple(r)[:3] == tuple(r)[3:]
    placed = o.select("*", partition.part_of(F.col("src"), rc).alias("row_part"), partition.part_of(F.col("dst"), rc).alias("dst_part"), partition.part_of(F.col("dst"), cc).alias("col_part"))
    for cell in [(0, 0, 0), (rows_ - 1, 0, columns - 1)]:
        assert partition.one_cell(placed, *cell).first()[0] == counted.get(cell, 0)
    chunks = partition.chunk_counts(o, 7)
    assert chunks.agg(total).first()[0] == want and chunks.agg(F.max("n_edges")).first()[0] == 7


def test_pair_subproblems_are_numbered_row_by_row(spark):
    n, k = 5, 3
    t = F.col("id")
    got = [tuple(r) for r in spark.range(n * (n + 1) // 2 * k).select(t, *partition.pair_subproblem_cell(t, n)).orderBy("id").collect()]
    want = [(lo, hi, c) for c in range(k) for hi in range(n) for lo in range(hi + 1)]
    assert [r[1:] for r in got] == want
    back = spark.createDataFrame(want, "lo long, hi long, k long").select(partition.pair_subproblem(F.col("lo"), F.col("hi"), F.col("k"), n))
    assert sorted(r[0] for r in back.collect()) == list(range(len(want)))
    far = spark.range(1).select(*partition.pair_subproblem_cell(F.lit(10**9 * (10**9 + 1) // 2 - 1), 2 * 10**9)).first()
    assert tuple(far) == (10**9 - 1, 10**9 - 1, 0)


def test_greedy_cuts_fit_and_are_longest(spark):
    o = orient.by_degree(build.undirected(frame(spark, random_graph(4)))).cache()
    size = 20
    cuts = partition.greedy_row_cuts(o, F.col("dst") % 2, size)
    edges, want, low = rows(o), [], 0
    top = max(max(e) for e in edges)
    while low <= top:  # the weight counts every id of the range, with edges or without
        weight = lambda r: max(sum(d % 2 == k and low <= s <= r for s, d in edges) + 2 * (r - low + 1) for k in (0, 1))  # noqa: E731, B023
        want.append(max([low, *(r for r in range(low, top + 1) if weight(r) <= size)]))
        low = want[-1] + 1
    assert cuts == want
    assert partition.greedy_row_cuts(o.limit(0), F.col("dst") % 2, size) == []


def test_offsets_ranks_and_quality(spark):
    raw = random_graph(5)
    near, _ = brute(raw)
    u = build.clean(frame(spark, raw))
    begin, want = 0, []
    for v in sorted(near):
        want.append((v, len(near[v]), begin))
        begin += len(near[v])
    assert rows(degree.csr_offsets(u)) == want
    assert rows(degree.neighbour_rank(u)) == sorted((v, d, i) for v in near for i, d in enumerate(sorted(near[v])))
    q = build.quality(frame(spark, raw)).first()
    assert tuple(q) == (len(raw), sum(a == b for a, b in raw), sum(a != b for a, b in raw) - sum(map(len, near.values())) // 2)
    assert degree.graph_stats(u).first().n_edges == begin


def test_cells_and_step(spark):
    u = build.clean(frame(spark, random_graph(6)))
    n = partition.uniform_step(24, 4)
    named = spark.createDataFrame([(a, i, i * n, i * n + n - 1) for a in ("row", "column") for i in range(4)], "axis string, part long, lo long, hi long")
    part = lambda c: partition.uniform_part(F.col(c), n)
    assert partition.cell_check(u, part("src"), part("dst"), named).first()[0] == 0
    assert partition.cell_check(u, part("src") + 1, part("dst"), named).first()[0] == u.count()
    assert partition.cell_sizes(u, part("src"), part("dst")).agg(F.sum("n_edges")).first()[0] == u.count()
    assert partition.parts_for_budget(1_000_001, 5_000) == 11


def test_search_and_betweenness(spark):
    raw = random_graph(7, 20, 30)
    near, _ = brute(raw)
    start = sorted(near)[:3]
    u = build.clean(frame(spark, raw))
    s = spark.createDataFrame([(v,) for v in start], "s long")
    want, bc = [], {}
    for a in start:
        level, sigma, order = {a: 0}, {a: 1.0}, [a]
        for v in order:
            for w in near[v]:
                if w not in level:
                    level[w], sigma[w] = level[v] + 1, 0.0
                    order.append(w)
                if level[w] == level[v] + 1:
                    sigma[w] += sigma[v]
        want += [(a, v, level[v], sigma[v]) for v in order]
        delta = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if level[v] == level[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != a:
                bc[w] = bc.get(w, 0) + delta[w]
    assert rows(traversal.levels(u, s)) == sorted(want)
    got = {v: b for v, b in traversal.betweenness(u, s).collect()}
    assert got.keys() == bc.keys() and all(abs(got[v] - bc[v]) < 1e-9 for v in bc)


def test_text_and_binary(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("# from to\n% more\n3\t4\n4 5 0.5\n\n  5   5 \nno numbers\n3 4")
    (tmp_path / "in" / "b.txt").write_text("")
    path = str(tmp_path / "in")
    assert rows(source.read_edge_text(spark, path)) == [(3, 4), (3, 4), (4, 5), (5, 5)]
    assert rows(source.read_edge_text(spark, path, shift=True)) == [(0, 1), (0, 1), (1, 2), (2, 2)]
    assert source.read_edge_text(spark, path, symmetric=True).count() == 8
    (tmp_path / "m.txt").write_text("%%header\n9 9 2\n1 2 1.0\n2 3 1.0\n")
    assert rows(source.read_edge_text(spark, str(tmp_path / "m.txt"), skip_rows=1)) == [(1, 2), (2, 3)]
    edges = build.clean(frame(spark, [(0, 1), (1, 3), (3, 3)]))
    for part_edges in (1 << 23, 2, 1):
        folder = tmp_path / f"csr{part_edges}"
        parts = source.write_csr(edges, str(folder), part_edges).orderBy("part").collect()
        whole = lambda name, kind: np.concatenate([np.fromfile(f, kind) for f in sorted(folder.glob(f"{name}-*.bin"))]).tolist()  # noqa: E731, B023
        assert whole("begin", "<i8") == [0, 1, 3, 3, 4] and whole("adjacent", "<i4") == [1, 0, 3, 1] and whole("head", "<i4") == [0, 1, 1, 3] and whole("degree", "<i4") == [1, 2, 0, 1]
        assert parts[0].lo == 0 and parts[-1].hi == 3 and all(a.hi + 1 == b.lo for a, b in itertools.pairwise(parts))
        assert rows(source.read_csr(str(folder), spark)) == rows(source.read_csr(str(folder), spark, head=True)) == rows(edges)
    (folder / "adjacent-00009.bin").write_bytes(bytes(4))
    with pytest.raises(ValueError, match="offsets end at 4"):
        source.read_csr(str(folder), spark)
    assert source.write_csr(edges.limit(0), str(tmp_path / "none")).count() == 0 and source.read_csr(str(tmp_path / "none"), spark).count() == 0
    star = frame(spark, [(7, i) for i in range(8, 400)])
    source.write_csr(star, str(tmp_path / "star"), vertex=8)
    assert rows(source.read_csr(str(tmp_path / "star"), spark, vertex=8, block=50)) == rows(star)
    assert source.write_tuples(edges.repartition(3), str(tmp_path / "t")) == 4
    assert rows(source.read_tuple_bin(spark, str(tmp_path / "t" / "part-*.bin"))) == rows(edges)
    source.write_adjacency_text(edges, str(tmp_path / "adj"))
    assert [r.value for r in spark.read.text(str(tmp_path / "adj")).collect()] == "AdjacencyGraph 4 4 0 1 3 3 1 0 3 1".split()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "g.txt").write_text("0 1\n1 2\n2 0\n")
    p = lambda name: str(tmp_path / name)
    import argparse

    def go(mode, a, b=None, **more):
        base = {"undirected": False, "shift": False, "skip_rows": 0, "order": "degree", "parts": 2, "directed": False, "part_edges": 2}
        return cli.run(spark, argparse.Namespace(mode=mode, input=a, output=b, **base | more))

    go("text", p("g.txt"), p("e"))
    go("clean", p("e"), p("c"))
    go("orient", p("c"), p("o"))
    go("cells", p("c"), p("cells"))
    assert go("count", p("c")).first()[0] == 1
    assert spark.read.parquet(p("o")).count() == 3 and spark.read.parquet(p("cells")).count() == 6
    assert go("degrees", p("c")).count() == 3 and go("show", p("c")).count() == 3
    go("tuples", p("e"), p("t"))
    go("tuples2csr", p("t"), p("u"))
    go("csr", p("u"), p("back"))
    assert rows(spark.read.parquet(p("back"))) == rows(spark.read.parquet(p("c")))
    go("tuples2csr", p("t"), p("d"), directed=True)
    assert rows(source.read_csr(p("d"), spark)) == [(0, 1), (1, 2), (2, 0)]
    assert rows(source.read_csr(p("d"), spark, names=("in-begin*.bin", "in-adjacent*.bin", "in-head*.bin"))) == [(0, 2), (1, 0), (2, 1)]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the order tables")
@pytest.mark.parametrize(("sparse", "edges", "n", "vertices"), [(False, 8899, 125_968, 200), (True, 1325, 2038, 193)])
def test_known_answers(spark, sparse, edges, n, vertices):
    pairs = build.undirected(source.copurchase_pairs(spark, SF, sparse)).cache()
    assert pairs.count() == edges and degree.degree_undirected(pairs).count() == vertices
    assert triangles.count_array(orient.by_degree(pairs)).first()[0] == n
    if sparse:
        for k, trimmed in ((8, 1772), (16, 368), (64, 6)):
            assert triangles.count_array(orient.trimmed(pairs, k)).first()[0] == trimmed
        assert triangles.triangle_edges(orient.by_degree(pairs)).first()[0] == 2626
    else:
        hist = dict(map(tuple, triangles.work_class_hist(orient.by_degree(pairs), 16, 64).collect()))
        assert hist == {"small": 2573, "mid": 6050, "large": 276}
        assert build.quality(source.copurchase_pairs(spark, SF, loops=True)).first()[:2] == (10324, 55)
    pairs.unpersist()


def test_queries_and_oracles_share_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_run_on_the_full_graph(spark):
    from wedgeworks.plans.catalog import QUERIES

    assert QUERIES["triangle_list"](spark, SF).count() == 125_968
    assert QUERIES["edge_text_roundtrip"](spark, SF).count() == 2 * 8899


def test_betweenness_adds_up_all_sources(spark):
    from collections import Counter, deque

    from wedgeworks.plans.catalog import QUERIES

    near = {}
    for r in build.undirected(source.copurchase_pairs(spark, SF)).collect():
        near.setdefault(r.src, []).append(r.dst)
        near.setdefault(r.dst, []).append(r.src)
    want = Counter()
    for s in sorted(near)[:512]:
        level, sigma, order, queue = {s: 0}, Counter({s: 1}), [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in near[v]:
                if w not in level:
                    level[w] = level[v] + 1
                    queue.append(w)
                if level[w] == level[v] + 1:
                    sigma[w] += sigma[v]
        delta = Counter()
        for w in reversed(order):
            for v in near[w]:
                if level[v] == level[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                want[w] += delta[w]
    got = {r.v: r.bc for r in QUERIES["betweenness_sample"](spark, SF).collect()}
    assert got.keys() == near.keys() and all(abs(got[v] - want[v]) < 1e-4 for v in near)


@pytest.mark.parametrize("name", ["betweenness_sample_sparse", "bfs_levels_sparse", "bfs_path_counts_sparse"])
def test_search_queries_stop_where_their_twins_do(spark, tmp_path, name):
    import duckdb

    from wedgeworks.plans.catalog import DEPTH, ORACLES, QUERIES

    n = DEPTH + 4  # a path of parts, an order for each edge
    items = [(8 * i, i + j, j + 1) for i in range(n) for j in (0, 1)]
    path = f"{tmp_path}/lineitem.parquet"
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(path)
    want = duckdb.connect()
    want.execute(f"create view lineitem as select * from '{path}/*.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path))) == sorted(want.execute(ORACLES[name]).fetchall())


def test_blocks_of_lists_lose_nothing(spark, monkeypatch):
    """Graphs of several blocks: lists and closing edges are broadcast a block at a time."""
    monkeypatch.setattr(triangles, "SMALL_GRAPH", 30)
    raw = random_graph(5)
    _, want = brute(raw)
    pairs = build.undirected(frame(spark, raw))
    o = orient.by_degree(pairs)
    assert triangles.kept_lists(o)[1] > 1
    support = {(min(a, b), max(a, b)): n for a, b, n in triangles.edge_support(o).collect()}
    assert support == {tuple(e): sum(set(e) <= set(t) for t in want) for e in pairs.collect()}
    assert triangles.count_hybrid(o, 2).first()[0] == len(want)
    assert triangles.count_unreduced(build.symmetrise(pairs)).first()[0] == len(want)
    part = lambda v: F.pmod(v, F.lit(3))
    assert sum(r.n_triangles for r in partition.part_chunk_counts(o, part, 7).collect()) == len(want)
    assert triangles.count_join(o).first()[0] == len(want)


def shuffled(spark):
    """Bytes that all shuffles of the session have written."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    executors = context.statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def test_unreduced_count_sends_packed_ids(spark):
    """Its shuffle is a few bytes for each edge, also where a task has but one or two of a vertex's neighbours."""
    rng = random.Random(3)
    raw = [(rng.randrange(20_000), rng.randrange(20_000)) for _ in range(100_000)]
    near = {}
    for a, b in raw:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = sum(len(near[a] & near[b]) for a in near for b in near[a]) // 6
    u = kept(build.symmetrise(build.undirected(frame(spark, raw)).repartition(64)), "symmetric")
    before = shuffled(spark)
    assert triangles.count_unreduced(u).first()[0] == want > 0
    assert shuffled(spark) - before < 12 * sum(map(len, near.values()))


HUB = random_graph(7) + [(24, v) for v in range(60)] + [(v, v + 1) for v in range(25, 59)]


@pytest.mark.parametrize("shift", [0, 1 << 40, -(1 << 45)])
def test_unreduced_count_by_parts(spark, monkeypatch, shift):
    """Several parts; a hub; repeats and loops; ids of any size; lists beyond the limit."""
    monkeypatch.setattr(triangles.unreduced, "PART", 60)
    _, want = brute(HUB)
    u = build.symmetrise(frame(spark, [(a + shift, b + shift) for a, b in HUB + HUB[:30]]))
    assert triangles.unreduced.packed_lists(u, 5).count() > 1
    assert triangles.count_unreduced(u).first()[0] == triangles.count_unreduced(u, 8).first()[0] == len(want)
    assert triangles.count_unreduced(u.where("src is null")).first()[0] == 0


@pytest.mark.parametrize("rows, bits, wedges", [(1, 0, 1), (3, 1, 20), (2, 4, 7), (64, 13, 1 << 20)])
@pytest.mark.parametrize("shift", [0, 1 << 40, -(1 << 45)])
def test_batches_and_full_slots_lose_nothing(monkeypatch, rows, bits, wedges, shift):
    """Small batches, and slots of the table that several ids fall into."""
    import pyarrow as pa
    import pyarrow.compute

    from wedgeworks.operators import unreduced

    for name, value in (("ROWS", rows), ("BITS", bits), ("WEDGES", wedges)):
        monkeypatch.setattr(unreduced, name, value)
    near, want = brute(HUB)
    src, dst = (pa.array([e[i] + shift for a, b in HUB for e in ((a, b), (b, a))], pa.int64()) for i in (0, 1))
    dealt = pa.Table.from_batches(unreduced.dealt(iter([pa.RecordBatch.from_arrays([src, dst], ["src", "dst"])]), 3))
    parts = [unreduced.listed(p, dealt.filter(pa.compute.equal(dealt["part"], p))) for p in set(dealt["part"].to_pylist())]
    assert len(parts) > 1 and max(t["longest"][0].as_py() for t in parts) == max(map(len, near.values()))
    get = lambda t, *names: [unreduced.unpacked(t[c][0]) for c in names]
    six = sum(unreduced.shared(*get(a, "sizes", "nbrs"), b["part"][0].as_py(), *get(b, "srcs", "sizes", "nbrs"), 3) for a in parts for b in parts)
    assert six == 6 * len(want)
