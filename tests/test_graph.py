import random
from math import hypot, sqrt

import pytest

from strandline.operators import expand, graph, markers
from tests.conftest import rows


def test_penalties(spark):
    # by (hash, assembly): three classes of presence, an assembly of unknown class, a hash in one assembly twice
    occ = [(10, 0), (10, 0), (10, 1), (10, 2), (20, 1), (40, 2), (60, 1), (60, 3), (70, 4)]
    a = [(0, True), (1, False), (2, True), (3, False), (4, None), (0, True)]
    kmers = spark.createDataFrame(occ, "hash bigint, assembly_idx int")
    assemblies = spark.createDataFrame(a, "assembly_idx int, is_target boolean")
    totals = graph.class_totals(assemblies)
    assert totals == (2, 2)
    got = {r["hash"]: (r["n_occ"], r["n_tar"], r["n_neg"], r["penalty"]) for r in graph.score_nodes(kmers, assemblies, totals).collect()}
    want = {10: (4, 2, 1, 0.5), 20: (1, 0, 1, hypot(1, 0.5)), 40: (1, 1, 0, 0.5), 60: (2, 0, 2, sqrt(2)), 70: (1, 0, 0, 1.0)}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(abs(got[k][3] - want[k][3]) < 1e-12 for k in want)
    with pytest.raises(ValueError):
        graph.class_totals(assemblies.where("is_target"))


def test_offsets_of_assemblies_without_records(spark):
    rec = spark.createDataFrame([(0, 0), (0, 1), (2, 0), (3, 0), (3, 1), (3, 2)], "assembly_idx int, record_no int")
    a = spark.createDataFrame([(i,) for i in range(5)], "assembly_idx int")
    off = graph.record_offsets(rec, a)
    assert rows(off) == [(0, 0, 2), (1, 2, 2), (2, 2, 3), (3, 3, 6), (4, 6, 6)]
    idx = spark.createDataFrame([(i,) for i in range(6)], "record_idx int")
    assert rows(graph.record_assembly(idx, off)) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 3), (5, 3)]


def test_edges_count_assemblies_and_keep_self_loops(spark):
    occ = [(0, 0, 5, 0), (0, 0, 3, 9), (0, 0, 3, 12), (0, 1, 3, 0), (0, 1, 5, 4), (1, 0, 5, 1), (1, 0, 3, 2), (2, 0, 7, 0)]
    kmers = spark.createDataFrame(occ, "assembly_idx int, record_no int, hash bigint, pos bigint")
    e = graph.edges(kmers)
    assert rows(e) == [(3, 3, 1), (3, 5, 2)]
    assert rows(graph.heavy_edges(e, 1.0)) == [(3, 5, 2)]
    assert rows(graph.connected_nodes(graph.count_nodes(kmers), graph.heavy_edges(e, 1.0))) == [(3, 4), (5, 3)]
    assert rows(graph.degrees(e)) == [(3, 3), (5, 1)]
    assert rows(graph.edges(kmers.limit(0))) == []


def test_thresholds():
    t = graph.thresholds(0.35616, 0.25351, 72, 200, 200, None)
    assert abs(t.penalty - 0.15024) < 1e-4 and abs(t.edge_weight - 18.355) < 1e-2 and (t.min_nodes, t.max_nodes) == (3, 100)
    assert graph.thresholds(1, 1, 2, 10, 17, 200).penalty == 0.2
    t = graph.thresholds(1, 1, 2, 10, 17, 200, penalty_th=0.7)
    assert (t.penalty, t.min_nodes, t.max_nodes) == (0.7, 4, 41)


def test_components_grow_as_one_sequential_pass_would(spark):
    r = random.Random(9)
    n = {h: r.choice([0.05, 0.1, 0.3, 0.9]) for h in [r.randint(-(2**62), 2**62) for _ in range(60)]}
    hs = list(n)
    e = {tuple(sorted(r.sample(hs[g : g + 15], 2))) for g in (0, 15, 30, 45) for _ in range(22)}
    adj = {}
    for a, b in e:
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, []).append(a)
    rng = random.Random(42)
    seeds = sorted(h for h in hs if n[h] <= 0.2)
    rng.shuffle(seeds)
    want = expand.grow(adj, n, seeds, 0.2, 3, 6)
    rng.shuffle(want)
    nodes = spark.createDataFrame(list(n.items()), "hash bigint, penalty double")
    edge = spark.createDataFrame([(*x, 1) for x in e], "first bigint, second bigint, weight bigint")
    got = {}
    for x in expand.subgraphs(nodes, edge, 0.2, 3, 6).collect():
        got.setdefault(x["subgraph_id"], set()).add(x["hash"])
    assert [got[i] for i in range(len(got))] == [set(m) for _, m in want] and len(want) > 3
    assert rows(expand.subgraphs(nodes, edge.limit(0), 0.2, 3, 6)) == []


def test_a_small_subgraph_frees_its_nodes():
    pen = {1: 0.0, 2: 0.1, 3: 0.9, 4: 0.1}
    adj = {1: [2], 2: [1, 3], 3: [2, 4], 4: [3]}
    assert expand.grow(adj, pen, [4, 1], 0.2, 2, None) == [(1, [1, 2])]


def test_runs_orders_and_strands(spark):
    occ = [(0, a, 0, h, p) for a in (0, 1) for h, p in ((1, 0), (2, 10), (3, 20))] + [(0, 2, 0, h, p) for h, p in ((3, 5), (2, 9), (1, 12), (1, 900))]
    df = spark.createDataFrame(occ, "subgraph_id bigint, assembly_idx int, record_no int, hash bigint, pos bigint")
    a = spark.createDataFrame([(0, True), (1, True), (2, True)], "assembly_idx int, is_target boolean")
    loc = markers.locations(df, a, 5, 10)
    got = {r["assembly_idx"]: (r["start"], r["stop"], r["n_kmers"], r["kmers"], r["n_repeats"]) for r in loc.collect()}
    assert got == {0: (0, 25, 3, [1, 2, 3], 1), 1: (0, 25, 3, [1, 2, 3], 1), 2: (5, 17, 3, [3, 2, 1], 2)}
    orders = markers.representative_orders(loc)
    assert rows(orders) == [(0, [1, 2, 3], 3)]
    assert [(r["assembly_idx"], r["n_rep"], r["is_bad"]) for r in markers.representatives(loc, orders).collect()] == [(0, 3, False)]
    s = spark.createDataFrame([([1, 2, 3],), ([3, 2, 1],), ([1, 9, 3],), ([3, 9, 1],), ([2],), ([9],), ([1, 3, 2],)], "k array<bigint>")
    from pyspark.sql import functions as F

    rep = F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 3)])
    assert [r[0] for r in s.select(markers.strand(F.col("k"), rep)).collect()] == ["+", "-", "+", "-", "u", "?", "?"]
    # a representative that repeats a k-mer: shared ones have to follow each other in it
    rep = F.array(*[F.lit(x).cast("bigint") for x in (1, 2, 1, 3)])
    s = spark.createDataFrame([([2, 1],), ([1, 3],), ([3, 1, 2],), ([3, 2],), ([2, 9, 1, 3],), ([2, 2],), ([1],), ([3, 1, 2, 1],)], "k array<bigint>")
    assert [r[0] for r in s.select(markers.strand(F.col("k"), rep)).collect()] == ["+", "+", "-", "-", "+", "?", "u", "-"]


def test_orders_of_linear_and_other_subgraphs(spark):
    e = [(0, 1, 2), (0, 2, 3), (1, 1, 2), (1, 2, 3), (1, 3, 1), (2, 1, 2), (2, 2, 3), (2, 3, 5), (2, 2, 4), (2, 4, 5), (2, 5, 6)]
    induced = spark.createDataFrame([(*x, 1) for x in e], "subgraph_id bigint, first bigint, second bigint, weight bigint")
    reps = spark.createDataFrame([(0, [3, 2, 1]), (2, [6, 5, 4, 2, 1])], "subgraph_id bigint, rep array<bigint>")
    got = {r[0]: (r[1], r[2]) for r in graph.graph_orders(induced, reps).collect()}
    assert got == {0: ("1,2,3", ""), 1: ("", "non-linear"), 2: ("1,2,4,5,6", "multi-paths")}


def _simple_paths(adjacent, first, last):
    found, todo = [], [[first]]
    while todo:
        path = todo.pop()
        if path[-1] == last:
            found.append(path)
        else:
            todo += [[*path, n] for n in adjacent[path[-1]] if n not in path]
    return found


def test_longest_path_by_brute_force():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(3, 9)
        adjacent = {i: set() for i in range(n)}
        for _ in range(r.randint(n, 2 * n)):
            a, b = r.randrange(n), r.randrange(n)
            adjacent[a].add(b)
            adjacent[b].add(a)
        paths = _simple_paths(adjacent, 0, n - 1)
        want = min(paths, key=lambda p: (-len(p), p), default=[])
        assert graph.longest_path(adjacent, 0, n - 1) == (want, True)
        blocks = graph.route(adjacent, frozenset(adjacent), 0, n - 1)
        assert any(len(m) > 2 for _, _, m in blocks) == (len(paths) > 1)
        assert all(graph.is_path(p, adjacent, 0, n - 1) for p in paths)


def test_orders_of_more_paths_than_can_be_listed(spark):
    e, last = [], 1
    for _ in range(12):  # 2^12 paths; a bubble's later way is by one node longer
        e += [(last, last + 1), (last + 1, last + 4), (last, last + 2), (last + 2, last + 3), (last + 3, last + 4)]
        last += 4
    e = [(0, 1), *e, (last, last + 1)]
    short, long = [0, 1], [0, 1]
    for at in range(1, last, 4):
        short += [at + 1, at + 4]
        long += [at + 2, at + 3, at + 4]
    short, long = [*short, last + 1], [*long, last + 1]
    late = [*long[:-4], *short[-3:]]
    clique = [(0, 1), *[(a, b) for a in range(1, 15) for b in range(1, a)], (14, 15)]
    rungs = [x for i in range(0, 80, 2) for x in ((i, i + 2), (i + 1, i + 3), (i, i + 1))] + [(80, 81)]
    induced = [(0, e), (1, e), (2, clique), (3, [(-1, 0), *rungs, (81, 82)])]
    induced = spark.createDataFrame([(g, *x, 1) for g, es in induced for x in es], "subgraph_id bigint, first bigint, second bigint, weight bigint")
    reps = spark.createDataFrame([(0, late[::-1]), (1, [5, 4])], "subgraph_id bigint, rep array<bigint>")
    got = {r[0]: (r[1], r[2]) for r in graph.graph_orders(induced, reps).collect()}
    text = lambda p: ",".join(map(str, p))
    assert got[0] == (text(late), "multi-paths")
    assert got[1] == (text(long), "multi-paths,inconsistent")
    assert got[2] == (text(range(16)), "multi-paths,inconsistent")
    assert got[3][1] == "multi-paths,inconsistent" and len(got[3][0].split(",")) == 84


def test_a_search_cut_short_is_told():
    r = random.Random(5)
    adjacent = {i: set() for i in range(40)}
    for a, b in [(0, 1), (38, 39), *[tuple(r.sample(range(1, 39), 2)) for _ in range(90)]]:
        adjacent[a].add(b)
        adjacent[b].add(a)
    path, whole = graph.longest_path(adjacent, 0, 39, most=20)
    assert not whole and graph.is_path(path, adjacent, 0, 39)


def test_input_of_scoring_is_checked(spark):
    a = spark.createDataFrame([(i, i % 2 == 0) for i in range(4)], "assembly_idx int, is_target boolean")
    offsets = lambda *o: spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(o)], "assembly_idx int, first_record bigint, stop_record bigint")
    assert graph.check_offsets(offsets((0, 2), (2, 2), (2, 5), (5, 7)), a) == 7
    for bad in (((0, 2), (2, 4), (4, 5)), ((1, 2), (2, 4), (4, 5), (5, 7)), ((0, 3), (3, 2), (2, 5), (5, 7)), ((0, 2), (3, 4), (4, 5), (5, 7)), ((0, 1), (1, 2), (2, 3), (3, 4), (4, 5))):
        with pytest.raises(ValueError):
            graph.check_offsets(offsets(*bad), a)
    k = lambda *r: spark.createDataFrame([(x,) for x in r], "record_idx int")
    graph.check_records(k(0, 6, 3), 7)
    for bad in (k(0, 7), k(-1), k(None)):
        with pytest.raises(ValueError):
            graph.check_records(bad, 7)


def test_a_graph_is_filtered_and_scored(spark):
    from strandline import api

    rec = spark.createDataFrame([(i, 0, "r", s) for i, s in enumerate(["ACGTTGCATGCCGATAGCTA", "ACGTTGCATGCC", "CCGATAGCTAAG"])], "assembly_idx int, record_no int, record_id string, seq string")
    a = spark.createDataFrame([(0, True), (1, True), (2, False)], "assembly_idx int, is_target boolean")
    g = api.build_graph(rec, a, 5, 2)
    scored = g.get_penalty(a)
    assert scored.columns == ["hash", "n_occ", "n_tar", "n_neg", "penalty"] and scored.count() == g.nodes.count()
    keep = g.nodes.orderBy("hash").limit(4)
    left = {x[0] for x in keep.select("hash").collect()}
    part = g.filter(keep)
    assert {x[0] for x in part.nodes.select("hash").collect()} == left
    assert rows(part.kmers) == [x for x in rows(g.kmers.select(part.kmers.columns)) if x[part.kmers.columns.index("hash")] in left]
    assert rows(part.edges) == [x for x in rows(g.edges) if x[0] in left and x[1] in left]
    nodes = [x["hash"] for x in g.tables()["nodes"].collect()]
    assert nodes == sorted(nodes) and set(g.tables()) == {"kmers", "nodes", "edges", "record_offsets"}
    with pytest.raises(ValueError):
        g.get_penalty(a.where("is_target"))


def test_graphs_as_drawings(spark):
    e = spark.createDataFrame([(1, 5, 7, 3), (1, 7, 9, 1), (2, 4, 4, 2)], "subgraph_id bigint, first bigint, second bigint, weight bigint")
    n = spark.createDataFrame([(1, 5, 0.25), (1, 7, None), (1, 9, 1.0), (2, 4, 0.0), (3, 8, 0.5)], "subgraph_id bigint, hash bigint, penalty double")
    got = dict(rows(graph.drawings(e, n)))
    assert got[1] == 'graph {\n  "5" [label="0.250"];\n  "7" [label="0.000"];\n  "9" [label="1.000"];\n  "5" -- "7" [label="3"];\n  "7" -- "9" [label="1"];\n}\n'
    assert got[3] == 'graph {\n  "8" [label="0.500"];\n}\n' and '"4" -- "4"' in got[2]


def test_scratch_needs_a_shared_folder_off_one_machine():
    from types import SimpleNamespace

    from strandline.session import scratch_root

    conf = SimpleNamespace(get=lambda k, d: None)
    with pytest.raises(RuntimeError):
        scratch_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://h:7077", getCheckpointDir=lambda: None)))
