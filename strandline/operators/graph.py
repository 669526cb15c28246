"""The minimizer graph: nodes, weighted edges, penalties, thresholds and filters."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import edge_pair


def record_offsets(records: DataFrame, assemblies: DataFrame) -> DataFrame:
    """``assembly_idx, first_record, stop_record``: running numbers of an assembly's records; those without record are empty."""
    n = records.select("assembly_idx", "record_no").distinct().groupBy("assembly_idx").agg(F.count("*").alias("n"))
    per = assemblies.select("assembly_idx").distinct().join(n, "assembly_idx", "left")
    w = Window.orderBy("assembly_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row an assembly
    stop = F.sum(F.coalesce("n", F.lit(0))).over(w)
    return per.select("assembly_idx", (stop - F.coalesce("n", F.lit(0))).cast("bigint").alias("first_record"), stop.cast("bigint").alias("stop_record"))


def record_assembly(record_idx: DataFrame, offsets: DataFrame) -> DataFrame:
    """``record_idx, assembly_idx`` by range: the offsets are one row an assembly, and empty ranges hold nothing.

    Ranges and records are cut by the same blocks of numbers, so this is an equi-join with a check, not a nested loop.
    """
    block = 1024
    cut = offsets.where("stop_record > first_record").select(
        "assembly_idx", "first_record", "stop_record",
        F.explode(F.expr(f"sequence(first_record DIV {block}, (stop_record - 1) DIV {block})")).alias("block"),
    )
    r = record_idx.select("record_idx", F.expr(f"CAST(record_idx AS BIGINT) DIV {block}").alias("block"))
    return r.join(cut, "block").where("record_idx >= first_record AND record_idx < stop_record").select("record_idx", "assembly_idx")


def check_offsets(offsets: DataFrame, assemblies: DataFrame) -> int:
    """The number of records that the offsets (assembly_idx, first_record, stop_record) number.

    An error where they do not begin at 0, leave gaps, overlap or shrink, or are not one row for each assembly.
    """
    w = Window.orderBy("assembly_idx")  # one row an assembly
    wrong = (F.col("first_record") != F.coalesce(F.lag("stop_record").over(w), F.lit(0))) | (F.col("stop_record") < F.col("first_record"))
    r = offsets.withColumn("wrong", wrong).agg(F.count_if("wrong").alias("w"), F.count("*").alias("n"), F.max("stop_record").alias("last")).first()
    if r["w"]:
        raise ValueError("record offsets must begin at 0 and follow each other without gaps")
    per = assemblies.select("assembly_idx").distinct()
    if r["n"] != per.count() or not per.join(offsets, "assembly_idx", "left_anti").isEmpty():
        raise ValueError("record offsets must be one row for each assembly")
    return r["last"] or 0


def check_records(kmers: DataFrame, n_records: int) -> None:
    """An error where a k-mer's ``record_idx`` is NULL or none of the ``n_records``."""
    if not kmers.where(F.coalesce((F.col("record_idx") < 0) | (F.col("record_idx") >= n_records), F.lit(True))).isEmpty():
        raise ValueError("a record_idx is outside the record offsets")


def count_nodes(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("hash").agg(F.count("*").alias("n_occ"))


def edges(kmers: DataFrame) -> DataFrame:
    """``first, second, weight``: in how many assemblies two hashes follow each other in a record; self-loops are kept.

    ``kmers`` has assembly_idx, record_no, hash, pos; a window holds one record.
    """
    w = Window.partitionBy("assembly_idx", "record_no").orderBy("pos", "hash")
    a, b = edge_pair(F.col("hash"), F.col("after"))
    step = kmers.withColumn("after", F.lead("hash").over(w)).where("after IS NOT NULL")
    pairs = step.select("assembly_idx", a.alias("first"), b.alias("second")).distinct()
    return pairs.groupBy("first", "second").agg(F.count("*").alias("weight"))


def class_counts(assemblies: DataFrame) -> tuple[int, int]:
    """(targets, non-targets); an assembly of unknown class counts in neither."""
    r = assemblies.select("assembly_idx", "is_target").distinct().agg(F.count_if("is_target"), F.count_if(~F.col("is_target"))).first()
    return r[0], r[1]


def class_totals(assemblies: DataFrame) -> tuple[int, int]:
    """As :func:`class_counts`; an error where a class has no assembly."""
    n = class_counts(assemblies)
    if not all(n):
        raise ValueError("at least one target and one non-target assembly are needed")
    return n


def score_nodes(kmers: DataFrame, assemblies: DataFrame, totals: tuple[int, int]) -> DataFrame:
    """``hash, n_occ, n_tar, n_neg, penalty`` of every node.

    Occurrences are first reduced to (hash, assembly), so a hash that holds many rows is one row an assembly, and the
    distinct counts become plain sums. The penalty multiplies by reciprocals as the published definition does.
    """
    flag = assemblies.select("assembly_idx", "is_target").distinct()
    per = kmers.groupBy("hash", "assembly_idx").agg(F.count("*").alias("n")).join(flag, "assembly_idx", "left")
    node = per.groupBy("hash").agg(
        F.sum("n").alias("n_occ"), F.count_if("is_target").cast("int").alias("n_tar"), F.count_if(~F.col("is_target")).cast("int").alias("n_neg")
    )
    return node.withColumn("penalty", penalty(F.col("n_tar"), F.col("n_neg"), totals))


def penalty(n_tar, n_neg, totals: tuple[int, int]):
    """A class without assemblies is one in which no node is found."""
    absent, present = F.lit(1.0) - n_tar * F.lit(1.0 / max(1, totals[0])), n_neg * F.lit(1.0 / max(1, totals[1]))
    return F.sqrt(absent * absent + present * present)


@dataclass(frozen=True)
class Thresholds:
    absence: float
    presence: float
    penalty: float
    edge_weight: float
    min_nodes: int
    max_nodes: int | None


def expected_rates(nodes: DataFrame, totals: tuple[int, int]) -> tuple[float, float]:
    """Expected absence of a k-mer in targets and presence in non-targets, both weighted by its targets."""
    t = F.col("n_tar").cast("double")
    r = nodes.agg(F.sum(t), F.sum(t * t), F.sum(t * F.col("n_neg"))).first()
    if not r[0]:
        return 1.0, 0.0
    return 1 - r[1] / max(1, totals[0]) / r[0], r[2] / max(1, totals[1]) / r[0]


def thresholds(
    absence: float, presence: float, n_tar: int, windowsize: int, min_len: int, max_len: int | None, *, penalty_th: float | None = None,
    stringency: int = 5, cap: float = 0.2, edge_mul: float = 0.3, floor: int = 3, max_cap: int | None = 100,
) -> Thresholds:
    """A given penalty threshold is taken as it is, without cap."""
    if penalty_th is None:
        penalty_th = min(cap, (1 - stringency / 10) * (max(absence, 0.0) * max(presence, 0.0)) ** 0.5)
    gap = (windowsize + 1) // 2
    most = max_cap if max_len is None else max_len // gap + 1
    return Thresholds(absence, presence, penalty_th, edge_mul * (1 - penalty_th) * n_tar, max(floor, min_len // gap + 1), most)


def heavy_edges(edge: DataFrame, weight_th: float) -> DataFrame:
    return edge.where(F.col("weight") > F.lit(weight_th))


def connected_nodes(nodes: DataFrame, edge: DataFrame) -> DataFrame:
    """Nodes that are an end of an edge."""
    ends = edge.select(F.col("first").alias("hash")).union(edge.select("second")).distinct()
    return nodes.join(ends, "hash", "left_semi")


def seeds(nodes: DataFrame, penalty_th: float) -> DataFrame:
    return nodes.where(F.col("penalty") <= F.lit(penalty_th))


def merge_weights(*graphs: DataFrame) -> DataFrame:
    """Sum of weighted edge lists."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.groupBy("first", "second").agg(F.sum("weight").alias("weight"))


def undirected(edge: DataFrame) -> DataFrame:
    """Directed edges as undirected ones; weights of both directions are summed."""
    a, b = edge_pair(F.col("first"), F.col("second"))
    return edge.select(a.alias("first"), b.alias("second"), "weight").groupBy("first", "second").agg(F.sum("weight").alias("weight"))


def path_edges(paths: DataFrame, key: str, pos: str, node: str, cyclic: bool = False) -> DataFrame:
    """``first, second, weight`` of consecutive nodes of paths; ``cyclic`` joins the last node to the first."""
    w = Window.partitionBy(key).orderBy(pos)
    nxt = F.lead(node).over(w)
    if cyclic:
        nxt = F.coalesce(nxt, F.first(node).over(w))
    return paths.select(F.col(node).alias("first"), nxt.alias("second")).where("second IS NOT NULL").groupBy("first", "second").agg(F.count("*").alias("weight"))


def degrees(edge: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``hash, degree``; a self-loop counts twice."""
    by = by or []
    return edge.select(*by, F.explode(F.array("first", "second")).alias("hash")).groupBy(*by, "hash").agg(F.count("*").alias("degree"))


def linear_graphs(edge: DataFrame, by: str) -> DataFrame:
    """``by, n_leaves, linear``: a graph is linear where exactly two nodes have one edge."""
    leaf = degrees(edge, [by]).groupBy(by).agg(F.count_if(F.col("degree") == 1).alias("n_leaves"))
    return leaf.withColumn("linear", F.col("n_leaves") == 2)


def induced_edges(edge: DataFrame, members: DataFrame, by: str = "subgraph_id") -> DataFrame:
    """Edges whose two ends are members of the same group."""
    a = members.select(F.col(by), F.col("hash").alias("first"))
    b = members.select(F.col(by).alias("_g"), F.col("hash").alias("second"))
    return edge.join(a, "first").join(b, "second").where(F.col(by) == F.col("_g")).select(by, "first", "second", "weight")


def drawings(induced: DataFrame, nodes: DataFrame, by: str = "subgraph_id") -> DataFrame:
    """``by, dot``: each graph as text that graph-drawing tools read, nodes with their penalty, edges with their weight.

    ``nodes`` has ``by``, hash and penalty; a graph has at most as many nodes as its growth allowed, so one is one row.
    """
    node = nodes.select(by, F.format_string('  "%d" [label="%.3f"];', "hash", F.coalesce("penalty", F.lit(0.0))).alias("line"), F.lit(0).alias("kind"))
    edge = induced.select(by, F.format_string('  "%d" -- "%d" [label="%d"];', "first", "second", F.col("weight").cast("bigint")).alias("line"), F.lit(1).alias("kind"))
    lines = F.transform(F.array_sort(F.collect_set(F.struct("kind", "line"))), lambda x: x["line"])
    return node.union(edge).groupBy(by).agg(F.concat(F.lit("graph {\n"), F.array_join(lines, "\n"), F.lit("\n}\n")).alias("dot"))


#: Parts of one subgraph looked at for its longest path; where these do not do, the path is marked as not searched.
MAX_PARTS = 20_000


def leaves_of(adjacent: dict[int, set[int]]) -> list[int]:
    """The nodes of one edge, in order."""
    return sorted(n for n, m in adjacent.items() if len(m) == 1 and n not in m)


def is_path(nodes: list[int], adjacent: dict[int, set[int]], first: int, last: int) -> bool:
    """Whether the nodes are a simple path from ``first`` to ``last``."""
    if not nodes or nodes[0] != first or nodes[-1] != last or len(set(nodes)) < len(nodes):
        return False
    return all(b in adjacent[a] for a, b in zip(nodes, nodes[1:], strict=False))


def route(adjacent: dict[int, set[int]], inside: frozenset[int], first: int, last: int) -> list[tuple[int, int, frozenset[int]]]:
    """``entry, exit, nodes`` of the blocks (parts that no single node cuts) that every simple path from first to last runs through.

    A block of two nodes is an edge; any other has at least two paths from its entry to its exit. None: last is out of reach.
    """
    if first == last:
        return []
    at, low, order = {first: 0}, {first: 0}, [first]  # order: nodes of blocks not yet closed
    parent, todo = {first: first}, [(first, iter(adjacent[first]))]
    up: dict[int, tuple[int, frozenset[int]]] = {}  # node: the cut node over it and the block that holds both
    while todo:
        node, rest = todo[-1]
        for n in rest:
            if n not in inside or n == node:
                continue
            if n not in at:
                parent[n], at[n], low[n] = node, len(at), len(at)
                order.append(n)
                todo.append((n, iter(adjacent[n])))
                break
            if n != parent[node]:
                low[node] = min(low[node], at[n])
        else:
            todo.pop()
            if todo:
                over = todo[-1][0]
                low[over] = min(low[over], low[node])
                if low[node] >= at[over]:
                    cut = order.index(node)
                    block = frozenset([over, *order[cut:]])
                    for n in order[cut:]:
                        up[n] = (over, block)
                    del order[cut:]
    if last not in at:
        return []
    found, node = [], last
    while node != first:
        over, block = up[node]
        found.append((over, node, block))
        node = over
    return found[::-1]


def longest_path(adjacent: dict[int, set[int]], first: int, last: int, most: int = MAX_PARTS) -> tuple[list[int], bool]:
    """The longest simple path between two nodes, of equal ones the first in the order of nodes, and whether all were searched.

    A path runs through the blocks of its route one by one, so each has its own longest part; in a block every next node
    leaves a smaller graph. Parts met again are known, and a path over all nodes of a block ends its search. Beyond
    ``most`` parts a path is still given, the longest met.
    """
    known: dict[tuple[int, int, frozenset[int]], list[int]] = {}
    whole = True

    def through(here: int, inside: frozenset[int]) -> list[int]:
        path = [here]
        for a, b, block in route(adjacent, inside, here, last_of[-1]):
            path += part(a, b, block)[1:]
        return path if path[-1] == last_of[-1] else []

    def part(a: int, b: int, block: frozenset[int]) -> list[int]:
        nonlocal whole
        if len(block) == 2:
            return [a, b]
        if (a, b, block) in known:
            return known[a, b, block]
        best: list[int] = []
        left = block - {a}
        last_of.append(b)
        for n in sorted(adjacent[a] & left):
            if best and len(known) >= most:
                whole = False
                break
            tail = through(n, left)
            if tail and len(tail) + 1 > len(best):
                best = [a, *tail]
            if len(best) == len(block):
                break
        last_of.pop()
        known[a, b, block] = best
        return best

    last_of = [last]
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * len(adjacent) + 1000))  # a path of n nodes is 2 n calls deep
    return through(first, frozenset(adjacent)), whole


def graph_orders(induced: DataFrame, reps: DataFrame) -> DataFrame:
    """``subgraph_id, path, warning``: the order of a subgraph's nodes that its edges give, held against ``reps`` (subgraph_id, rep).

    Of several paths between the two leaves the one that is the representative in either direction is taken, else the
    longest. Warnings: ``non-linear`` (no two leaves), ``multi-paths``, ``inconsistent`` (no path is the representative),
    ``unsearched`` (the longest path was not fully searched for, so the one given may be shorter). None of the others
    depends on that search. A subgraph has at most as many nodes as its growth allowed, so one is a task's work.
    """
    rep = reps.select("subgraph_id", F.array_join("rep", ",").alias("nodes"))
    rows = induced.select("subgraph_id", F.col("first").cast("string").alias("a"), F.col("second").cast("string").alias("b")).join(rep, "subgraph_id", "left")

    def order(part: pd.DataFrame) -> pd.DataFrame:
        adjacent: dict[int, set[int]] = {}
        for a, b in zip(map(int, part["a"]), map(int, part["b"]), strict=True):
            adjacent.setdefault(a, set()).add(b)
            adjacent.setdefault(b, set()).add(a)
        nodes = part["nodes"].iloc[0]
        want = [int(x) for x in nodes.split(",")] if nodes else []
        leaves = leaves_of(adjacent)
        blocks = route(adjacent, frozenset(adjacent), *leaves) if len(leaves) == 2 else []
        best, warn = [], ["non-linear"]
        if blocks:
            same = [w for w in (want, want[::-1]) if is_path(w, adjacent, *leaves)]
            best, whole = (same[0], True) if same else longest_path(adjacent, *leaves)
            warn = ["multi-paths"] * any(len(m) > 2 for _, _, m in blocks) + ["inconsistent"] * (not same) + ["unsearched"] * (not whole)
        return pd.DataFrame([(int(part["subgraph_id"].iloc[0]), ",".join(map(str, best)), ",".join(warn))], columns=["subgraph_id", "path", "warning"])

    return rows.groupBy("subgraph_id").applyInPandas(order, "subgraph_id bigint, path string, warning string")
