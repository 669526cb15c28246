"""Greedy growth of low-penalty subgraphs from seeds."""

from __future__ import annotations

import heapq
import random

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.components import connected_components
from strandline.session import materialize

MEMBERS = "subgraph_id bigint, hash bigint, penalty double"
#: Seeds that the driver may put in order; past this the order must be ``hash``.
MAX_SHUFFLED = 5_000_000


def grow(adjacent: dict[int, list[int]], penalty: dict[int, float], seeds: list[int], th: float, least: int, most: int | None) -> list[tuple[int, list[int]]]:
    """(seed, members) of each kept subgraph, in seed order.

    From a seed the neighbour of least (penalty, hash) is taken as long as the mean penalty stays within ``th``. The first
    that does not fit ends it: all that remain are no better. A subgraph that is too small frees its nodes.
    """
    used: set[int] = set()
    kept = []
    for seed in seeds:
        if seed in used:
            continue
        members, total = [seed], penalty[seed]
        seen = {seed}
        heap = []
        for n in adjacent.get(seed, ()):
            if n not in used and n not in seen:
                seen.add(n)
                heapq.heappush(heap, (penalty[n], n))
        while heap and (most is None or len(members) < most):
            p, n = heapq.heappop(heap)
            if (total + p) / (len(members) + 1) > th:
                break
            total += p
            members.append(n)
            for m in adjacent.get(n, ()):
                if m not in used and m not in seen:
                    seen.add(m)
                    heapq.heappush(heap, (penalty[m], m))
        if len(members) >= least:
            used.update(members)
            kept.append((seed, members))
    return kept


def subgraphs(nodes: DataFrame, edge: DataFrame, th: float, least: int, most: int | None, seed: int | random.Random = 42, order: str = "shuffle") -> DataFrame:
    """``subgraph_id, hash, penalty``: disjoint connected subgraphs whose mean penalty is within ``th``.

    Seeds are the nodes within ``th``, in the order of their hash shuffled by ``random.Random(seed)`` on the driver
    (``order='shuffle'``), or by their hash alone (``order='hash'``, nothing collected). Components of the edges do not
    touch, so each is grown by itself in the order of its seeds, which gives what one sequential pass over all seeds would.
    A component is one task: weigh the edge filter so that components stay small. Subgraph ids count from 0 in the order of
    the final shuffle, or are the seeds' hashes.
    """
    spark = nodes.sparkSession
    start = nodes.where(F.col("penalty") <= F.lit(th)).select("hash")
    rng = seed if isinstance(seed, random.Random) else random.Random(seed)
    if order == "shuffle":
        if start.count() > MAX_SHUFFLED:
            raise ValueError("too many seeds to shuffle on the driver; use order='hash'")
        found = sorted(r[0] for r in start.collect())
        rng.shuffle(found)
        rank = spark.createDataFrame(list(zip(found, range(len(found)), strict=True)), "hash bigint, rank bigint")
    else:
        rank = start.withColumn("rank", F.col("hash"))
    comp = connected_components(edge, "first", "second")
    where = nodes.join(comp, F.col("hash") == F.col("node"), "left").select("hash", "penalty", F.coalesce("component", "hash").alias("c"))
    ranked = where.join(rank, "hash", "left")
    # only components with a seed are grown
    live = ranked.where("rank IS NOT NULL").select("c").distinct()
    v = ranked.join(live, "c", "left_semi").select("c", F.col("hash").alias("x"), F.lit(None).cast("bigint").alias("y"), "penalty", "rank")
    e = edge.join(where.select(F.col("hash").alias("first"), "c"), "first").join(live, "c", "left_semi").where("first <> second")
    e = e.select("c", F.col("first").alias("x"), F.col("second").alias("y"), F.lit(None).cast("double").alias("penalty"), F.lit(None).cast("bigint").alias("rank"))

    def run(t: pa.Table) -> pa.Table:
        is_node = t["y"].is_null()
        n, pairs = t.filter(is_node), t.filter(pc.invert(is_node))
        pen = dict(zip(n["x"].to_pylist(), n["penalty"].to_pylist(), strict=True))
        by: dict[int, list[int]] = {}
        for a, b in zip(pairs["x"].to_pylist(), pairs["y"].to_pylist(), strict=True):
            by.setdefault(a, []).append(b)
            by.setdefault(b, []).append(a)
        s = n.filter(n["rank"].is_valid()).sort_by("rank")
        ranks = dict(zip(s["x"].to_pylist(), s["rank"].to_pylist(), strict=True))
        rows = [(ranks[q], m, pen[m]) for q, ms in grow(by, pen, list(ranks), th, least, most) for m in ms]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["subgraph_id", "hash", "penalty"])

    grown = materialize(v.union(e).groupBy("c").applyInArrow(run, MEMBERS))
    if order != "shuffle":
        return grown
    ids = sorted(r[0] for r in grown.select("subgraph_id").distinct().collect())  # one number a kept subgraph
    rng.shuffle(ids)
    final = spark.createDataFrame([(r, i) for i, r in enumerate(ids)], "subgraph_id bigint, at bigint")
    return grown.join(final, "subgraph_id").select(F.col("at").alias("subgraph_id"), "hash", "penalty")
