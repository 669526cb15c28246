"""Candidate markers: where a subgraph lies in each assembly, its representative order, interval and sequence.

All subgraphs go through one relational pipeline; nothing loops over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import canonical_order, has_repeats, slice_seq


def kmers_of(kmers: DataFrame, members: DataFrame) -> DataFrame:
    """Occurrences of the members' hashes, with their ``subgraph_id``; hashes of no subgraph go."""
    return kmers.join(members.select("hash", "subgraph_id"), "hash")


def consecutive_runs(occ: DataFrame, by: list[str], pos: str, max_gap: float) -> DataFrame:
    """``occ`` plus ``run``: rows of a group by ``pos``; a step of more than ``max_gap`` begins a new run (from 0)."""
    w = Window.partitionBy(*by).orderBy(pos)
    gap = F.coalesce((F.col(pos) - F.lag(pos).over(w) > F.lit(max_gap)).cast("int"), F.lit(0))
    return occ.withColumn("_gap", gap).withColumn("run", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def run_summaries(occ: DataFrame, windowsize: int) -> DataFrame:
    """One row per run of a subgraph in a record: ``start, last, n_kmers, kmers`` (hashes in the order of their positions)."""
    by = ["subgraph_id", "assembly_idx", "record_no"]
    runs = consecutive_runs(occ, by, "pos", 1.5 * windowsize)
    # a run holds few k-mers: its nodes are at most those of one subgraph, a window apart
    return runs.groupBy(*by, "run").agg(
        F.min("pos").alias("start"), F.max("pos").alias("last"), F.count("*").alias("n_kmers"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "hash"))), lambda x: x["hash"]).alias("kmers"),
    )


def locations(occ: DataFrame, assemblies: DataFrame, k: int, windowsize: int) -> DataFrame:
    """Where each subgraph lies in each assembly: the run of most k-mers, the first of equal ones, and how many runs there are."""
    runs = run_summaries(occ, windowsize)
    w = Window.partitionBy("subgraph_id", "assembly_idx")
    best = runs.withColumn("rn", F.row_number().over(w.orderBy(F.desc("n_kmers"), "record_no", "start"))).withColumn("n_repeats", F.count("*").over(w))
    stop = F.col("last") + k
    out = best.where("rn = 1").select(
        "subgraph_id", "assembly_idx", "record_no", "start", stop.alias("stop"), (stop - F.col("start")).alias("len"), "n_kmers", "kmers", "n_repeats"
    )
    return out.join(assemblies.select("assembly_idx", "is_target").distinct(), "assembly_idx", "left")


def representative_orders(loc: DataFrame) -> DataFrame:
    """``subgraph_id, rep, n_rep``: the order of k-mers that weighs most in targets.

    Orders are counted in both directions together; weight is length times count, equal weights go to the order seen in the
    lowest assembly. Of its two directions the more frequent one is taken, the canonical one if equal. ``n_rep`` counts both.
    Subgraphs that are in no target give no row.
    """
    one = loc.where("is_target").groupBy("subgraph_id", "kmers").agg(F.count("*").alias("n"), F.min("assembly_idx").alias("seen"))
    both = one.withColumn("canon", canonical_order(F.col("kmers"))).groupBy("subgraph_id", "canon").agg(
        F.sum("n").alias("n_rep"), F.min("seen").alias("seen"), F.sum(F.when(F.col("kmers") == F.col("canon"), F.col("n")).otherwise(0)).alias("n_canon")
    )
    w = Window.partitionBy("subgraph_id").orderBy(F.desc(F.size("canon") * F.col("n_rep")), "seen", "canon")
    top = both.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    rep = F.when(2 * F.col("n_canon") >= F.col("n_rep"), F.col("canon")).otherwise(F.reverse("canon"))
    return top.select("subgraph_id", rep.alias("rep"), "n_rep")


def representatives(loc: DataFrame, orders: DataFrame) -> DataFrame:
    """The location of the lowest assembly that has the representative order as it is."""
    at = F.struct("assembly_idx", "record_no", "start", "stop", "len")
    met = loc.join(orders, "subgraph_id").where(F.col("kmers") == F.col("rep"))
    r = met.groupBy("subgraph_id", "rep", "n_rep").agg(F.min(at).alias("r"))
    bad = (F.size("rep") <= 1) | has_repeats(F.col("rep"))
    return r.select("subgraph_id", "r.*", F.col("n_rep"), F.size("rep").alias("n_nodes"), bad.alias("is_bad"))


def candidates(reps: DataFrame, min_len: int, n_tar: int) -> DataFrame:
    """Representatives that are long enough and neither of one k-mer nor with a repeated one, with ``rep_ratio``."""
    kept = reps.where((F.col("len") >= min_len) & ~F.col("is_bad"))
    return kept.withColumn("rep_ratio", F.col("n_rep") / F.lit(n_tar))


def fetch_sequences(loc: DataFrame, records: DataFrame) -> DataFrame:
    """``loc`` plus ``record_id`` and ``seq``: upper-case letters start to stop of the record, forward strand.

    The few locations are joined to the records, never the other way round, so sequences without one are not shuffled on.
    """
    r = records.select("assembly_idx", "record_no", "record_id", F.col("seq").alias("whole"))
    out = loc.join(r, ["assembly_idx", "record_no"])
    return out.withColumn("seq", F.upper(slice_seq(F.col("whole"), F.col("start").cast("int"), F.col("stop").cast("int")))).drop("whole")


def strand(kmers, rep):
    """How an order lies to the representative: ``+``, ``-``, ``?`` (unknown) or ``u`` (one shared k-mer).

    Shared k-mers in a growing sequence of places of the representative are ``+``, in a shrinking one ``-``. Where the
    representative repeats a k-mer a place is not unique: there the shared k-mers have to follow each other in it, or in
    its reverse, with others between.
    """
    shared = F.filter(kmers, lambda x: F.array_contains(rep, x))
    at = F.transform(shared, lambda x: F.array_position(rep, x))
    n = F.size(shared)

    def within(order):
        met = F.aggregate(order, F.lit(0), lambda i, x: i + F.coalesce((F.get(shared, i) == x).cast("int"), F.lit(0)))
        return met == n

    again = F.size(F.array_distinct(rep)) < F.size(rep)
    up = F.when(again, within(rep)).otherwise(at == F.array_sort(at))
    down = F.when(again, within(F.reverse(rep))).otherwise(at == F.reverse(F.array_sort(at)))
    return (
        F.when(kmers == rep, "+").when(kmers == F.reverse(rep), "-").when(n == 0, "?").when(n == 1, "u").when(up, "+").when(down, "-").otherwise("?")
    )
