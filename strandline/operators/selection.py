"""Exact per-key counts and quantiles when a few keys hold most rows (problem 4).

Distributed exact selection: a key is described by histograms whose cells (count, min, max, sum) merge, so partial
aggregation reduces a hot key on every task before the shuffle. A wanted rank is resolved as soon as a cell pins it
down; otherwise the cell that holds it is split again. Values of a key are never gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize, release


def keyed_quantiles(df: DataFrame, key: str, value: str, probs: tuple[float, ...] = (0.5,), bins: int = 256) -> DataFrame:
    """One row per key: ``key, n, lo, hi, quantiles`` with the exact nearest-rank quantiles (rank ``ceil(p * n)``).

    ``value`` must be integral (or a type that casts to BIGINT without loss). Rows with a NULL value are not counted; a
    NULL key is a key of its own; a key with no value gives no row; an empty frame gives no rows. Repeated rows count as
    often as they occur: drop copies first where they should not. Other columns of ``df`` are ignored.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("bigint").alias("v")).where("v IS NOT NULL")
    level0 = materialize(
        rows.groupBy("k").agg(
            F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")
        )
    )
    base = level0.select(F.col("k"), "n", "lo", "hi")
    if not probs:
        return base.select(F.col("k").alias(key), "n", "lo", "hi", F.array().cast("array<bigint>").alias("quantiles"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    rank = F.greatest(F.lit(1), F.least(F.col("n"), F.ceil(F.col("w.p") * F.col("n")))).cast("bigint")
    targets = level0.select("*", F.explode(wanted).alias("w")).select("k", "lo", "hi", "n", "s", F.col("w.i").alias("i"), rank.alias("r"))
    middle = F.when((F.col("n") == 3) & (F.col("r") == 2), (F.col("s") - F.col("lo") - F.col("hi")).cast("bigint"))
    done = targets.withColumn("q", F.coalesce(_pinned(), middle))
    found = [done.where("q IS NOT NULL").select("k", "i", "q")]
    open_ = materialize(done.where("q IS NULL").select("k", "i", "r", "lo", "hi"))
    held = None
    while not open_.isEmpty():
        if held is None:  # from here on only the rows of unresolved keys are read
            keys = open_.select(F.col("k").alias("k2")).distinct()
            held = materialize(rows.join(keys, F.col("k").eqNullSafe(F.col("k2")), "left_semi"))
        step = materialize(_refine(held, open_, bins))
        release(open_)
        found.append(step.where("q IS NOT NULL").select("k", "i", "q"))
        open_ = materialize(step.where("q IS NULL").select("k", "i", "r", "lo", "hi"))
    release(open_, held)
    q = found[0]
    for f in found[1:]:
        q = q.union(f)
    # every q row is one of at most len(probs) per key: a bounded list
    lists = q.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("quantiles"))
    lists = lists.withColumnRenamed("k", "k2")
    return base.join(lists, F.col("k").eqNullSafe(F.col("k2"))).select(F.col("k").alias(key), "n", "lo", "hi", "quantiles")


def _pinned():
    """The value at rank r of a cell (n, lo, hi), where the cell alone tells it."""
    return (
        F.when((F.col("lo") == F.col("hi")) | (F.col("r") == 1), F.col("lo")).when(F.col("r") == F.col("n"), F.col("hi"))
    )


def _refine(rows: DataFrame, open_: DataFrame, bins: int) -> DataFrame:
    """Split each open cell into ``bins`` and keep the bin that holds its rank, with ``q`` where that bin pins it."""
    t = open_.select(F.col("k").alias("k2"), "i", "r", F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"))
    cell = rows.join(t, F.col("k").eqNullSafe(F.col("k2")) & F.col("v").between(F.col("c_lo"), F.col("c_hi")))
    # in decimals, as a cell may span more than half of the BIGINT range
    span = F.col("c_hi").cast("decimal(20,0)") - F.col("c_lo").cast("decimal(20,0)") + 1
    at = F.floor((F.col("v").cast("decimal(20,0)") - F.col("c_lo").cast("decimal(20,0)")) * bins / span)
    hist = cell.groupBy("k", "i", "r", "c_lo", "c_hi", at.cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    w = Window.partitionBy("k", "i").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = hist.withColumn("cum", F.sum("n").over(w)).where((F.col("cum") >= F.col("r")) & (F.col("cum") - F.col("n") < F.col("r")))
    return cum.withColumn("r", F.col("r") - (F.col("cum") - F.col("n"))).select("k", "i", "r", "lo", "hi", _pinned().alias("q"))


def occurrence_report(kmers: DataFrame, nodes: DataFrame) -> DataFrame:
    """Occurrences per hash held against the ranges stated in ``nodes``.

    Returns ``hash, n_kmers, first_no, median_no, last_no, n_nodes, n_stated, agrees``. Repeated rows of either table
    count once; a hash absent from one table counts 0 there; NULL ends of a range count 0; a NULL ``kmer_no`` is no
    occurrence; a NULL hash is a hash of its own.
    """
    # copies are dropped on the spread-out kmer_no, so a hot hash is not one task's work
    occ = kmers.select("kmer_no", "hash").dropDuplicates(["kmer_no", "hash"])
    occ = materialize(occ)
    q = keyed_quantiles(occ, "hash", "kmer_no", (0.5,)).select(
        F.col("hash"), "n", F.col("lo").alias("first_no"), F.col("hi").alias("last_no"), F.col("quantiles")[0].alias("median_no")
    )
    cols = [c for c in ("segment_no", "hash", "start", "stop", "n_tar", "n_neg", "penalty") if c in nodes.columns]
    stated = (
        nodes.select(*cols)
        .distinct()
        .groupBy(F.col("hash").alias("h2"))
        .agg(F.count("*").alias("n_nodes"), F.sum(F.coalesce(F.col("stop") - F.col("start"), F.lit(0))).cast("bigint").alias("n_stated"))
    )
    both = q.join(stated, F.col("hash").eqNullSafe(F.col("h2")), "full_outer")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("n_stated", F.lit(0))
    return both.select(
        F.coalesce("hash", "h2").alias("hash"), n.cast("bigint").alias("n_kmers"), "first_no", "median_no", "last_no",
        F.coalesce("n_nodes", F.lit(0)).cast("bigint").alias("n_nodes"), m.cast("bigint").alias("n_stated"), (n == m).alias("agrees"),
    )


def levels(span: int, bins: int = 256) -> int:
    """Most refinement rounds for values that span ``span``."""
    return max(1, math.ceil(math.log(max(span, 2), bins)))
