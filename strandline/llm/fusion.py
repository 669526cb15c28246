"""One ranking from several differently scaled scores (problem 2): reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.ranking import row_numbers, tied_ranks


def fuse_ranks(df: DataFrame, item: str, group: str, scores: dict[str, bool], constant: float = 60.0) -> DataFrame:
    """``group, item, fused, place`` for every item with all scores; place 1 is best.

    ``scores`` maps a score column to True where high is good. Inside a group each score is turned into its average rank
    (equal scores share the mean of their places), and ``fused`` is the sum of ``1 / (constant + rank)``; only the order
    of a score counts, never its range or unit. Equal sums are ordered by ``item``.

    An item with a NULL or NaN in any score is not ranked and takes no rank from others. Repeated rows count once. A key
    (group, item) with several sets of scores is ranked by one of them, the least in the order of the scores, so it has
    one row like any other. A NULL group is a group of its own; an item that is NULL is not ranked. An empty frame gives
    no rows. Other columns of ``df`` are ignored.
    """
    names = list(scores)
    part = df.select(F.col(group).alias("g"), F.col(item).alias("id"), *[F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(names)])
    whole = reduce(lambda a, b: a & b, [F.col(f"s{i}").isNotNull() & ~F.isnan(f"s{i}") for i in range(len(names))])
    held = F.struct(*[f"s{i}" for i in range(len(names))])
    part = part.where(whole & F.col("id").isNotNull()).groupBy("g", "id").agg(F.min(held).alias("s")).select("g", "id", "s.*")
    # the sign makes low the good end of every score, so one pass ranks all scores
    cells = F.array(*[F.struct(F.lit(i).alias("m"), (-F.col(f"s{i}") if scores[c] else F.col(f"s{i}")).alias("v")) for i, c in enumerate(names)])
    # adding 0.0 makes -0.0 and 0.0 the same value
    long = part.select("g", "id", F.explode(cells).alias("c")).select("g", "id", F.col("c.m").alias("m"), (F.col("c.v") + F.lit(0.0)).alias("v"))
    ranks = tied_ranks(long, ["g", "m"], "v").select(
        F.col("g").alias("g2"), F.col("m").alias("m2"), F.col("v").alias("v2"), (F.col("before") + (F.col("cnt") + 1) / 2).alias("r")
    )
    same = F.col("g").eqNullSafe(F.col("g2")) & (F.col("m") == F.col("m2")) & (F.col("v") == F.col("v2"))
    per = long.join(ranks, same).groupBy("g", "id").agg(
        F.sort_array(F.collect_list(F.lit(1.0) / (F.lit(float(constant)) + F.col("r")))).alias("parts")  # one entry a score
    )
    # summed in sorted order, so equal parts give equal sums to the last bit
    total = per.select("g", "id", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x).alias("fused"))
    placed = row_numbers(total, ["g"], [F.col("fused").desc(), F.col("id").asc()], "place")
    return placed.select(F.col("g").alias(group), F.col("id").alias(item), "fused", "place")


def keep_best(ranked: DataFrame, keep: DataFrame, group: str, n_keep: str) -> DataFrame:
    """The rows of :func:`fuse_ranks` whose place is within the group's ``n_keep``; no or a NULL number keeps none."""
    k = keep.select(F.col(group).alias("__g"), F.col(n_keep).alias("__n")).groupBy("__g").agg(F.max("__n").alias("__n"))
    return ranked.join(k, F.col(group).eqNullSafe(F.col("__g"))).where(F.col("place") <= F.col("__n")).drop("__g", "__n")
