"""Connected components by alternating stars, as joins and mergeable minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandline.session import materialize, release


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Large-star and small-star rounds alternate until the edges stop changing, O(log^2) rounds whatever the diameter. A
    node's neighbours are only ever reduced to a minimum, never gathered. NULL ends, self loops and repeated edges are
    ignored; no edges give no rows. Each round is written to the shared scratch folder.
    """
    x, y = F.col(a), F.col(b)
    cur, sign = _written(edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    for _ in range(max_rounds):
        nxt, new = _written(_small_star(_large_star(cur)))
        release(cur)
        cur = nxt
        if new == sign:
            break
        sign = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select("v", "v").distinct())
    out._strandline_path = cur._strandline_path  # released as the table it reads
    return out


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and a number of them all that is summed while they are written.

    A task that runs twice is summed twice: then two equal rounds look unequal, and one more is made.
    """
    seen = Observation()
    out = materialize(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
    r = seen.get
    return out, (r["n"], r["s"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    j = e.join(low, "u")
    return j.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
