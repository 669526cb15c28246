"""Overlap sizes between many large sets (problem 6): a blocked matrix product.

The incidence of identifiers and sets is cut into 0/1 tiles of identifiers that occur in much the same sets; a transposed
tile times itself counts, for every two of its sets, the identifiers both hold, and the integer matrices of all tiles are
summed. Identifiers held by more than ``hot`` sets would make every two sets meet: they are counted apart, and only for
pairs that can still reach the wanted share.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import materialize, release

_ROWS, _COLS = 2048, 1024


def overlapping_sets(df: DataFrame, set_id: str, item: str, share: float = 0.4, hot: int = 256) -> DataFrame:
    """``set_a, set_b, n_a, n_b, n_both``: pairs of sets that share at least ``share`` (> 0) of the smaller one; a < b.

    Counts are exact. Repeated rows count once; rows with a NULL set or item are left out; an empty frame gives no rows.

    A pair that shares enough and whose smaller set holds fewer hot items than the needed number meets in a cold item, so
    the tiles find it. Sets made mostly of hot items are multiplied with all others on the hot items.
    """
    need = Fraction(str(share))
    t = lambda n: F.expr(f"({n} * {need.numerator} + {need.denominator - 1}) DIV {need.denominator}")
    e = df.select(F.col(set_id).cast("bigint").alias("s"), F.col(item).alias("x")).where("s IS NOT NULL AND x IS NOT NULL")
    e = materialize(e.distinct())
    hot_items = materialize(e.groupBy("x").agg(F.count("*").alias("d")).where(F.col("d") > hot).select("x"))
    hot_e = materialize(e.join(hot_items, "x", "left_semi"))
    size = e.groupBy("s").agg(F.count("*").alias("n"))
    size = materialize(size.join(hot_e.groupBy("s").agg(F.count("*").alias("h")), "s", "left").select("s", "n", F.coalesce("h", F.lit(0)).alias("h")))
    # at most ``hot`` sets in a list
    lists = e.join(hot_items, "x", "left_anti").groupBy("x").agg(F.array_sort(F.collect_list("s")).alias("l")).where(F.size("l") > 1)
    near = lists.withColumn("lead", F.col("l")[0]).hint("rebalance", "lead")
    cold = near.select("l").mapInArrow(_multiply, "a bigint, b bigint, c bigint").groupBy("a", "b").agg(F.sum("c").alias("c"))
    a, b = size.toDF("a", "na", "ha"), size.toDF("b", "nb", "hb")
    sized = cold.join(a, "a").join(b, "b")
    may = materialize(sized.where(F.col("c") + F.least("ha", "hb") >= t("least(na, nb)")))
    hot_a, hot_b = hot_e.select(F.col("s").alias("a"), "x"), hot_e.select(F.col("s").alias("b"), "x")
    extra = may.where("least(ha, hb) > 0").select("a", "b").join(hot_a, "a").join(hot_b, ["b", "x"]).groupBy("a", "b").agg(F.count("*").alias("e"))
    # sets that hot items alone can carry over the threshold
    heavy = size.where(F.col("h") >= t("n")).select(F.col("s").alias("a"))
    met = hot_a.join(heavy, "a", "left_semi").join(hot_b, "x").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("e"))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "e").distinct()
    counted = may.select("a", "b", "c").join(extra.union(met).distinct(), ["a", "b"], "full_outer")
    # a pair that meets in cold items but is no candidate there is below the share whatever its hot count
    counted = counted.select("a", "b", (F.coalesce("c", F.lit(0)) + F.coalesce("e", F.lit(0))).alias("n_both"))
    out = counted.join(a.select("a", "na"), "a").join(b.select("b", "nb"), "b").where(F.col("n_both") >= t("least(na, nb)"))
    release(hot_items)
    return out.select(F.col("a").alias("set_a"), F.col("b").alias("set_b"), F.col("na").alias("n_a"), F.col("nb").alias("n_b"), F.col("n_both").cast("bigint").alias("n_both"))


def _multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column(0)
        if not len(col):
            continue
        off = np.asarray(col.offsets)
        flat = col.values.to_numpy()
        lead = flat[off[:-1]]
        order = np.argsort(lead, kind="stable")
        for at in range(0, len(order), _ROWS):
            rows = order[at : at + _ROWS]
            size = off[rows + 1] - off[rows]
            r = np.repeat(np.arange(len(rows)), size)
            take = np.repeat(off[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            names, c = np.unique(flat[take], return_inverse=True)
            yield from _product(len(rows), r, c, names)


def _product(n: int, r: np.ndarray, c: np.ndarray, names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Upper triangle of the tile's co-occurrence matrix, by blocks of columns."""
    blocks = []
    for lo in range(0, len(names), _COLS):
        m = (c >= lo) & (c < lo + _COLS)
        tile = np.zeros((n, min(_COLS, len(names) - lo)), np.float32)  # counts stay exact below 2**24
        tile[r[m], c[m] - lo] = 1
        blocks.append((lo, tile))
    for i, (lo, x) in enumerate(blocks):
        for hi, y in blocks[i:]:
            both = x.T @ y
            p, q = np.nonzero(np.triu(both, 1) if lo == hi else both)
            if len(p):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[p + lo]), pa.array(names[q + hi]), pa.array(both[p, q].astype(np.int64))], ["a", "b", "c"]
                )
