"""Exact ranks inside groups of any size.

``row_number() OVER (PARTITION BY g ORDER BY v)`` sends a whole group to one task. Here rows are range-partitioned on
(group, value), so a group that holds a third of all rows spans many tasks; each task numbers what it has, and a table of
one row per (task, group) carries the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import materialize


def row_numbers(df: DataFrame, group: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` plus ``out``: 1, 2, ... inside each ``group`` by ``order``. NULL groups count as one group.

    ``order`` must be a total order for a repeatable result. An empty frame gives an empty frame. The result reads a
    materialized table.
    """
    pos = "__pos"
    ranged = df.repartitionByRange(*[F.col(g) for g in group], *order)
    placed = materialize(
        ranged.sortWithinPartitions(*[F.col(g) for g in group], *order).withColumn(pos, F.monotonically_increasing_id())
    )
    task = F.shiftright(F.col(pos), 33)
    chunk = placed.groupBy(*group, task.alias("__task")).agg(F.min(pos).alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    chunk = chunk.withColumn("__before", F.coalesce(before, F.lit(0))).select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], "__task", "__first", "__before"
    )
    same = F.col("__t") == F.col("__task")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    numbered = placed.withColumn("__t", task).join(chunk, same)
    return numbered.select(*df.columns, (F.col("__before") + F.col(pos) - F.col("__first") + 1).alias(out))


def tied_ranks(df: DataFrame, group: list[str], value: str, descending: bool = False) -> DataFrame:
    """One row per distinct (group, value): ``cnt`` rows hold it, ``before`` rows of the group sort ahead of it.

    The competition rank is ``before + 1``, the average rank ``before + (cnt + 1) / 2``. Rows are counted before any
    shuffle, so a value held by a third of the rows is one row here. NULL values are dropped.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("cnt"))
    order = F.col(value).desc() if descending else F.col(value).asc()
    ranged = counts.repartitionByRange(*[F.col(g) for g in group], order)
    placed = materialize(
        ranged.sortWithinPartitions(*[F.col(g) for g in group], order).withColumn("__pos", F.monotonically_increasing_id())
    ).withColumn("__task", F.shiftright(F.col("__pos"), 33))
    in_task = Window.partitionBy(*group, "__task").orderBy("__pos").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("__local", F.coalesce(F.sum("cnt").over(in_task), F.lit(0)))
    chunk = placed.groupBy(*group, "__task").agg(F.sum("cnt").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1))
    chunk = chunk.withColumn("__before", F.coalesce(before, F.lit(0))).select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__task").alias("__t"), "__before"
    )
    same = F.col("__t") == F.col("__task")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return local.join(chunk, same).select(*group, value, "cnt", (F.col("__local") + F.col("__before")).alias("before"))
