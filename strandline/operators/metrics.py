"""Metrics of markers from alignment hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HITS = (
    "qseqid int, sseqid string, nident int, mismatch int, gaps int, qstart int, qend int, sstart int, send int,"
    " evalue double, bitscore double, sseq string"
)
METRICS = ["conservation", "f_tar_hits", "divergence", "f_neg_hits", "avg_repeats_tar", "avg_pident_tar", "avg_repeats_neg", "avg_pident_neg"]


def parse_subjects(hits: DataFrame) -> DataFrame:
    """``sseqid`` of the form ``assembly@y|n@record`` as columns ``assembly_idx, is_target, record_id``."""
    p = F.split("sseqid", "@", 3)
    return hits.select("*", p[0].cast("int").alias("assembly_idx"), (p[1] == "y").alias("is_target"), p[2].alias("record_id")).drop("sseqid")


def best_hits(hits: DataFrame, ties: list[str] | None = None) -> DataFrame:
    """The hit of highest bitscore of each (query, assembly), with ``n_hits`` and ``avg_nident`` of all of them."""
    w = Window.partitionBy("qseqid", "assembly_idx")
    order = [F.desc("bitscore"), *[F.col(c) for c in ties or []]]
    ranked = hits.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("n_hits", F.count("*").over(w)).withColumn("avg_nident", F.avg("nident").over(w))
    return ranked.where("rn = 1").drop("rn")


def marker_metrics(markers: DataFrame, best: DataFrame, n_tar: int, n_neg: int) -> DataFrame:
    """``markers`` (qseqid, len) with the metrics; 0.0 where a class has no hit.

    Conservation and divergence divide by all assemblies of the class, so one without hit adds 0 to either; averages are
    over assemblies with a hit.
    """
    tar, neg = F.col("is_target"), ~F.col("is_target")
    m = best.groupBy("qseqid").agg(
        F.sum(F.when(tar, F.col("nident"))).alias("ident"), F.count_if(tar).alias("hits_tar"), F.avg(F.when(tar, F.col("n_hits"))).alias("rep_tar"),
        F.avg(F.when(tar, F.col("avg_nident"))).alias("id_tar"), F.sum(F.when(neg, F.col("mismatch") + F.col("gaps"))).alias("dist"),
        F.count_if(neg).alias("hits_neg"), F.avg(F.when(neg, F.col("n_hits"))).alias("rep_neg"), F.avg(F.when(neg, F.col("avg_nident"))).alias("id_neg"),
    )
    size = F.col("len").cast("double")
    values = [
        F.col("ident") / size / n_tar, F.col("hits_tar") / n_tar, F.col("dist") / size / n_neg, F.col("hits_neg") / n_neg, F.col("rep_tar"),
        F.col("id_tar") / size, F.col("rep_neg"), F.col("id_neg") / size,
    ]
    return markers.join(m, "qseqid", "left").select(*markers.columns, *[F.coalesce(v, F.lit(0.0)).alias(n) for v, n in zip(values, METRICS, strict=True)])


def rank_markers(evaluated: DataFrame, ties: str = "qseqid") -> DataFrame:
    """Markers by conservation plus divergence, highest first; equal ones in their former order."""
    return evaluated.orderBy(F.desc(F.col("conservation") + F.col("divergence")), ties)
