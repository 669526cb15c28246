"""Queries of the problems on large text and sequence collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import contamination, fusion, near_dup, overlap, packing, spans, toxicity
from strandline.llm.oracles import ORACLES  # noqa: F401
from strandline.session import table

MIN_SPAN = 80
SCORES = {"conservation": True, "divergence": True, "f_neg_hits": False, "rep_ratio": True}


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, d, "records"), "record_idx", "seq")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_dup.group_pairs(_groups(spark, d), "record_idx")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its class (equal strings), its group and the path of its assembly."""
    of = table(spark, d, "records").select(F.col("record_idx").cast("bigint").alias("record_idx"), "assembly_idx").distinct()
    path = table(spark, d, "assemblies").select("assembly_idx", "path").distinct()
    return _groups(spark, d).join(of, "record_idx").join(path, "assembly_idx", "left").select("record_idx", "class_id", "group_id", "assembly_idx", "path")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse_ranks(table(spark, d, "signatures"), "sig_no", "run_no", SCORES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    best = fusion.keep_best(_ranked(spark, d), table(spark, d, "runs"), "run_no", "n_keep")
    return best.select(F.col("run_no").cast("bigint").alias("run_no"), F.col("sig_no").cast("bigint").alias("sig_no"))


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    records = spans.Collection(table(spark, d, "records"), "record_idx", "seq", MIN_SPAN)
    drawn = spans.Collection(table(spark, d, "signatures"), "sig_no", "seq", MIN_SPAN, "record_idx")
    a = spans.sharing_pairs(records, records, MIN_SPAN).withColumn("kind", F.lit("record"))
    b = spans.sharing_pairs(drawn, records, MIN_SPAN).withColumn("kind", F.lit("signature"))
    return a.union(b).select("kind", F.col("a").alias("key_a"), F.col("b").alias("key_b"))


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "records"), "record_idx", "seq", MIN_SPAN)


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.coverage(table(spark, d, "records"), p3_spans(spark, d), "record_idx", "seq")


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    of = table(spark, d, "records").select("record_idx", "assembly_idx").distinct()
    held = table(spark, d, "kmers").select("record_idx", "hash").join(of, "record_idx").select("assembly_idx", "hash")
    return overlap.overlapping_sets(held, "assembly_idx", "hash", 0.4)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.col("set_a").alias("assembly_a"), F.col("set_b").alias("assembly_b"))


def p6_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d)


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    n = packing.token_lengths(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(n, "doc_id", "n_tokens", table(spark, d, "containers"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p7_packing(spark, d), table(spark, d, "containers"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), "doc_id", "text", "layout", table(spark, d, "benchmark"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return contamination.remove_leaks(table(spark, d, "documents"), "doc_id", "text", "layout", table(spark, d, "benchmark"), "item_id", "text")


def p8_residue(spark: SparkSession, d: str) -> DataFrame:
    """What the cleaned documents still leak: nothing."""
    layout = table(spark, d, "documents").select("doc_id", "layout").distinct()
    left = p8_cleaned(spark, d).join(layout, "doc_id")
    return contamination.leaks(left, "doc_id", "text", "layout", table(spark, d, "benchmark"), "item_id", "text")


def _toxic(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, "doc_id", "text", "layout", table(spark, d, "labels"), "toxic")
    return toxicity.score(docs, "doc_id", "text", "layout", model)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _toxic(spark, d).where("toxic").select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return _toxic(spark, d)


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(_toxic(spark, d), table(spark, d, "documents"), "doc_id", "source")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_found, p2_ranking, p3_found, p3_spans, p3_coverage, p6_found, p6_overlaps, p7_packing, p7_fill, p8_found,
        p8_leaks, p8_cleaned, p8_residue, p9_found, p9_scores, p9_rates,
    )
}
