"""Tables of other tools (alignment hits, distances) and the outputs of a run."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.sequence import location_header, shared_fraction
from strandline.operators.metrics import HITS, METRICS


def read_hits(spark: SparkSession, path: str, schema: str = HITS) -> DataFrame:
    """Tab-separated hits with a stated schema; nothing is inferred."""
    return spark.read.csv(path, sep="\t", schema=schema)


def read_distances(spark: SparkSession, path: str) -> DataFrame:
    """``a, b, distance, p_value, jaccard`` of a tab-separated distance table whose last column is ``shared/total``."""
    t = spark.read.csv(path, sep="\t", schema="a string, b string, distance double, p_value double, shared string")
    return t.withColumn("jaccard", shared_fraction(F.col("shared"))).drop("shared")


def signature_table(markers: DataFrame) -> DataFrame:
    """The columns of signatures.csv. Metrics that were not evaluated are NULL, as is one that is NaN; a signature of a
    record without id has an empty id in its header."""
    head = location_header(F.col("assembly_idx"), F.coalesce("record_id", F.lit("")), F.col("start"), F.col("stop"))
    given = [c for c in [*METRICS, "rep_ratio"] if c in markers.columns]
    metric = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) if c in given else F.lit(None).cast("double").alias(c) for c in [*METRICS, "rep_ratio"]}
    return markers.select("ord", head.alias("fasta_header"), F.length("seq").alias("length"), *[metric[c] for c in METRICS], metric["rep_ratio"], "n_nodes", "seq")


def write_signatures(markers: DataFrame, fasta: Path, csv: Path) -> int:
    """signatures.fasta and signatures.csv; the signatures of a run are few, the rows reach the driver one by one."""
    t = signature_table(markers).orderBy("ord")
    names = [c for c in t.columns if c not in ("ord", "seq")]
    n = 0
    with open(fasta, "w", newline="\n") as f, open(csv, "w", newline="\n") as c:
        c.write(",".join(names) + "\n")
        for r in t.toLocalIterator():
            f.write(f">{r['fasta_header']}\n{r['seq']}\n")
            c.write(",".join("" if r[k] is None else str(r[k]) for k in names) + "\n")
            n += 1
    return n


def write_assemblies(assemblies: DataFrame, path: Path) -> None:
    with open(path, "w", newline="\n") as f:
        f.write(",path,is_target\n")
        for r in assemblies.orderBy("assembly_idx").toLocalIterator():
            f.write(f"{r['assembly_idx']},{r['path']},{r['is_target']}\n")


def write_json(path: Path, values: dict) -> None:
    path.write_text(json.dumps(values, indent=4, default=str) + "\n")


def save_tables(tables: dict[str, DataFrame], to: str, overwrite: bool = False) -> None:
    """A run as one Parquet directory a table."""
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{to}/{name}")


def load_tables(spark: SparkSession, at: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{at}/{n}") for n in names}


def search_database(records: DataFrame, assemblies: DataFrame, negatives_only: bool = False) -> DataFrame:
    """Records with the subject name ``assembly@y|n@record`` that hits of outside tools carry."""
    flag = assemblies.select("assembly_idx", "is_target").distinct()
    r = records.join(flag, "assembly_idx").where(~F.col("is_target") if negatives_only else F.lit(True))
    yn = F.when(F.col("is_target"), "y").otherwise("n")
    return r.select(F.concat_ws("@", F.col("assembly_idx").cast("string"), yn, F.coalesce("record_id", F.lit(""))).alias("sseqid"), "seq")


def write_search_database(records: DataFrame, assemblies: DataFrame, to: str, negatives_only: bool = False) -> None:
    """The search database as FASTA files in a folder, written by the executors."""
    t = search_database(records, assemblies, negatives_only)
    t.select(F.concat(F.lit(">"), "sseqid", F.lit("\n"), F.coalesce("seq", F.lit("")))).write.mode("errorifexists").text(to)


def save_sketches(sketches: DataFrame, to: str, k: int, size: int, overwrite: bool = False) -> None:
    """Bottom sketches with the length of their k-mers and their size, as Parquet."""
    t = sketches.withColumn("kmerlen", F.lit(k)).withColumn("sketchsize", F.lit(size))
    t.write.mode("overwrite" if overwrite else "errorifexists").parquet(to)


def load_sketches(spark: SparkSession, at: str, k: int, size: int) -> DataFrame:
    """Sketches saved before; an error where they are of another k-mer length or size."""
    t = spark.read.parquet(at)
    if not t.where((F.col("kmerlen") != k) | (F.col("sketchsize") != size)).isEmpty():
        raise ValueError(f"{at} holds sketches of other parameters than {k} and {size}")
    return t.drop("kmerlen", "sketchsize")
