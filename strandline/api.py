"""A full run: from sequence files to signatures."""

from __future__ import annotations

import json
import logging
import random
import uuid
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.config import Config
from strandline.operators import align, expand, graph, markers, metrics, sketch
from strandline.session import materialize, reach_workers, scratch_root
from strandline.sources import fasta, paths, tables

log = logging.getLogger(__name__)
_SAVED = ["assemblies", "nodes", "subgraphs", "signatures"]


@dataclass
class Run:
    """The tables of a run and where it wrote."""

    config: dict
    out: Path
    assemblies: DataFrame
    nodes: DataFrame | None = None
    subgraphs: DataFrame | None = None
    signatures: DataFrame | None = None
    thresholds: graph.Thresholds | None = None


@dataclass
class MinimizerGraph:
    """Occurrences, nodes and edges of a collection of records."""

    kmers: DataFrame
    nodes: DataFrame
    edges: DataFrame
    record_offsets: DataFrame

    def filter(self, hashes: DataFrame) -> MinimizerGraph:
        """The graph of these hashes (column ``hash``): its occurrences, nodes, and edges of which both ends remain."""
        keep = hashes.select("hash").distinct()
        ends = self.edges.join(keep.withColumnRenamed("hash", "first"), "first", "left_semi").join(keep.withColumnRenamed("hash", "second"), "second", "left_semi")
        return MinimizerGraph(self.kmers.join(keep, "hash", "left_semi"), self.nodes.join(keep, "hash", "left_semi"), ends.select("first", "second", "weight"), self.record_offsets)

    def get_penalty(self, assemblies: DataFrame) -> DataFrame:
        """The nodes with ``n_tar, n_neg, penalty``; an error where the offsets or the classes of the assemblies do not fit."""
        graph.check_offsets(self.record_offsets, assemblies)
        return graph.score_nodes(self.kmers, assemblies, graph.class_totals(assemblies))

    def tables(self) -> dict[str, DataFrame]:
        """The tables in the order of their keys."""
        return {"kmers": self.kmers.sort("hash", "assembly_idx", "record_no", "pos"), "nodes": self.nodes.sort("hash"), "edges": self.edges.sort("first", "second"), "record_offsets": self.record_offsets.sort("assembly_idx")}


def build_graph(records: DataFrame, assemblies: DataFrame, k: int = 21, w: int = 200, low_memory: bool = False) -> MinimizerGraph:
    """Sketch the records and count nodes and edges; with ``low_memory`` the occurrences are sketched again where needed."""
    kmers = sketch.minimizers(records, k, w)
    if not low_memory:
        kmers = materialize(kmers)
    return MinimizerGraph(kmers, graph.count_nodes(kmers), graph.edges(kmers), graph.record_offsets(records, assemblies))


def find_signatures(
    records: DataFrame, assemblies: DataFrame, k: int, w: int, *, min_len: int, max_len: int | None = None, penalty_th: float | None = None,
    run_mash: bool = False, stringency: int = 5, cap: float = 0.2, edge_mul: float = 0.3, floor: int = 3, max_cap: int | None = 100,
    sketchsize: int = 1000, seed: int = 42, evaluate: bool = False, neg_only: bool = False, low_memory: bool = False, order: str = "shuffle",
) -> tuple[DataFrame, DataFrame, DataFrame, graph.Thresholds, MinimizerGraph]:
    """(signatures, subgraphs, nodes, thresholds, graph) of a collection; no signature gives an empty frame."""
    totals = graph.class_totals(assemblies)
    g = build_graph(records, assemblies, k, w, low_memory)
    nodes = materialize(graph.score_nodes(g.kmers, assemblies, totals))
    absence, presence = (1.0, 0.0) if penalty_th is not None else _rates(g, nodes, assemblies, totals, run_mash, sketchsize)
    th = graph.thresholds(absence, presence, totals[0], w, min_len, max_len, penalty_th=penalty_th, stringency=stringency, cap=cap, edge_mul=edge_mul, floor=floor, max_cap=max_cap)
    log.info("penalty threshold %.5f, edge weight above %.3f, %s to %s nodes", th.penalty, th.edge_weight, th.min_nodes, th.max_nodes)
    kept = materialize(graph.heavy_edges(g.edges, th.edge_weight))
    left = graph.connected_nodes(nodes, kept)
    sub = materialize(expand.subgraphs(left, kept, th.penalty, th.min_nodes, th.max_nodes, random.Random(seed), order))
    occ = markers.kmers_of(g.kmers, sub)
    loc = materialize(markers.locations(occ, assemblies, k, w))
    reps = markers.candidates(markers.representatives(loc, markers.representative_orders(loc)), min_len, totals[0])
    found = materialize(markers.fetch_sequences(reps, records).withColumnRenamed("subgraph_id", "ord"))
    if evaluate:
        _, ev = eval_markers(found.withColumn("qseqid", F.col("ord").cast("int")), records, assemblies, *totals, neg_only=neg_only)
        ev = ev.drop("qseqid")
        by = F.row_number().over(_whole(F.desc(F.col("conservation") + F.col("divergence")), F.col("ord")))
        found = ev.withColumn("ord", by - 1)
    return found, sub, nodes, th, g


def eval_markers(markers: DataFrame, records: DataFrame, assemblies: DataFrame, n_tar: int, n_neg: int, neg_only: bool = False, task: str = "blastn") -> tuple[DataFrame, DataFrame]:
    """(best hits, ``markers`` with metrics) of sequences (qseqid, seq) searched in all assemblies, or in non-targets alone.

    With ``neg_only``, which is faster, the metrics of targets are 0. No hit at all is an error; a marker without hit is
    logged unless only non-targets are searched. Assemblies of unknown class are not searched.
    """
    flag = assemblies.where(~F.col("is_target") if neg_only else F.col("is_target").isNotNull()).select("assembly_idx", "is_target").distinct()
    found = align.align(markers.select("qseqid", "seq"), records.join(flag.select("assembly_idx"), "assembly_idx", "left_semi"), task=task)
    best = materialize(metrics.best_hits(found.join(flag, "assembly_idx"), ["record_no", "sstart"]))
    if best.isEmpty():
        if markers.isEmpty():
            return best, metrics.marker_metrics(markers.withColumn("len", F.length("seq")), best, n_tar, n_neg)
        raise RuntimeError("no hit found")
    if not neg_only:
        lost = markers.join(best, "qseqid", "left_anti").count()
        if lost:
            log.warning("%d signatures have no hit in any assembly", lost)
    return best, metrics.marker_metrics(markers.withColumn("len", F.length("seq")), best, n_tar, n_neg)


def _whole(*order):
    from pyspark.sql import Window

    return Window.orderBy(*order)  # one row a signature


def _rates(g: MinimizerGraph, nodes: DataFrame, assemblies: DataFrame, totals: tuple[int, int], run_mash: bool, s: int) -> tuple[float, float]:
    if not run_mash:
        return graph.expected_rates(nodes, totals)
    sk = materialize(sketch.bottom_sketch(g.kmers, "assembly_idx", "hash", s))
    j = materialize(sketch.sketch_jaccard(sk, "assembly_idx", "hash", s))
    tar = assemblies.where("is_target").select("assembly_idx").distinct()
    neg = assemblies.where("NOT is_target").select("assembly_idx").distinct()
    return 1 - sketch.expected_fraction(j, tar, tar, True), sketch.expected_fraction(j, neg, tar, False)


def load_assemblies(spark: SparkSession, c: Config, out: Path) -> DataFrame:
    """Targets, then others; within each class taxa, then the path list, then the directory."""

    def side(taxa, listed, folder) -> list[Path]:
        if taxa and len(set(taxa)) < len(taxa):
            raise ValueError("a taxon is named twice")
        found = []
        for t in taxa or []:
            found += paths.download_taxon(t, out / "assemblies" / t.replace(" ", "_"), level=c.level, source=c.source, annotated=c.annotated, exclude_mag=c.exclude_mag, gzip=c.gzip, api_key=c.api_key, workers=c.n_cpu)
        return found + (paths.paths_in_list(listed) if listed else []) + (paths.paths_in_dir(folder) if folder else [])

    return paths.assembly_table(spark, side(c.tar_taxa, c.tar_paths, c.tar_dir), side(c.neg_taxa, c.neg_paths, c.neg_dir))


def run(spark: SparkSession, config: Config) -> Run:
    """Run ``config`` and write its outputs under ``prefix/title``."""
    reach_workers(spark)
    out = paths.checked_output(config.prefix / config.title, config.overwrite, directory=True)
    handler = logging.FileHandler(out / "strandline.log")
    root = logging.getLogger("strandline")
    root.addHandler(handler)
    try:
        tables.write_json(out / "config.json", config.to_dict())
        assemblies = load_assemblies(spark, config, out)
        tables.write_assemblies(assemblies, out / "assemblies.csv")
        result = Run(config.to_dict(), out, assemblies)
        if config.download_only:
            return result
        records = materialize(fasta.read_fasta(spark, assemblies))  # files are parsed once
        twice = fasta.repeated_names(records)
        if n := twice.count():
            log.warning("%d record ids are repeated in their assembly, such as %s", n, [tuple(r) for r in twice.limit(3).collect()])
        c = config
        found, sub, nodes, th, g = find_signatures(
            records, assemblies, c.kmerlen, c.windowsize, min_len=c.min_len, max_len=c.max_len, penalty_th=c.penalty_th, run_mash=c.run_mash,
            stringency=c.stringency, cap=c.penalty_th_cap, edge_mul=c.edge_w_th_mul, floor=c.min_nodes_floor, max_cap=c.max_nodes_cap,
            sketchsize=c.sketchsize, seed=c.seed, evaluate=c.run_blast, neg_only=c.blast_neg_only,
            low_memory=c.low_memory, order=c.order,
        )
        at = _tables_at(spark, c, out)
        tables.write_json(out / "tables.json", {"at": at})
        if c.save_graph:  # as built, before scoring
            tables.save_tables(g.tables(), f"{at}/graph", True)
        if sub.isEmpty():
            raise RuntimeError("no subgraph of low penalty was found: lower the stringency, or raise the penalty threshold (see the log)")
        found = materialize(found)
        n = tables.write_signatures(found, out / "signatures.fasta", out / "signatures.csv")
        log.info("%d signatures", n)
        result = replace(result, nodes=nodes, subgraphs=sub, signatures=found, thresholds=th)
        tables.save_tables({t: getattr(result, t) for t in _SAVED}, f"{at}/results", True)
        return result
    finally:
        root.removeHandler(handler)
        handler.close()


def _tables_at(spark: SparkSession, c: Config, out: Path) -> str:
    """Where executors write Parquet tables: the folder of the settings; beside the other files where driver and executors
    are one machine; else in the cluster's shared folder."""
    if c.tables:
        return c.tables.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return f"file://{out.resolve()}"
    return f"{scratch_root(spark)}/runs/{out.resolve().name}-{uuid.uuid4().hex[:8]}"


def load(spark: SparkSession, path: str | Path) -> dict[str, DataFrame]:
    """The tables of an earlier run."""
    at = json.loads((Path(path) / "tables.json").read_text())["at"]
    return tables.load_tables(spark, f"{at}/results", _SAVED)
