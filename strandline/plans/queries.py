"""One query per group of operators over the given tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import sequence as S
from strandline.operators import align, components, expand, graph, markers, metrics, sketch
from strandline.session import materialize, table
from strandline.sources import fasta, tables

K, W, GAP = 15, 10, 200
PENALTY_TH, WEIGHT_TH, SKETCH = 0.95, 2.0, 100


def _assemblies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "assemblies").select("assembly_idx", "is_target").distinct()


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").select("record_idx", "assembly_idx", "record_no", "record_id", "seq").distinct()


def _occ(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences by assembly and record; the sequences stay in their files."""
    of = table(spark, d, "records").select("record_idx", "assembly_idx", "record_no").distinct()
    k = table(spark, d, "kmers").select("kmer_no", "hash", "pos", "record_idx").distinct()
    return k.join(of, "record_idx").select("assembly_idx", "record_no", "hash", F.col("pos").cast("bigint").alias("pos"))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[int, int]]:
    a = _assemblies(spark, d)
    totals = graph.class_counts(a)
    return graph.score_nodes(_occ(spark, d), a, totals), totals


def _members(occ: DataFrame) -> DataFrame:
    """Every hash in the group of its range."""
    return occ.select("hash").distinct().withColumn("subgraph_id", F.expr(f"hash DIV {1 << 50}"))


def _nine(c: str):
    return F.round(c, 9).alias(c)


def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records written as FASTA and read again; one without id has an empty one."""
    r = _records(spark, d)
    return fasta.parse_texts(fasta.fasta_text(r)).groupBy("assembly_idx", "record_id", "seq").agg(F.count("*").alias("n"))


def record_offsets(spark: SparkSession, d: str) -> DataFrame:
    return graph.record_offsets(table(spark, d, "records"), _assemblies(spark, d))


def record_to_assembly(spark: SparkSession, d: str) -> DataFrame:
    offsets = record_offsets(spark, d)
    return graph.record_assembly(table(spark, d, "kmers").select("record_idx").distinct(), offsets)


def canonical_kmers(spark: SparkSession, d: str) -> DataFrame:
    k = sketch.portable_kmers(_records(spark, d), K)
    return k.groupBy("assembly_idx", "record_no").agg(F.count("*").alias("n_kmers"), F.min("hash").alias("least"), F.max("hash").alias("most"))


def minimizers(spark: SparkSession, d: str) -> DataFrame:
    return sketch.portable_minimizers(sketch.portable_kmers(_records(spark, d), K), W)


def rolling_minimizers(spark: SparkSession, d: str) -> DataFrame:
    """Minimizers of k = 21, w = 20 of every record by the rolling hash: how many, and sums that tell positions and hashes."""
    m = sketch.minimizers(_records(spark, d), 21, 20)
    return m.groupBy("assembly_idx", "record_no").agg(
        F.count("*").alias("n"), F.sum("pos").alias("positions"), F.min("hash").alias("least"), F.max("hash").alias("most"), F.expr("bit_xor(hash)").alias("folded")
    )


def node_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.count_nodes(_occ(spark, d))


def edge_weights(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(_occ(spark, d))


def node_penalties(spark: SparkSession, d: str) -> DataFrame:
    n, _ = _scored(spark, d)
    return n.select("hash", "n_occ", "n_tar", "n_neg", _nine("penalty"))


def thresholds(spark: SparkSession, d: str) -> DataFrame:
    n, totals = _scored(spark, d)
    absence, presence = graph.expected_rates(n, totals)
    t = graph.thresholds(absence, presence, totals[0], GAP, 200, None)
    row = (absence, presence, t.penalty, t.edge_weight, t.min_nodes, t.max_nodes)
    df = spark.createDataFrame([row], "absence double, presence double, penalty_th double, edge_th double, min_nodes int, max_nodes int")
    return df.select(*[_nine(c) for c in ("absence", "presence", "penalty_th", "edge_th")], "min_nodes", "max_nodes")


def heavy_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.heavy_edges(edge_weights(spark, d), WEIGHT_TH)


def connected_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_nodes(node_counts(spark, d), heavy_edges(spark, d))


def seed_nodes(spark: SparkSession, d: str) -> DataFrame:
    n, _ = _scored(spark, d)
    return graph.seeds(n, PENALTY_TH).select("hash", _nine("penalty"))


def graph_components(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_components(materialize(heavy_edges(spark, d)), "first", "second")


def _grown(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, _ = _scored(spark, d)
    edge = materialize(heavy_edges(spark, d))
    return expand.subgraphs(graph.connected_nodes(n, edge), edge, PENALTY_TH, 3, 100, order="hash"), edge


def subgraphs(spark: SparkSession, d: str) -> DataFrame:
    return _grown(spark, d)[0]


def subgraph_shapes(spark: SparkSession, d: str) -> DataFrame:
    sub, edge = _grown(spark, d)
    return graph.linear_graphs(graph.induced_edges(edge, sub), "subgraph_id")


def graph_orders(spark: SparkSession, d: str) -> DataFrame:
    sub, edge = _grown(spark, d)
    loc = markers.locations(markers.kmers_of(_occ(spark, d), sub), _assemblies(spark, d), 21, GAP)
    return graph.graph_orders(graph.induced_edges(edge, sub), markers.representative_orders(loc))


def node_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edge_weights(spark, d))


def directed_paths(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive hashes of a record, directed, and the first after the last."""
    o = _occ(spark, d).select(F.concat_ws("/", "assembly_idx", "record_no").alias("path"), "hash", F.struct("pos", "hash").alias("at"))
    return graph.path_edges(o, "path", "at", "hash", cyclic=True)


def merged_paths(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(graph.merge_weights(directed_paths(spark, d), edge_weights(spark, d)))


def kmers_in_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of nodes within the penalty threshold."""
    n, _ = _scored(spark, d)
    return _occ(spark, d).join(graph.seeds(n, PENALTY_TH).select("hash"), "hash", "left_semi").groupBy("assembly_idx", "hash").agg(F.count("*").alias("n"))


def run_summaries(spark: SparkSession, d: str) -> DataFrame:
    o = _occ(spark, d)
    r = markers.run_summaries(markers.kmers_of(o, _members(o)), GAP)
    return r.withColumn("kmers", F.array_join("kmers", ",")).withColumn("run", F.col("run").cast("int"))


def _locations(spark: SparkSession, d: str) -> DataFrame:
    o = _occ(spark, d)
    return markers.locations(markers.kmers_of(o, _members(o)), _assemblies(spark, d), 21, GAP)


def locations(spark: SparkSession, d: str) -> DataFrame:
    return _locations(spark, d).withColumn("kmers", F.array_join("kmers", ","))


def representatives(spark: SparkSession, d: str) -> DataFrame:
    loc = materialize(_locations(spark, d))
    n_tar = max(1, graph.class_counts(_assemblies(spark, d))[0])
    r = markers.candidates(markers.representatives(loc, markers.representative_orders(loc)), 22, n_tar)
    return r.select("subgraph_id", "assembly_idx", "record_no", "start", "stop", "n_rep", "n_nodes", _nine("rep_ratio"))


def strands(spark: SparkSession, d: str) -> DataFrame:
    loc = materialize(_locations(spark, d))
    both = loc.join(markers.representative_orders(loc), "subgraph_id")
    return both.select("subgraph_id", "assembly_idx", markers.strand(F.col("kmers"), F.col("rep")).alias("strand"))


def fetched_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Signatures as their records have them, held against the stated sequence."""
    s = table(spark, d, "signatures").select("sig_no", "record_idx", "start", "stop", F.col("seq").alias("stated")).distinct()
    of = table(spark, d, "records").select("record_idx", "assembly_idx", "record_no").distinct()
    f = markers.fetch_sequences(s.join(of, "record_idx"), _records(spark, d))
    return f.select("sig_no", "record_id", "seq", (F.col("seq") == F.col("stated")).alias("agrees"))


def signature_headers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "signatures").select("sig_no", "assembly_idx", "record_id", "start", "stop").distinct()
    return s.select("sig_no", S.location_header(F.col("assembly_idx"), F.coalesce("record_id", F.lit("")), F.col("start"), F.col("stop")).alias("header"))


def signature_csv(spark: SparkSession, d: str) -> DataFrame:
    """The table of a run's signatures with their reverse complement."""
    s = table(spark, d, "signatures").drop("scored_at", "fasta_header", "length").distinct()
    t = tables.signature_table(s.withColumn("ord", F.col("sig_no")))
    return t.select("ord", "fasta_header", "length", *[_nine(c) for c in [*metrics.METRICS, "rep_ratio"]], "n_nodes", S.revcomp(F.col("seq")).alias("rc"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Line items as hits: parts are queries, suppliers assemblies."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("qseqid"), F.concat_ws("@", F.col("l_suppkey").cast("string"), S.yes_no(F.col("l_suppkey") % 2 == 0), F.lit("r")).alias("sseqid"),
        F.col("l_quantity").alias("nident"), F.col("l_linenumber").alias("mismatch"), F.lit(1).alias("gaps"), F.col("l_extendedprice").alias("bitscore"),
        F.col("l_orderkey").alias("hit"),
    )


def best_hits(spark: SparkSession, d: str) -> DataFrame:
    b = metrics.best_hits(metrics.parse_subjects(_hits(spark, d)), ["hit", "mismatch"])
    return b.select("qseqid", "assembly_idx", "is_target", "nident", "mismatch", "bitscore", "n_hits", _nine("avg_nident"))


def marker_metrics(spark: SparkSession, d: str) -> DataFrame:
    best = metrics.best_hits(metrics.parse_subjects(_hits(spark, d)), ["hit", "mismatch"])
    m = table(spark, d, "part").select(F.col("p_partkey").alias("qseqid"), (F.col("p_size") + 10).alias("len")).distinct()
    n = table(spark, d, "supplier").agg(F.count_if(F.col("s_suppkey") % 2 == 0), F.count_if(F.col("s_suppkey") % 2 != 0)).first()
    r = metrics.rank_markers(metrics.marker_metrics(m, best, n[0], n[1]))
    return r.select("qseqid", "len", *[_nine(c) for c in metrics.METRICS])


def _sketches(spark: SparkSession, d: str) -> DataFrame:
    return sketch.bottom_sketch(_occ(spark, d), "assembly_idx", "hash", SKETCH)


def bottom_sketches(spark: SparkSession, d: str) -> DataFrame:
    return _sketches(spark, d)


def sketch_jaccard(spark: SparkSession, d: str) -> DataFrame:
    j = sketch.sketch_jaccard(materialize(_sketches(spark, d)), "assembly_idx", "hash", SKETCH)
    return j.select("a", "b", _nine("jaccard"), F.round(sketch.mash_distance(F.col("jaccard"), 21), 9).alias("distance"))


def expected_fractions(spark: SparkSession, d: str) -> DataFrame:
    j = materialize(sketch.sketch_jaccard(materialize(_sketches(spark, d)), "assembly_idx", "hash", SKETCH))
    a = _assemblies(spark, d)
    tar, neg = a.where("is_target").select("assembly_idx"), a.where("NOT is_target").select("assembly_idx")
    row = (1 - sketch.expected_fraction(j, tar, tar, True), sketch.expected_fraction(j, neg, tar, False))
    return spark.createDataFrame([row], "absence double, presence double").select(_nine("absence"), _nine("presence"))


def shared_cells(spark: SparkSession, d: str) -> DataFrame:
    """A distance table's ``shared/total`` column parsed."""
    t = table(spark, d, "runs").select("run_no", F.concat_ws("/", "n_keep", "n_signatures").alias("cell")).distinct()
    return t.select("run_no", F.round(S.shared_fraction(F.col("cell")), 9).alias("fraction"))


def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of several records; records without id share none."""
    r = _records(spark, d).where("record_id IS NOT NULL")
    return r.groupBy("record_id").agg(F.count("*").alias("n"), F.countDistinct("assembly_idx").alias("n_assemblies")).where("n > 1")


def even_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Assemblies in 16 chunks whose sizes differ by one at most, the larger first."""
    from pyspark.sql import Window

    return _assemblies(spark, d).select("assembly_idx", F.ntile(16).over(Window.orderBy("assembly_idx")).alias("chunk"))  # one row an assembly


def weighted_modes(spark: SparkSession, d: str) -> DataFrame:
    """The record id of most letters in each assembly, the smallest of equal ones; a record without id has an empty one."""
    r = _records(spark, d).where("seq IS NOT NULL").withColumn("record_id", F.coalesce("record_id", F.lit("")))
    w = r.groupBy("assembly_idx", "record_id").agg(F.sum(F.length("seq")).alias("letters"))
    return w.groupBy("assembly_idx").agg(F.min_by(F.struct("record_id", "letters"), F.struct(-F.col("letters"), F.col("record_id"))).alias("m")).select("assembly_idx", "m.*")


def seed_hits(spark: SparkSession, d: str) -> DataFrame:
    """Signatures and the bands of records that share seeds of 31 letters with them."""
    q = table(spark, d, "signatures").select(F.col("sig_no").cast("int").alias("qseqid"), "seq").distinct()
    return align.seed_hits(q, _records(spark, d), 31, 1).withColumn("band", F.col("band").cast("bigint"))


def alignments(spark: SparkSession, d: str) -> DataFrame:
    """Signatures aligned to all records, with the seeds and the E-value of a run."""
    q = table(spark, d, "signatures").select(F.col("sig_no").cast("int").alias("qseqid"), "seq").distinct()
    return align.align(q, _records(spark, d), max_hsps=None, max_targets=None).drop("sseq")


def exact_alignments(spark: SparkSession, d: str) -> DataFrame:
    """The records that hold a whole signature, and its strand, for signatures with 23 known letters in a row: these the seeds are sure to find."""
    q = table(spark, d, "signatures").select(F.col("sig_no").cast("int").alias("qseqid"), "seq").distinct()
    hits = align.align(q, _records(spark, d), max_hsps=None, max_targets=None)
    n = q.where(F.col("seq").rlike("[ACGT]{23}")).select("qseqid", F.length("seq").alias("n"))
    whole = hits.join(n, "qseqid").where("nident = n AND mismatch = 0 AND gaps = 0 AND qstart = 1 AND qend = n")
    return whole.select("qseqid", "assembly_idx", "record_no", (F.col("sstart") < F.col("send")).alias("forward")).distinct()


def search_names(spark: SparkSession, d: str) -> DataFrame:
    """Records as the search database names them; an assembly of unknown class is in none."""
    t = tables.search_database(_records(spark, d), _assemblies(spark, d).where("is_target IS NOT NULL"))
    return t.groupBy("sseqid").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("letters"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events with steps of at most an hour."""
    e = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    r = markers.consecutive_runs(e, ["user_id"], "us", 3_600_000_000)
    return r.groupBy("user_id", F.col("run").cast("int").alias("run")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


QUERIES = {
    f.__name__: f
    for f in (
        fasta_roundtrip, record_offsets, record_to_assembly, canonical_kmers, minimizers, rolling_minimizers, node_counts, edge_weights, node_penalties,
        thresholds, heavy_edges, connected_nodes, seed_nodes, graph_components, subgraphs, subgraph_shapes, graph_orders, node_degrees, directed_paths, merged_paths,
        kmers_in_nodes, run_summaries, locations, representatives, strands, fetched_sequences, signature_headers, signature_csv, best_hits,
        marker_metrics, bottom_sketches, sketch_jaccard, expected_fractions, shared_cells, repeated_ids, even_chunks, weighted_modes, seed_hits,
        alignments, exact_alignments, search_names, event_sessions,
    )
}

_A = "a AS (SELECT DISTINCT assembly_idx, is_target FROM assemblies)"
_R = "r AS (SELECT DISTINCT record_idx, assembly_idx, record_no, record_id, seq FROM records)"
_O = f"""WITH RECURSIVE {_A}, {_R},
     o AS (SELECT assembly_idx, record_no, hash, pos::BIGINT AS pos FROM (SELECT DISTINCT kmer_no, hash, pos, record_idx FROM kmers) JOIN r USING (record_idx))"""
_T = "t AS (SELECT greatest(1, count(*) FILTER (is_target)) AS nt, greatest(1, count(*) FILTER (NOT is_target)) AS nn FROM a)"
_N = f"""{_O}, {_T},
     q AS (SELECT hash, assembly_idx, count(*) AS n FROM o GROUP BY ALL),
     m AS (SELECT hash, sum(n)::BIGINT AS n_occ, count(*) FILTER (is_target)::INT AS n_tar, count(*) FILTER (NOT is_target)::INT AS n_neg
           FROM q LEFT JOIN a USING (assembly_idx) GROUP BY hash),
     n AS (SELECT m.*, sqrt((1.0::DOUBLE - n_tar * (1.0::DOUBLE / nt)) * (1.0::DOUBLE - n_tar * (1.0::DOUBLE / nt))
                            + n_neg * (1.0::DOUBLE / nn) * (n_neg * (1.0::DOUBLE / nn))) AS penalty FROM m, t)"""
_E = f"""{_O},
     l AS (SELECT assembly_idx, hash, lead(hash) OVER (PARTITION BY assembly_idx, record_no ORDER BY pos, hash) AS after FROM o),
     e AS (SELECT first, second, count(*) AS weight FROM
            (SELECT DISTINCT assembly_idx, least(hash, after) AS first, greatest(hash, after) AS second FROM l WHERE after IS NOT NULL) GROUP BY ALL)"""
_P = f"""{_R},
     x AS (SELECT assembly_idx, record_no, upper(seq) AS s, unnest(range(0, length(seq) - {K - 1})) AS pos FROM r WHERE length(seq) >= {K}),
     y AS (SELECT assembly_idx, record_no, pos::BIGINT AS pos, s[pos + 1:pos + {K}] AS k FROM x),
     k AS (SELECT assembly_idx, record_no, pos, ('0x' || substr(md5(least(k, reverse(translate(k, 'ACGT', 'TGCA')))), 1, 15))::BIGINT AS hash
           FROM y WHERE regexp_full_match(k, '[ACGT]+'))"""
_L = f"""{_O},
     g AS (SELECT hash // {1 << 50} AS subgraph_id, * FROM o),
     g1 AS (SELECT *, coalesce((pos - lag(pos) OVER w > {1.5 * GAP})::INT, 0) AS gap FROM g WINDOW w AS (PARTITION BY subgraph_id, assembly_idx, record_no ORDER BY pos)),
     g2 AS (SELECT *, sum(gap) OVER (PARTITION BY subgraph_id, assembly_idx, record_no ORDER BY pos ROWS UNBOUNDED PRECEDING)::INT AS run FROM g1),
     u AS (SELECT subgraph_id, assembly_idx, record_no, run, min(pos) AS start, max(pos) AS last, count(*) AS n_kmers,
                  list_transform(list_sort(list({{'pos': pos, 'hash': hash}})), lambda z: z.hash) AS kmers FROM g2 GROUP BY ALL),
     v AS (SELECT *, row_number() OVER (PARTITION BY subgraph_id, assembly_idx ORDER BY n_kmers DESC, record_no, start) AS rn,
                  count(*) OVER (PARTITION BY subgraph_id, assembly_idx) AS n_repeats FROM u),
     loc AS (SELECT subgraph_id, v.assembly_idx, record_no, start, last + 21 AS stop, last + 21 - start AS len, n_kmers, kmers, n_repeats, is_target
             FROM v LEFT JOIN a USING (assembly_idx) WHERE rn = 1),
     c1 AS (SELECT subgraph_id, kmers, least(kmers, list_reverse(kmers)) AS canon, count(*) AS n, min(assembly_idx) AS seen FROM loc WHERE is_target GROUP BY ALL),
     c2 AS (SELECT subgraph_id, canon, sum(n) AS n_rep, min(seen) AS seen, sum(CASE WHEN kmers = canon THEN n ELSE 0 END) AS nc FROM c1 GROUP BY ALL),
     c3 AS (SELECT *, row_number() OVER (PARTITION BY subgraph_id ORDER BY len(canon) * n_rep DESC, seen, canon) AS rn FROM c2),
     rep AS (SELECT subgraph_id, CASE WHEN 2 * nc >= n_rep THEN canon ELSE list_reverse(canon) END AS rep, n_rep FROM c3 WHERE rn = 1)"""
_S = f"""{_O},
     z AS (SELECT assembly_idx, hash, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY assembly_idx ORDER BY hash) AS rn
             FROM (SELECT DISTINCT assembly_idx, hash FROM o)) WHERE rn <= {SKETCH}),
     p AS (SELECT x.assembly_idx AS a, y.assembly_idx AS b, x.hash, x.rn + y.rn AS ranks,
                  row_number() OVER (PARTITION BY x.assembly_idx, y.assembly_idx ORDER BY x.hash) AS c
           FROM z x JOIN z y USING (hash) WHERE x.assembly_idx < y.assembly_idx),
     s AS (SELECT assembly_idx, count(*) AS n FROM z GROUP BY ALL),
     j AS (SELECT a, b, count(*) FILTER (ranks - c <= {SKETCH}) / least({SKETCH}, any_value(sa.n) + any_value(sb.n) - count(*))::DOUBLE AS jaccard
           FROM p JOIN s sa ON sa.assembly_idx = a JOIN s sb ON sb.assembly_idx = b GROUP BY ALL)"""
_H = """WITH h AS (SELECT l_partkey AS qseqid, l_suppkey::INT AS assembly_idx, l_suppkey % 2 = 0 AS is_target, l_quantity AS nident, l_linenumber AS mismatch,
              l_extendedprice AS bitscore, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn,
              count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n_hits, avg(l_quantity) OVER (PARTITION BY l_partkey, l_suppkey) AS avg_nident FROM lineitem),
     b AS (SELECT * FROM h WHERE rn = 1)"""
_METRICS = ", ".join(f"CASE WHEN NOT isnan({c}) THEN round({c}, 9) END AS {c}" for c in [*metrics.METRICS, "rep_ratio"])

ORACLES = {
    "fasta_roundtrip": f"WITH {_R} SELECT assembly_idx, coalesce(record_id, '') AS record_id, coalesce(seq, '') AS seq, count(*) AS n FROM r GROUP BY ALL",
    "record_offsets": f"""WITH {_A}, c AS (SELECT assembly_idx, count(DISTINCT record_no) AS n FROM records GROUP BY ALL)
SELECT assembly_idx, (sum(coalesce(n, 0)) OVER w - coalesce(n, 0))::BIGINT AS first_record, (sum(coalesce(n, 0)) OVER w)::BIGINT AS stop_record
FROM (SELECT DISTINCT assembly_idx FROM a) LEFT JOIN c USING (assembly_idx) WINDOW w AS (ORDER BY assembly_idx)""",
    "record_to_assembly": f"""WITH {_A}, c AS (SELECT assembly_idx, count(DISTINCT record_no) AS n FROM records GROUP BY ALL),
     f AS (SELECT assembly_idx, sum(coalesce(n, 0)) OVER (ORDER BY assembly_idx) - n AS lo, sum(coalesce(n, 0)) OVER (ORDER BY assembly_idx) AS hi
           FROM (SELECT DISTINCT assembly_idx FROM a) LEFT JOIN c USING (assembly_idx))
SELECT record_idx, assembly_idx FROM (SELECT DISTINCT record_idx FROM kmers) JOIN f ON record_idx >= lo AND record_idx < hi""",
    "canonical_kmers": f"WITH {_P} SELECT assembly_idx, record_no, count(*) AS n_kmers, min(hash) AS least, max(hash) AS most FROM k GROUP BY ALL",
    "minimizers": f"""WITH {_P},
     w AS (SELECT assembly_idx, record_no, min({{'hash': hash, 'neg': -pos}}) OVER (PARTITION BY assembly_idx, record_no ORDER BY pos ROWS {W - 1} PRECEDING) AS m,
                  row_number() OVER (PARTITION BY assembly_idx, record_no ORDER BY pos) AS rn FROM k)
SELECT DISTINCT assembly_idx, record_no, m.hash AS hash, -m.neg AS pos FROM w WHERE rn >= {W}""",
    # the rolling hash letter by letter: 64 bits are a ring of 31 and one of 33, turned apart; both strands are added
    "rolling_minimizers": f"""WITH {_R},
     seed AS (SELECT unnest(['A', 'C', 'G', 'T']) AS l, unnest(['T', 'G', 'C', 'A']) AS other, unnest([{", ".join(f"{x}::HUGEINT" for x in sketch.NT_SEEDS)}]) AS s),
     ring AS (SELECT l, other, s // 8589934592 AS up, s % 8589934592 AS lo, unnest(range(0, 21))::HUGEINT AS j FROM seed),
     turned AS (SELECT l, other, j, ((up * (1::HUGEINT << (j % 31))) % 2147483648 + (up // (1::HUGEINT << (31 - j % 31)))) % 2147483648 * 8589934592
                  + (lo * (1::HUGEINT << (j % 33))) % 8589934592 + lo // (1::HUGEINT << (33 - j % 33)) AS v FROM ring),
     x AS (SELECT assembly_idx, record_no, upper(seq) AS s, unnest(range(0, length(seq) - 20)) AS pos FROM r WHERE length(seq) >= 21),
     k AS (SELECT assembly_idx, record_no, pos, s[pos + 1:pos + 21] AS k FROM x WHERE regexp_full_match(s[pos + 1:pos + 21], '[ACGT]+')),
     y AS (SELECT assembly_idx, record_no, pos, i, k[i + 1] AS l FROM (SELECT *, unnest(range(0, 21)) AS i FROM k)),
     h AS (SELECT assembly_idx, record_no, pos, (bit_xor(f.v::UHUGEINT) + bit_xor(b.v::UHUGEINT)) % 18446744073709551616::UHUGEINT AS low
           FROM y JOIN turned f ON f.l = y.l AND f.j = 20 - i JOIN turned b ON b.other = y.l AND b.j = i GROUP BY ALL),
     w AS (SELECT assembly_idx, record_no, min({{'low': low, 'neg': -pos}}) OVER o AS m, row_number() OVER (PARTITION BY assembly_idx, record_no ORDER BY pos) AS rn
           FROM h WINDOW o AS (PARTITION BY assembly_idx, record_no ORDER BY pos ROWS 19 PRECEDING)),
     p AS (SELECT DISTINCT assembly_idx, record_no, -m.neg AS pos, m.low * {(1 ^ (21 * sketch.NT_MULTIPLIER)) & 0xFFFFFFFFFFFFFFFF}::UHUGEINT % 18446744073709551616::UHUGEINT AS t FROM w WHERE rn >= 20),
     z AS (SELECT assembly_idx, record_no, pos::BIGINT AS pos, (xor(t, t // {1 << sketch.NT_SHIFT}::UHUGEINT)::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT AS hash FROM p)
SELECT assembly_idx, record_no, count(*) AS n, sum(pos)::BIGINT AS positions, min(hash) AS least, max(hash) AS most, bit_xor(hash) AS folded FROM z GROUP BY ALL""",
    "node_counts": f"{_O} SELECT hash, count(*) AS n_occ FROM o GROUP BY ALL",
    "edge_weights": f"{_E} SELECT * FROM e",
    "node_penalties": f"{_N} SELECT hash, n_occ, n_tar, n_neg, round(penalty, 9) AS penalty FROM n",
    "thresholds": f"""{_N}, w AS (SELECT CASE WHEN sum(n_tar) > 0 THEN 1 - sum(n_tar * n_tar)::DOUBLE / any_value(nt) / sum(n_tar) ELSE 1 END AS ab,
              CASE WHEN sum(n_tar) > 0 THEN sum(n_tar * n_neg)::DOUBLE / any_value(nn) / sum(n_tar) ELSE 0 END AS pr FROM n, t),
     th AS (SELECT *, least(0.2::DOUBLE, 0.5::DOUBLE * sqrt(ab * pr)) AS p, (SELECT count(*) FROM a WHERE is_target) AS n FROM w)
SELECT round(ab, 9) AS absence, round(pr, 9) AS presence, round(p, 9) AS penalty_th, round(0.3::DOUBLE * (1 - p) * n, 9) AS edge_th,
       greatest(3, 200 // {(GAP + 1) // 2} + 1)::INT AS min_nodes, 100::INT AS max_nodes FROM th""",
    "heavy_edges": f"{_E} SELECT * FROM e WHERE weight > {WEIGHT_TH}",
    "connected_nodes": f"""{_E}, h AS (SELECT * FROM e WHERE weight > {WEIGHT_TH})
SELECT hash, count(*) AS n_occ FROM o WHERE hash IN (SELECT first FROM h UNION SELECT second FROM h) GROUP BY ALL""",
    "seed_nodes": f"{_N} SELECT hash, round(penalty, 9) AS penalty FROM n WHERE penalty <= {PENALTY_TH}::DOUBLE",
    "graph_components": f"""{_E}, h AS MATERIALIZED (SELECT first x, second y FROM e WHERE weight > {WEIGHT_TH} AND first <> second),
     s AS MATERIALIZED (SELECT x, y FROM h UNION SELECT y, x FROM h), c AS (SELECT x AS n, x AS m FROM s UNION SELECT s.y, c.m FROM c JOIN s ON s.x = c.n)
SELECT n AS node, min(m) AS component FROM c GROUP BY n""",
    "node_degrees": f"{_E} SELECT hash, count(*) AS degree FROM (SELECT first AS hash FROM e UNION ALL SELECT second FROM e) GROUP BY ALL",
    "directed_paths": f"""{_O}, d AS (SELECT hash AS first, coalesce(lead(hash) OVER w, first_value(hash) OVER w) AS second FROM o
      WINDOW w AS (PARTITION BY assembly_idx, record_no ORDER BY pos, hash)) SELECT first, second, count(*) AS weight FROM d GROUP BY ALL""",
    "merged_paths": f"""{_E}, d AS (SELECT hash AS first, coalesce(lead(hash) OVER w, first_value(hash) OVER w) AS second, 1 AS weight FROM o
      WINDOW w AS (PARTITION BY assembly_idx, record_no ORDER BY pos, hash)), f AS (SELECT * FROM d UNION ALL SELECT * FROM e)
SELECT least(first, second) AS first, greatest(first, second) AS second, sum(weight)::BIGINT AS weight FROM f GROUP BY 1, 2""",
    "kmers_in_nodes": f"{_N} SELECT assembly_idx, hash, count(*) AS n FROM o WHERE hash IN (SELECT hash FROM n WHERE penalty <= {PENALTY_TH}::DOUBLE) GROUP BY ALL",
    "run_summaries": f"{_L} SELECT * REPLACE (array_to_string(kmers, ',') AS kmers) FROM u",
    "locations": f"{_L} SELECT * REPLACE (array_to_string(kmers, ',') AS kmers) FROM loc",
    "representatives": f"""{_L}, {_T}, w AS (SELECT subgraph_id, rep, n_rep, min({{'assembly_idx': assembly_idx, 'record_no': record_no, 'start': start, 'stop': stop, 'len': len}}) AS x
       FROM loc JOIN rep USING (subgraph_id) WHERE kmers = rep GROUP BY ALL)
SELECT subgraph_id, x.assembly_idx AS assembly_idx, x.record_no AS record_no, x.start AS start, x.stop AS stop, n_rep::BIGINT AS n_rep, len(rep)::INT AS n_nodes,
       round(n_rep / nt::DOUBLE, 9) AS rep_ratio FROM w, t WHERE x.len >= 22 AND len(rep) > 1 AND len(list_distinct(rep)) = len(rep)""",
    "strands": f"""{_L},
     s1 AS (SELECT subgraph_id, assembly_idx, kmers, rep, list_filter(kmers, lambda z: list_contains(rep, z)) AS met FROM loc JOIN rep USING (subgraph_id)),
     s2 AS (SELECT *, list_transform(met, lambda z: list_position(rep, z)) AS places, len(list_distinct(rep)) < len(rep) AS again,
                   ',' || array_to_string(met, ',(?:.*,)?') || ',' AS pattern FROM s1)
SELECT subgraph_id, assembly_idx, CASE WHEN kmers = rep THEN '+' WHEN kmers = list_reverse(rep) THEN '-' WHEN len(met) = 0 THEN '?' WHEN len(met) = 1 THEN 'u'
       WHEN CASE WHEN again THEN regexp_matches(',' || array_to_string(rep, ',') || ',', pattern) ELSE places = list_sort(places) END THEN '+'
       WHEN CASE WHEN again THEN regexp_matches(',' || array_to_string(list_reverse(rep), ',') || ',', pattern) ELSE places = list_reverse_sort(places) END THEN '-' ELSE '?' END AS strand
FROM s2""",
    "fetched_sequences": f"""WITH {_R} SELECT sig_no, r.record_id, upper(substr(r.seq, start + 1, stop - start)) AS seq, upper(substr(r.seq, start + 1, stop - start)) = s.seq AS agrees
FROM (SELECT DISTINCT sig_no, record_idx, start, stop, seq FROM signatures) s JOIN r USING (record_idx)""",
    "signature_headers": """SELECT DISTINCT sig_no, assembly_idx || '-' || coalesce(record_id, '') || '-' || start || ':' || stop AS header FROM signatures""",
    "signature_csv": f"""SELECT sig_no AS ord, assembly_idx || '-' || coalesce(record_id, '') || '-' || start || ':' || stop AS fasta_header, length(seq)::INT AS length, {_METRICS}, n_nodes,
       reverse(translate(seq, 'ACGTacgt', 'TGCAtgca')) AS rc FROM (SELECT DISTINCT * EXCLUDE (scored_at, fasta_header, length) FROM signatures)""",
    "best_hits": f"{_H} SELECT qseqid, assembly_idx, is_target, nident, mismatch, bitscore, n_hits, round(avg_nident, 9) AS avg_nident FROM b",
    "marker_metrics": f"""{_H}, n AS (SELECT count(*) FILTER (s_suppkey % 2 = 0) AS nt, count(*) FILTER (s_suppkey % 2 <> 0) AS nn FROM supplier),
     m AS (SELECT DISTINCT p_partkey AS qseqid, p_size + 10 AS len FROM part)
SELECT m.qseqid, len, round(coalesce(sum(nident) FILTER (is_target) / len::DOUBLE / any_value(nt), 0), 9) AS conservation,
       round(count(*) FILTER (is_target) / any_value(nt)::DOUBLE, 9) AS f_tar_hits,
       round(coalesce(sum(mismatch + 1) FILTER (NOT is_target) / len::DOUBLE / any_value(nn), 0), 9) AS divergence,
       round(count(*) FILTER (NOT is_target) / any_value(nn)::DOUBLE, 9) AS f_neg_hits, round(coalesce(avg(n_hits) FILTER (is_target), 0), 9) AS avg_repeats_tar,
       round(coalesce(avg(avg_nident) FILTER (is_target) / len::DOUBLE, 0), 9) AS avg_pident_tar,
       round(coalesce(avg(n_hits) FILTER (NOT is_target), 0), 9) AS avg_repeats_neg, round(coalesce(avg(avg_nident) FILTER (NOT is_target) / len::DOUBLE, 0), 9) AS avg_pident_neg
FROM m LEFT JOIN b USING (qseqid), n GROUP BY m.qseqid, len""",
    "bottom_sketches": f"{_S} SELECT * FROM z",
    "sketch_jaccard": f"""{_S} SELECT a, b, round(jaccard, 9) AS jaccard,
       round(CASE WHEN jaccard <= 0 THEN 1 ELSE least(1.0::DOUBLE, -ln(2 * jaccard / (1 + jaccard)) / 21) END, 9) AS distance FROM j""",
    "expected_fractions": f"""{_S}, f AS (SELECT a AS x, b AS y, 2 * jaccard / (1 + jaccard) AS f FROM j UNION ALL SELECT b, a, 2 * jaccard / (1 + jaccard) FROM j),
     tt AS (SELECT assembly_idx FROM a WHERE is_target), nn AS (SELECT assembly_idx FROM a WHERE NOT is_target),
     c AS (SELECT (SELECT count(*) FROM tt) AS nt, (SELECT count(*) FROM nn) AS nn)
SELECT round(1 - ((SELECT coalesce(sum(f), 0) FROM f WHERE x IN (FROM tt) AND y IN (FROM tt)) + nt) / greatest(1, nt * nt)::DOUBLE, 9) AS absence,
       round((SELECT coalesce(sum(f), 0) FROM f WHERE x IN (FROM nn) AND y IN (FROM tt)) / greatest(1, nn * nt)::DOUBLE, 9) AS presence FROM c""",
    "shared_cells": "SELECT DISTINCT run_no, round(n_keep / n_signatures::DOUBLE, 9) AS fraction FROM runs",
    "repeated_ids": f"WITH {_R} SELECT record_id, count(*) AS n, count(DISTINCT assembly_idx) AS n_assemblies FROM r WHERE record_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1",
    "even_chunks": f"WITH {_A} SELECT assembly_idx, ntile(16) OVER (ORDER BY assembly_idx)::INT AS chunk FROM a",
    "weighted_modes": f"""WITH {_R}, w AS (SELECT assembly_idx, coalesce(record_id, '') AS record_id, sum(length(seq))::BIGINT AS letters FROM r WHERE seq IS NOT NULL GROUP BY ALL)
SELECT assembly_idx, record_id, letters FROM w QUALIFY row_number() OVER (PARTITION BY assembly_idx ORDER BY letters DESC, record_id) = 1""",
    "seed_hits": f"""WITH {_R}, q AS (SELECT DISTINCT sig_no::INT AS id, upper(seq) AS s FROM signatures WHERE seq IS NOT NULL),
     b AS (SELECT id, 1 AS strand, s FROM q UNION ALL SELECT id, -1, reverse(translate(s, 'ACGT', 'TGCA')) FROM q),
     x AS (SELECT id, strand, i AS at, s[i + 1:i + 31] AS k FROM (SELECT *, unnest(range(0, length(s) - 30)) AS i FROM b)),
     y AS (SELECT assembly_idx, record_no, i AS at, s[i + 1:i + 31] AS k FROM (SELECT assembly_idx, record_no, upper(seq) AS s, unnest(range(0, length(seq) - 30)) AS i FROM r))
SELECT id AS qseqid, strand, assembly_idx, record_no, floor((y.at - x.at) / {align.BAND}.0)::BIGINT AS band, count(*) AS n_seeds
FROM x JOIN y USING (k) WHERE regexp_full_match(k, '[ACGT]+') GROUP BY ALL""",
    "exact_alignments": f"""WITH {_R}, q AS (SELECT DISTINCT sig_no::INT AS id, upper(seq) AS s FROM signatures WHERE regexp_matches(seq, '[ACGT]{{23}}')),
     b AS (SELECT id, true AS fore, s FROM q UNION ALL SELECT id, false, reverse(translate(s, 'ACGT', 'TGCA')) FROM q),
     x AS (SELECT id, fore, s, s[1:23] AS k FROM b),
     y AS (SELECT assembly_idx, record_no, s, i, s[i + 1:i + 23] AS k FROM (SELECT assembly_idx, record_no, upper(seq) AS s, unnest(range(0, length(seq) - 22)) AS i FROM r))
SELECT DISTINCT id AS qseqid, assembly_idx, record_no, fore AS forward
FROM x JOIN y USING (k) WHERE y.s[i + 1:i + length(x.s)] = x.s""",
    "search_names": f"""WITH {_A}, {_R} SELECT assembly_idx || '@' || CASE WHEN is_target THEN 'y' ELSE 'n' END || '@' || coalesce(record_id, '') AS sseqid, count(*) AS n,
       sum(length(seq))::BIGINT AS letters FROM r JOIN a USING (assembly_idx) WHERE is_target IS NOT NULL GROUP BY 1""",
    "event_sessions": """WITH g AS (SELECT user_id, epoch_us(ts) AS us, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 3600000000)::INT, 0) AS gap FROM events),
     s AS (SELECT user_id, us, sum(gap) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING)::INT AS run FROM g)
SELECT user_id, run, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM s GROUP BY ALL""",
}
