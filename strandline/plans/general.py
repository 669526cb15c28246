"""Queries of the general data-processing problems (4 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.lines import parse_lines
from strandline.operators.selection import keyed_quantiles, occurrence_report
from strandline.session import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return occurrence_report(table(spark, d, "kmers"), table(spark, d, "nodes")).where(~F.col("agrees")).select("hash")


def p4_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return occurrence_report(table(spark, d, "kmers"), table(spark, d, "nodes"))


def p4_position_quartiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "kmers").select("kmer_no", "hash", "pos").dropDuplicates(["kmer_no", "hash"])
    q = keyed_quantiles(rows, "hash", "pos", (0.25, 0.5, 0.75))
    return q.select("hash", "n", "lo", "hi", *[F.col("quantiles")[i].alias(f"q{i + 1}") for i in range(3)])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parse_lines(table(spark, d, "record_lines")).where(~F.col("ok")).select("line_no", "reason").distinct()


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    rows = parse_lines(table(spark, d, "record_lines")).where("ok").drop("ok", "reason")
    return rows.dropDuplicates()


QUERIES = {f.__name__: f for f in (p4_found, p4_occurrences, p4_position_quartiles, p5_found, p5_loaded)}

_OCC = """
WITH k AS (SELECT hash, count(DISTINCT kmer_no) n, min(kmer_no) lo, max(kmer_no) hi,
                  list_sort(list(DISTINCT kmer_no)) l FROM kmers WHERE kmer_no IS NOT NULL GROUP BY hash),
     s AS (SELECT hash, count(*) m, sum(stop - start) span FROM (SELECT DISTINCT * FROM nodes) GROUP BY hash),
     o AS (SELECT coalesce(k.hash, s.hash) AS hash, coalesce(n, 0)::BIGINT AS n_kmers, lo AS first_no,
                  l[greatest(1, ceil(n / 2.0))::INT] AS median_no, hi AS last_no, coalesce(m, 0)::BIGINT AS n_nodes,
                  coalesce(span, 0)::BIGINT AS n_stated
           FROM k FULL JOIN s ON k.hash IS NOT DISTINCT FROM s.hash)
"""
_LINES = r"""
WITH a AS (SELECT DISTINCT line_no, regexp_replace(line, '\r\z', '') AS l FROM record_lines WHERE line IS NOT NULL),
     b AS (SELECT * FROM a WHERE trim(l, e' \t\n\r\f') <> '' AND NOT starts_with(l, '#')),
     c AS (SELECT *, regexp_full_match(l, '(?s)(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*') AS quoted FROM b),
     d AS (SELECT *, CASE WHEN quoted THEN regexp_extract_all(l || ',', '(?s)([^",]*|"(?:[^"]|"")*"),', 1) END AS raw FROM c),
     e AS (SELECT *, list_transform(raw, lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) AS f
           FROM d),
     g AS (SELECT line_no, f, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 6 THEN 'columns'
             WHEN NOT regexp_full_match(f[1], '[0-9]+') OR NOT regexp_full_match(f[2], '[0-9]+')
               OR NOT regexp_full_match(f[5], '[0-9]+') OR NOT regexp_full_match(f[3], '[^\s]+')
               OR NOT regexp_full_match(f[6], '[ACGTURYKMSWBDHVNacgturykmswbdhvn]+')
               OR try_cast(f[5] AS HUGEINT) IS DISTINCT FROM length(f[6])::HUGEINT THEN 'values' END AS reason FROM e)
"""
ORACLES = {
    "p4_found": _OCC + "SELECT hash FROM o WHERE n_kmers <> n_stated",
    "p4_occurrences": _OCC + "SELECT *, n_kmers = n_stated AS agrees FROM o",
    "p4_position_quartiles": """
WITH k AS (SELECT hash, count(*) n, list_sort(list(pos::BIGINT)) l FROM (SELECT DISTINCT kmer_no, hash, pos FROM kmers)
           WHERE pos IS NOT NULL GROUP BY hash)
SELECT hash, n, l[1] AS lo, l[n] AS hi, l[ceil(n * 0.25)::INT] AS q1, l[ceil(n * 0.5)::INT] AS q2, l[ceil(n * 0.75)::INT] AS q3
FROM k""",
    "p5_found": _LINES + "SELECT line_no, reason FROM g WHERE reason IS NOT NULL",
    "p5_loaded": _LINES + """
SELECT line_no, try_cast(f[1] AS BIGINT) AS assembly_idx, try_cast(f[2] AS BIGINT) AS record_no, f[3] AS record_id,
       f[4] AS note, try_cast(f[5] AS BIGINT) AS length, f[6] AS seq FROM g WHERE reason IS NULL""",
}
