"""Local alignment of short queries against records: seed k-mers by equi-join, then banded alignment of what they anchor.

Scores: match 1, mismatch -2, gap -2.5 a letter (in half points), as a nucleotide search of high similarity uses them. The
E-value takes lambda 1.28 and K 0.46. Hits are those of this method, not of any other program.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import revcomp
from strandline.operators import kernels as K
from strandline.session import spread

SEED, BAND, _BLOCK = 16, 16, 256
MATCH, MISMATCH, GAP, LAMBDA, KAPPA = 2, -4, -5, 1.28, 0.46
_HITS = (
    "qseqid int, assembly_idx int, record_no int, nident int, mismatch int, gaps int, qstart int, qend int, sstart int, send int,"
    " evalue double, bitscore double, sseq string"
)


def _seeds(batches: Iterator[pa.RecordBatch], k: int, step: int) -> Iterator[pa.RecordBatch]:
    """The k-letter codes at every ``step``-th position of every sequence."""
    for b in batches:
        code, off = K.letters(b.column(1))
        ids = np.arange(b.num_rows)
        for rows, c, o, shift, first, last in K.pieces(code, off, k):
            if len(c) < k:
                continue
            _, end = K.runs(c, o)
            i = np.arange(len(c))
            row = np.searchsorted(o, i, "right") - 1
            at = i - o[row] + shift
            p = np.flatnonzero((i + k <= end) & (i >= first) & (i < last) & (at % step == 0))
            src = pa.array(ids[rows[row[p]]])
            yield pa.RecordBatch.from_arrays([b.column(0).take(src), pa.array(K.signed(K.window_codes(c, k)[p])), pa.array(at[p])], ["id", "seed", "at"])


def seed_hits(queries: DataFrame, records: DataFrame, k: int = SEED, step: int | None = None) -> DataFrame:
    """``qseqid, strand, assembly_idx, record_no, band, n_seeds``: bands of diagonals of a record that share seeds with a query.

    Record seeds are taken at every ``step``-th letter, query seeds at every letter, on both strands. The join is on the
    seed; a seed that many records hold is split by adaptive execution.
    """
    step = step or max(1, k // 2)
    q = queries.select("qseqid", F.upper("seq").alias("seq"))
    both = q.withColumn("strand", F.lit(1)).union(q.select("qseqid", revcomp(F.col("seq")), F.lit(-1)))
    qs = spread(both.select(F.struct("qseqid", "strand").alias("id"), "seq")).mapInArrow(partial(_seeds, k=k, step=1), "id struct<qseqid:int,strand:int>, seed bigint, at bigint")
    rs = spread(records.where("seq IS NOT NULL").select(F.struct("assembly_idx", "record_no").alias("id"), "seq"))
    rs = rs.mapInArrow(partial(_seeds, k=k, step=step), "id struct<assembly_idx:int,record_no:int>, seed bigint, at bigint")
    a = qs.select(F.col("id").alias("q"), "seed", F.col("at").alias("qa"))
    b = rs.select(F.col("id").alias("r"), "seed", F.col("at").alias("ra"))
    band = F.expr(f"CAST(floor((ra - qa) / {BAND}) AS BIGINT)")
    met = a.join(b, "seed").select("q.qseqid", "q.strand", "r.assembly_idx", "r.record_no", band.alias("band"))
    return met.groupBy("qseqid", "strand", "assembly_idx", "record_no", "band").agg(F.count("*").alias("n_seeds"))


#: Letters of a seed and steps between those of a record, by the kind of search; shorter seeds find more diverged hits.
TASKS = {"blastn": (16, 8), "megablast": (28, 14), "blastn-short": (8, 2)}


def align(
    queries: DataFrame, records: DataFrame, max_evalue: float = 10.0, k: int | None = None, *, task: str = "blastn", columns: list[str] | None = None,
    max_hsps: int | None = 1000, max_targets: int | None = 50_000,
) -> DataFrame:
    """Hits of ``queries`` (qseqid, seq) in ``records`` (assembly_idx, record_no, record_id, seq): the best of each band.

    Positions count from 1, inclusive; a hit on the other strand has ``sstart > send`` as is usual. ``task`` is the kind of
    search (:data:`TASKS`), ``k`` another seed length, ``columns`` the columns wanted. As such searches do, it reports for a
    query at most ``max_targets`` records, those of the best hits, and of each at most ``max_hsps`` hits; None for all.
    Only the letters of a record that a band can reach leave its join.
    """
    if task not in TASKS:
        raise ValueError(f"task is one of {', '.join(TASKS)}")
    k, step = (k, None) if k else TASKS[task]
    seeds = seed_hits(queries, records, k, step)
    q = queries.select("qseqid", F.upper("seq").alias("q"))
    r = records.select("assembly_idx", "record_no", F.upper("seq").alias("s"))
    space = records.agg(F.sum(F.length("seq"))).first()[0] or 0
    first = (F.col("band") - 1) * BAND  # the lowest diagonal looked at
    cut = F.greatest(first, F.lit(0)).cast("int")
    both = seeds.join(q, "qseqid").join(r, ["assembly_idx", "record_no"]).select(
        "qseqid", "assembly_idx", "record_no", "strand", "q", cut.alias("cut"), (first - cut).cast("int").alias("first"),
        F.substring(F.col("s"), cut + 1, F.greatest(first + 3 * BAND + F.length("q") - cut, F.lit(0)).cast("int")).alias("s"),
    )
    hits = both.mapInArrow(partial(_align, space=int(space)), _HITS).where(F.col("evalue") <= max_evalue).distinct()
    hits = _capped(hits, max_hsps, max_targets)
    return hits.select(columns) if columns else hits


def _capped(hits: DataFrame, max_hsps: int | None, max_targets: int | None) -> DataFrame:
    at = ["qseqid", "assembly_idx", "record_no"]
    if max_hsps:
        w = Window.partitionBy(*at).orderBy(F.desc("bitscore"), "sstart", "qstart", "send", "qend")
        hits = hits.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max_hsps).drop("rn")
    if max_targets:
        best = hits.groupBy(*at).agg(F.max("bitscore").alias("best"))
        many = best.groupBy("qseqid").count().where(F.col("count") > max_targets).select("qseqid")
        w = Window.partitionBy("qseqid").orderBy(F.desc("best"), "assembly_idx", "record_no")
        over = best.join(many, "qseqid", "left_semi").withColumn("rn", F.row_number().over(w)).where(F.col("rn") > max_targets)
        hits = hits.join(over.select(*at), at, "left_anti")
    return hits


def _align(batches: Iterator[pa.RecordBatch], space: int) -> Iterator[pa.RecordBatch]:
    swap = str.maketrans("ACGT", "TGCA")
    for b in batches:
        rows = sorted(b.to_pylist(), key=lambda r: len(r["q"]))  # queries of like length share a block
        for at in range(0, len(rows), _BLOCK):
            part = rows[at : at + _BLOCK]
            qs = [r["q"] if r["strand"] > 0 else r["q"][::-1].translate(swap) for r in part]
            first = np.array([r["first"] for r in part])
            out = []
            for row, hit in zip(part, local_alignments(qs, [r["s"] for r in part], first, 3 * BAND), strict=True):
                score, ident, mis, gaps, q0, q1, s0, s1 = hit
                if score <= 0:
                    continue
                bits = (LAMBDA * score / 2 - math.log(KAPPA)) / math.log(2)
                n = len(row["q"])
                ev = n * max(space, 1) * 2.0**-bits
                if row["strand"] < 0:
                    q0, q1, start, end = n - q1, n - q0, s1, s0 + 1
                else:
                    start, end = s0 + 1, s1
                start, end = start + row["cut"], end + row["cut"]
                out.append((row["qseqid"], row["assembly_idx"], row["record_no"], ident, mis, gaps, q0 + 1, q1, start, end, ev, bits, row["s"][s0:s1]))
            if out:
                kinds = [pa.int32()] * 10 + [pa.float64(), pa.float64(), pa.string()]
                names = [c.split()[0] for c in _HITS.split(",")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def local_alignments(qs: list[str], ss: list[str], first: np.ndarray, width: int) -> list[tuple[int, ...]]:
    """Best local alignment of each pair: (score, identities, mismatches, gaps, q0, q1, s0, s1), positions from 0, half-open.

    The place in ``s`` minus the place in ``q`` stays within ``width`` diagonals from ``first``. All pairs are computed at
    once: a step takes one letter of every query and all its diagonals, a trace step moves every pair.
    """
    b, n = len(qs), max(map(len, qs), default=0)
    m = max(map(len, ss), default=0)
    q, s = np.zeros((b, n + 1), np.uint8), np.full((b, m + 1), 1, np.uint8)  # paddings match nothing
    for i, (x, y) in enumerate(zip(qs, ss, strict=True)):
        q[i, : len(x)] = np.frombuffer(x.encode(), np.uint8)
        s[i, : len(y)] = np.frombuffer(y.encode(), np.uint8)
    size = np.array([len(y) for y in ss])[:, None]
    q_size = np.array([len(x) for x in qs])
    score = np.zeros((n + 1, b, width + 2), np.int32)
    cells, steps = np.arange(width), np.arange(width) * GAP
    for i in range(1, n + 1):
        j = i + first[:, None] + cells  # letters of s used up to the cell
        ok = (j >= 1) & (j <= size) & (i <= q_size)[:, None]
        letter = np.take_along_axis(s, np.clip(j - 1, 0, m), axis=1)
        diag = score[i - 1, :, 1:-1] + np.where(letter == q[:, i - 1 : i], MATCH, MISMATCH)
        cell = np.where(ok, np.maximum(np.maximum(diag, score[i - 1, :, 2:] + GAP), 0), 0)
        score[i, :, 1:-1] = np.where(ok, np.maximum(cell, np.maximum.accumulate(cell - steps, axis=1) + steps), 0)
    flat = score.transpose(1, 0, 2).reshape(b, -1)
    top = flat.argmax(axis=1) if flat.shape[1] else np.zeros(b, np.int64)
    best = flat[np.arange(b), top]
    i, c = top // (width + 2), top % (width + 2)
    q1, s1 = i.copy(), i + first + c - 1
    ident, mis, gaps = (np.zeros(b, np.int64) for _ in range(3))
    who = np.arange(b)
    while True:
        live = np.flatnonzero(score[i, who, c] > 0)
        if not len(live):
            break
        x, y = i[live], c[live]
        same = q[live, x - 1] == s[live, x + first[live] + y - 2]
        here = score[x, live, y]
        diag = here == score[x - 1, live, y] + np.where(same, MATCH, MISMATCH)
        up = ~diag & (here == score[x - 1, live, y + 1] + GAP)
        ident[live] += diag & same
        mis[live] += diag & ~same
        gaps[live] += ~diag
        i[live] -= diag | up
        c[live] += up.astype(int) - (~diag & ~up)
    found = zip(best, ident, mis, gaps, i, q1, i + first + c - 1, s1, strict=True)
    return [tuple(map(int, r)) for r in found]
