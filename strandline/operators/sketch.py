"""Sketches: minimizers (a portable SQL form and a rolling-hash kernel) and bottom-s MinHash."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.sequence import canonical, hash60
from strandline.operators import kernels as K
from strandline.session import spread

KMERS = "assembly_idx int, record_no int, hash bigint, pos bigint"
# Fixed values of the public rolling hash: the seeds of A, C, G, T and the multiplier and shift of the extended hash.
NT_SEEDS = (0x3C8BFBB395C60474, 0x3193C18562A02B4C, 0x20323ED082572324, 0x295549F54BE24456)
NT_MULTIPLIER, NT_SHIFT = 0x90B45D39FB6DA1FA, 27


def portable_kmers(records: DataFrame, k: int) -> DataFrame:
    """Every k-mer of A C G T: ``assembly_idx, record_no, pos, hash`` by :func:`hash60` of the canonical string.

    Records are partitioned before they are cut, so windows over a record's k-mers need no shuffle of the k-mers.
    """
    at = F.explode(F.sequence(F.lit(0), F.length("seq") - k))
    rows = records.where(F.length("seq") >= k).select("assembly_idx", "record_no", F.upper("seq").alias("seq"))
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, else small records are put into one
    rows = rows.repartition(parts, "assembly_idx", "record_no")
    kmer = rows.select("assembly_idx", "record_no", "seq", at.alias("pos")).select(
        "assembly_idx", "record_no", F.col("pos").cast("bigint").alias("pos"), F.expr(f"substring(seq, pos + 1, {k})").alias("kmer")
    )
    kmer = kmer.where(~F.col("kmer").rlike("[^ACGT]"))
    return kmer.select("assembly_idx", "record_no", "pos", hash60(canonical(F.col("kmer"))).alias("hash"))


def portable_minimizers(kmers: DataFrame, w: int) -> DataFrame:
    """The least hash of every w consecutive k-mers of a record, the last of equal ones; each position once."""
    by = Window.partitionBy("assembly_idx", "record_no").orderBy("pos")
    least = F.min(F.struct("hash", (-F.col("pos")).alias("neg"))).over(by.rowsBetween(1 - w, 0))
    picked = kmers.select("assembly_idx", "record_no", least.alias("m"), F.row_number().over(by).alias("rn")).where(F.col("rn") >= w)
    return picked.select("assembly_idx", "record_no", F.col("m.hash").alias("hash"), (-F.col("m.neg")).alias("pos")).distinct()


def minimizers(records: DataFrame, k: int = 21, w: int = 200) -> DataFrame:
    """Minimizer occurrences ``assembly_idx, record_no, hash, pos`` by the rolling hash, sketched inside the scan.

    Only about 2 in w + 1 positions leave the Python worker. Windows are counted in k-mers without other letters than
    A C G T, so such a letter does not end a window. The hash is strand-insensitive and stored so that signed order is the
    order of the unsigned value. Records with fewer than w k-mers have no minimizer.
    """
    rows = spread(records.select("assembly_idx", "record_no", F.coalesce("seq", F.lit("")).alias("seq")))
    return rows.mapInArrow(partial(_sketch, k=k, w=w), KMERS)


def nt_hashes(code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(selecting hash, identifying hash) of the k letters from each position; other letters give no meaning.

    A hash of a + b letters is put together from one of a and one of b, so k letters take about log k steps.
    """
    seeds = np.array([*NT_SEEDS, 0], np.uint64)
    fwd, rev, size = seeds[code], seeds[np.where(code < 4, 3 - code, 4)], 1
    out = None
    left = k
    while True:
        if left & 1:
            out = (fwd, rev, size) if out is None else _put(out, (fwd, rev, size))
        left >>= 1
        if not left:
            break
        fwd, rev, size = _put((fwd, rev, size), (fwd, rev, size))
    with np.errstate(over="ignore"):
        low = out[0] + out[1]
        high = low * np.uint64((1 ^ (k * NT_MULTIPLIER)) & 0xFFFFFFFFFFFFFFFF)
        high ^= high >> np.uint64(NT_SHIFT)
    return low, high


def _put(x: tuple, y: tuple) -> tuple:
    """Hashes of the letters of x followed by those of y."""
    (fx, rx, a), (fy, ry, b) = x, y
    fwd, rev = _turned(fx, b), rx.copy()
    fwd[: len(fwd) - a] ^= fy[a:]
    rev[: len(rev) - a] ^= _turned(ry[a:], a)
    return fwd, rev, a + b


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    """Rotate the upper 31 and the lower 33 bits apart."""
    a, b = by % 31, by % 33
    up, lo = x >> np.uint64(33), x & np.uint64((1 << 33) - 1)
    up = ((up << np.uint64(a)) | (up >> np.uint64(31 - a))) & np.uint64((1 << 31) - 1)
    lo = ((lo << np.uint64(b)) | (lo >> np.uint64(33 - b))) & np.uint64((1 << 33) - 1)
    return (up << np.uint64(33)) | lo


def row_minimizers(code: np.ndarray, off: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in it, hash as order-preserving BIGINT) of the minimizers of many rows at once."""
    none = np.zeros(0, np.int64)
    n = len(code)
    if n < k + w - 1:
        return none, none, none
    bad = np.concatenate([[0], np.cumsum(code > 3)])
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    i = np.arange(n - k + 1)
    at = np.flatnonzero((bad[k:] == bad[:-k]) & (i + k <= off[row[: n - k + 1] + 1]))
    if len(at) < w:
        return none, none, none
    low, high = nt_hashes(code, k)
    owner = row[at]
    best = K.window_argmin(low[at], w)[: len(at) - w + 1]
    p = at[np.unique(best[owner[: len(at) - w + 1] == owner[w - 1 :]])]
    return row[p], p - off[row[p]], K.signed(high[p] ^ np.uint64(1 << 63))


def record_minimizers(code: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of one record's minimizers."""
    return row_minimizers(code, np.array([0, len(code)]), k, w)[1:]


def _sketch(batches: Iterator[pa.RecordBatch], k: int, w: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        code, off = K.letters(b.column(2))
        at = 0
        while at < b.num_rows:  # whole rows, about a million letters at a time
            end = max(at + 1, int(np.searchsorted(off, off[at] + K.PIECE, "right")) - 1)
            row, pos, h = row_minimizers(code[off[at] : off[end]], off[at : end + 1] - off[at], k, w)
            src = pa.array(row + at)
            cols = [b.column(0).take(src).cast(pa.int32()), b.column(1).take(src).cast(pa.int32()), pa.array(h), pa.array(pos)]
            yield pa.RecordBatch.from_arrays(cols, ["assembly_idx", "record_no", "hash", "pos"])
            at = end


def bottom_sketch(hashes: DataFrame, key: str, value: str, s: int) -> DataFrame:
    """The s smallest distinct values of each key: ``key, value, rn``.

    ``rn <= s`` lets each task keep s rows of a key before the shuffle.
    """
    w = Window.partitionBy(key).orderBy(value)
    return hashes.select(key, value).distinct().withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= s)


def sketch_jaccard(sketch: DataFrame, key: str, value: str, s: int) -> DataFrame:
    """``a, b, jaccard`` for pairs of keys (a < b) that share a value of their sketches.

    Of the s smallest values of both sketches together, the share that is in both; pairs that are left out have 0. A shared
    value at rank i and j of the two sketches is the (i + j - shared so far)-th of both together, so no union is formed.
    """
    a = sketch.select(F.col(key).alias("a"), value, F.col("rn").alias("ra"))
    b = sketch.select(F.col(key).alias("b"), value, F.col("rn").alias("rb"))
    size = sketch.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"))
    met = a.join(b, value).where("a < b").groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("ra", "rb"))).alias("m"))  # at most s cells
    count = F.aggregate(
        "m", F.struct(F.lit(0).alias("c"), F.lit(0).alias("got")),
        lambda x, m: F.struct((x["c"] + 1).alias("c"), (x["got"] + (m["ra"] + m["rb"] - x["c"] - 1 <= s).cast("int")).alias("got")),
    )["got"]
    sized = met.join(size.select(F.col("k").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("k").alias("b"), F.col("n").alias("nb")), "b")
    both = F.least(F.lit(s), F.col("na") + F.col("nb") - F.size("m"))
    return sized.select("a", "b", (count / both).alias("jaccard"))


def mash_distance(jaccard, k: int):
    """Distance of a Jaccard estimate; 1 where nothing is shared."""
    return F.when(jaccard <= 0, 1.0).otherwise(F.least(F.lit(1.0), -F.log(2 * jaccard / (1 + jaccard)) / k))


def expected_fraction(pairs: DataFrame, left: DataFrame, right: DataFrame, same: bool) -> float:
    """Mean of 2j / (1 + j) over all (left, right) pairs of keys, pairs that are not listed counting 0.

    ``same`` takes one collection with itself, its diagonal included.
    """
    f = 2 * F.col("jaccard") / (1 + F.col("jaccard"))
    n, m = left.count(), right.count()
    if not n or not m:
        return 0.0
    x, y = left.toDF("x"), right.toDF("y")
    if same:
        r = pairs.join(x, F.col("a") == F.col("x")).join(y, F.col("b") == F.col("y")).agg(F.sum(f)).first()[0] or 0.0
        return (2 * r + n) / (n * m)
    both = pairs.select("a", "b", "jaccard").union(pairs.select("b", "a", "jaccard"))
    r = both.join(x, F.col("a") == F.col("x")).join(y, F.col("b") == F.col("y")).agg(F.sum(f)).first()[0] or 0.0
    return r / (n * m)
