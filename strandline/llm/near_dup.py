"""Groups of near-duplicate sequences (problem 1): a signature-coordinate inverted join.

Each distinct set of k-letter strings gets a signature of ``coords`` coordinates (the least value of as many hash
functions). Sets of likeness J agree in each coordinate with probability J. Sets are posted under the coordinate-value
pairs of the first ``coords - least + 1`` coordinates (the prefix: two signatures that agree in ``least`` coordinates agree
in one of these), and the other coordinates are skipped: they are compared only for pairs met in a posting list. Pairs with
``least`` agreements are held against the exact likeness.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import kernels as K
from strandline.operators.components import connected_components
from strandline.session import materialize, release, spread

_SIGNED = "id bigint, mark bigint, digest string, n_strings int, sig array<bigint>"


def string_sets(code: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """The distinct k-letter strings of every row as sorted codes, a string and its reverse complement being the same."""
    if len(code) < k:
        return [np.zeros(0, np.uint64)] * (len(off) - 1)
    _, end = K.runs(code, off)
    both = np.minimum(K.window_codes(code, k), K.window_codes_rc(code, k))
    p = np.flatnonzero(np.arange(len(code)) + k <= end)
    cut = np.searchsorted(p, off)
    return [np.unique(both[p[cut[i] : cut[i + 1]]]) for i in range(len(off) - 1)]


def _sets(col: pa.Array, k: int) -> Iterator[np.ndarray]:
    """As :func:`string_sets`, piece by piece; a row of several pieces is put together."""
    code, off = K.letters(col)
    parts: list[np.ndarray] = []
    now = 0
    for rows, c, o, _, first, last in K.pieces(code, off, k):
        if len(rows) > 1 or off[rows[0] + 1] - off[rows[0]] <= K.PIECE:
            if parts:
                yield np.unique(np.concatenate(parts))
                parts = []
            yield from string_sets(c, o, k)
            continue
        if parts and rows[0] != now:
            yield np.unique(np.concatenate(parts))
            parts = []
        now = rows[0]
        parts.append(string_sets(c, o, k)[0])
    if parts:
        yield np.unique(np.concatenate(parts))


def _sign(batches: Iterator[pa.RecordBatch], k: int, coords: int) -> Iterator[pa.RecordBatch]:
    # one scattering of the codes, then a multiply-add of 64 bits for each coordinate
    times, plus = K.mix(np.arange(1, coords + 1, dtype=np.uint64), 77) | np.uint64(1), K.mix(np.arange(1, coords + 1, dtype=np.uint64), 78)
    for b in batches:
        ids, marks, digests, sizes, sigs = [], [], [], [], []
        for i, mark, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), _sets(b.column(1), k), strict=True):
            if not len(s):
                continue
            low = np.full(coords, np.iinfo(np.uint64).max, np.uint64)
            for at in range(0, len(s), 4096):
                low = np.minimum(low, (K.mix(s[at : at + 4096])[:, None] * times + plus).min(axis=0))
            ids.append(i)
            marks.append(mark)
            digests.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
            sizes.append(len(s))
            sigs.append(low)
        if ids:
            flat = pa.array(K.signed(np.concatenate(sigs)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, coords, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(digests), pa.array(sizes, pa.int32()), lists], ["id", "mark", "digest", "n_strings", "sig"])


def near_duplicates(df: DataFrame, key: str, seq: str, threshold: float = 0.5, k: int = 15, coords: int = 32, least: int = 7, hot: int = 512) -> DataFrame:
    """``key, class_id, group_id`` for every distinct non-NULL key: the smallest keys of its class and of its group.

    Likeness is the number of distinct k-letter strings found in both sequences by those found in either; case is ignored,
    a string counts as its reverse complement, letters other than A C G T are in no string. A group is all records linked,
    directly or through others, by a likeness of ``threshold`` or more; records with equal sets are one class. NULL, empty
    or short sequences hold no string and stay alone. A repeated row counts once; of several sequences under one key each
    counts, and the key is in the smallest of their classes. Other columns are ignored.

    A pair of likeness exactly 0.5 is missed with probability 3e-4 by the defaults, a likelier pair far less.

    A posting list of more than ``hot`` classes is not paired off. Its members are linked to its smallest one, so a group
    of many versions of one text is found in a linear number of comparisons. Where this leaves several groups, the list is
    posted again under one more coordinate: two signatures that agree in ``least`` coordinates agree in a second one
    too, so unrelated records that share one value part, and no pair is lost. ``hot`` changes the work, never the result.
    """
    need = Fraction(str(threshold))
    temp: list[DataFrame] = []

    def cut(frame: DataFrame) -> DataFrame:
        temp.append(materialize(frame))
        return temp[-1]

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(seq), F.lit("")).alias("seq"))
    rows = rows.withColumn("mark", F.xxhash64("seq"))  # tells the texts of one key
    signed = cut(spread(rows).mapInArrow(partial(_sign, k=k, coords=coords), _SIGNED))
    named = signed.groupBy("digest").agg(F.min(F.struct("id", "mark")).alias("of"), F.first("sig").alias("sig"))
    for salt in range(64):  # numbers of classes, not of keys: a key of several texts may stand for several
        classes = cut(named.select("digest", "sig", "of.*", F.xxhash64("digest", F.lit(salt)).alias("rep")))
        if classes.groupBy("rep").count().where("count > 1").isEmpty():
            break
        release(classes)
    else:
        raise RuntimeError("classes could not be numbered")

    def linked(met: DataFrame) -> DataFrame:
        return _linked(met, classes, rows, k, need, least, cut)

    posted = coords - least + 1
    lists = cut(classes.select("rep", F.posexplode(F.slice("sig", 1, posted)).alias("c", "v")).select(F.xxhash64("c", "v").alias("p"), "c", "rep"))
    links = None
    for depth in range(1, least + 1):
        part = F.col("comp" if depth > 1 else "rep").alias("comp")
        sizes = lists.groupBy("p").agg(F.count("*").alias("n"), F.min("rep").alias("leader")).where("n > 1")
        large = cut(sizes.where(F.col("n") > hot).select("p", "leader"))
        small = lists.join(sizes.where(F.col("n") <= hot).select("p"), "p", "left_semi").select("p", "rep", part)
        met = small.toDF("p", "a", "ca").hint("merge").join(small.toDF("p", "b", "cb"), "p").where("a < b AND ca <> cb").select("a", "b")
        long = lists.join(large, "p").select("p", "leader", "rep", part)
        its = long.where("rep = leader").select("p", F.col("comp").alias("its"))
        star = long.join(its, "p").where("comp <> its").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b"))
        more = linked(met.union(star).distinct())
        links = more if links is None else links.union(more)
        if large.isEmpty():
            break
        comp = connected_components(links)
        temp.append(comp)
        member = lists.select("p", "c", "rep").join(large.select("p"), "p", "left_semi").join(comp, F.col("rep") == F.col("node"), "left")
        member = cut(member.select("p", "c", "rep", F.coalesce("component", "rep").alias("comp")))
        # lists of one group are done; in the others the largest group is met with the rest, never with itself
        parts = member.groupBy("p", "comp").agg(F.count("*").alias("n")).groupBy("p").agg(F.count("*").alias("parts"), F.max_by("comp", F.struct("n", "comp")).alias("main"))
        member = member.join(parts.where("parts > 1"), "p")
        if depth == least:  # whoever is left in a list agrees in as many coordinates as asked
            other, every = member.where("comp <> main").select("p", F.col("rep").alias("a"), F.col("comp").alias("ca")), member.select("p", F.col("rep").alias("b"), F.col("comp").alias("cb"), "main")
            rest = other.hint("merge").join(every, "p").where("ca <> cb AND (cb = main OR a < b)")
            links = links.union(linked(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
            break
        again = member.join(classes.select("rep", "sig"), "rep").select("p", "c", "rep", "comp", F.posexplode(F.slice("sig", 1, posted + depth)).alias("c2", "v"))
        lists = cut(again.where("c2 > c").select(F.xxhash64("p", "c2", "v").alias("p"), F.col("c2").alias("c"), "rep", "comp"))
    comp = connected_components(links)
    temp.append(comp)
    label = classes.join(comp, F.col("rep") == F.col("node"), "left").select("digest", F.col("id").alias("first"), F.coalesce("component", "rep").alias("part"))
    found = cut(signed.select("id", "digest").distinct().join(label, "digest").select("id", "first", "part"))
    found = cut(found.join(found.groupBy("part").agg(F.min("id").alias("g")), "part"))
    # a key with several sequences joins their groups
    per = cut(found.groupBy("id").agg(F.min("first").alias("first"), F.min("g").alias("g"), F.max("g").alias("g2")))
    if not per.where("g <> g2").isEmpty():
        more = connected_components(found.select("id", F.col("g").alias("c")), "id", "c")
        temp.append(more)
        per = per.join(more, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("component", "g").alias("g"))
    out = materialize(rows.select("id").distinct().join(per.select("id", "first", "g"), "id", "left"))
    release(*temp)
    return out.select(F.col("id").alias(key), F.coalesce("first", "id").alias("class_id"), F.coalesce("g", "id").alias("group_id"))


def _linked(met: DataFrame, classes: DataFrame, rows: DataFrame, k: int, need: Fraction, least: int, cut) -> DataFrame:
    """The met pairs (a < b) that agree in ``least`` coordinates and are as alike as needed."""
    sig_a, sig_b = classes.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), classes.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    near = cut(met.join(sig_a, "a").join(sig_b, "b").where(agree >= least).select("a", "b"))
    text = cut(_texts(near.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), classes, rows))
    both = near.join(text.select(F.col("rep").alias("b"), F.col("seq").alias("tb")), "b")
    both = both.join(text.select(F.col("rep").alias("a"), F.col("seq").alias("ta")), "a")  # last, so that a's pairs lie together
    return cut(both.select("a", "b", "ta", "tb").mapInArrow(partial(_exact, k=k, num=need.numerator, den=need.denominator), "a bigint, b bigint"))


def _texts(reps: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """``rep, seq``: the text that each class (rep) was numbered by; of repeated rows any will do."""
    of = classes.join(reps, "rep", "left_semi").select("rep", "id", "mark")
    return rows.join(of, ["id", "mark"]).groupBy("rep").agg(F.max("seq").alias("seq"))


def _exact(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        a = b.column(0).to_numpy()
        first = np.concatenate([[True], a[1:] != a[:-1]])
        firsts, ok = _sets(b.column(2).filter(pa.array(first)), k), []
        for new, y in zip(first, _sets(b.column(3), k), strict=True):
            if new:  # the strings of a text are cut once for all its pairs in a row
                x = next(firsts)
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both * den >= num * (len(x) + len(y) - both) and both > 0)
        yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def group_pairs(groups: DataFrame, key: str) -> DataFrame:
    """(record_a, record_b): all pairs of keys of the same group, smaller key first. Its size is the result's own."""
    a = groups.select(F.col("group_id").alias("g"), F.col(key).alias("record_a"))
    b = groups.select(F.col("group_id").alias("g"), F.col(key).alias("record_b"))
    return a.join(b, "g").where("record_a < record_b").select("record_a", "record_b")
