"""Long exact spans shared between records (problem 3), by hashing units and grouping their digests.

A sequence has no lines or paragraphs, so its units are content-defined: of every ``min_len`` letters in a row the unit
of ``k`` letters with the least digest. Two records that share ``min_len`` letters share the unit found there. A unit
carries the letters around it that such a span may reach, so records are matched inside the groups of equal digests and
whole sequences are shuffled nowhere.

Records of equal sequence are one class, named by its earliest key, and only that one is cut into units; copies are put
back at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import kernels as K
from strandline.session import materialize, release, spread

_UNITS = "h bigint, id bigint, mark bigint, pos bigint, own int, reach int, back bigint, around binary"
_FEW = 500_000  # rows of three numbers that are broadcast
_BUCKET = 50_000  # units that one call of Python takes, whole digest groups
#: Digest groups of more units are not gathered: their windows are grouped by joins.
HOT = 20_000


def unit_letters(min_len: int) -> int:
    return min(32, max(4, min_len * 2 // 5))


class Collection:
    """The sequences of a table as classes: ``members`` (id, owner, rep, mark; only sequences that hold a span) and ``units``.

    ``rep`` is the least key of a class, ``mark`` tells the classes of a key with several texts (0 for any other); with
    ``one`` such a key keeps one of its texts. Case is ignored; letters other than A C G T belong to no span. NULL, empty
    and short sequences have no unit; rows with a NULL key are left out; repeated rows count once.
    """

    def __init__(self, df: DataFrame, key: str, seq: str, min_len: int, owner: str | None = None, one: bool = False):
        k = unit_letters(min_len)
        rows = df.where(F.col(key).isNotNull()).select(
            F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(owner or key).cast("bigint"), F.lit(-(2**63))).alias("owner"), F.upper(F.coalesce(F.col(seq), F.lit(""))).alias("seq")
        )
        rows = rows.where(F.col("seq").rlike(f"[ACGT]{{{min_len}}}")).withColumn("text", F.xxhash64("seq"))
        held = rows.select("id", "owner", "text", F.xxhash64(F.lit(1), "seq").alias("text2")).distinct()
        many = held.groupBy("id").agg(F.min("text").alias("only"), F.max("text").alias("other")).where("only <> other").drop("other")
        if one:
            held = held.join(many, "id", "left").where("only IS NULL OR text = only").drop("only")
        rep = held.groupBy("text", "text2").agg(F.min("id").alias("rep"), (F.min("id") != F.max("id")).alias("copied"))
        rep = rep.join(many.withColumnRenamed("id", "rep"), "rep", "left").withColumn("mark", F.when(F.col("only").isNull(), F.lit(0)).otherwise(F.col("text")).cast("bigint"))
        self.members = materialize(held.join(rep, ["text", "text2"]).select("id", "owner", "rep", "mark", "copied", "text"))
        # the first of each class is cut; only where there are copies or several texts have rows to be told anything
        told = self.members.where("copied OR mark <> 0").select("id", "text", "mark", "copied", (F.col("id") == F.col("rep")).alias("first")).distinct()
        if one:
            told = told.union(rows.join(many, "id").where("text <> only").select("id", "text", F.lit(0), F.lit(False), F.lit(False)).distinct())
        told = materialize(told)
        few = F.broadcast(told) if told.count() <= _FEW else told  # few: some tens of MB, and sequences stay where they are read
        kept = spread(rows.select("id", "text", "seq")).join(few, ["id", "text"], "left").where("coalesce(first, true)")
        kept = kept.select("id", F.coalesce("mark", F.lit(0)).cast("bigint").alias("mark"), F.coalesce("copied", F.lit(False)).alias("copied"), "seq")
        self.units = kept.mapInArrow(partial(_units, k=k, w=min_len - k + 1), _UNITS)


def _units(batches: Iterator[pa.RecordBatch], k: int, w: int) -> Iterator[pa.RecordBatch]:
    ctx = w - 1
    for b in batches:
        code, off = K.letters(b.column(3))
        ids, marks, copied = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
        for rows, c, o, shift, first, last in K.pieces(code, off, ctx + w + k):
            p, s0, n, begin, end, h = K.minimizers(c, o, k, w, first, last)
            if not len(p):
                continue
            row = np.searchsorted(o, p, "right") - 1
            left, right = np.minimum(p - begin, ctx), np.minimum(end - (p + k), ctx)
            padded = np.concatenate([np.zeros(ctx, np.uint8), c & 3, np.zeros(ctx + k, np.uint8)])
            around = np.concatenate(
                [_packed(padded, p[:, None] + (ctx - 1 - np.arange(ctx))), _packed(padded, p[:, None] + (ctx + k + np.arange(ctx)))], axis=1
            )
            # the letters from the unit before to the end of this one, where two or three codes cover them
            gap = np.diff(p, prepend=p[:1])
            before = p - gap
            near = (gap > 0) & (gap <= 2 * k) & (before >= begin)
            back = K.mix(h[before] ^ K.mix(h[np.maximum(before, p - k)] + gap.astype(np.uint64), 3), 4) | np.uint64(1)
            src = rows[row]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(K.signed(h[p])), pa.array(ids[src]), pa.array(marks[src]), pa.array(p - o[row] + shift, pa.int64()),
                    # letters left of the unit in its windows, most and fewest, and whether the sequence has copies
                    pa.array((((p - s0) * 1024 + (p - s0 - n + 1)) * 2 + copied[src]).astype(np.int32)),
                    pa.array((left * 65536 + right).astype(np.int32)), pa.array(K.signed(np.where(near, back, np.uint64(0)))), K.binary_column(around),
                ],
                [c.split()[0] for c in _UNITS.split(", ")],
            )


def _packed(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    x = code[at]
    if x.shape[1] % 4:
        x = np.concatenate([x, np.zeros((len(x), 4 - x.shape[1] % 4), np.uint8)], axis=1)
    return (x[:, 0::4] << 6) | (x[:, 1::4] << 4) | (x[:, 2::4] << 2) | x[:, 3::4]


def _unpacked(col: pa.Array, ctx: int) -> tuple[np.ndarray, np.ndarray]:
    """Letters to the left (nearest first) and to the right."""
    half = (ctx + 3) // 4
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset :]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[0] + len(col) * 2 * half].reshape(len(col), 2 * half)
    x = np.stack([(raw >> s) & 3 for s in (6, 4, 2, 0)], axis=2).reshape(len(col), -1)
    return x[:, :ctx], x[:, half * 4 : half * 4 + ctx]


def _alike(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many leading letters agree, at most ``most``."""
    differ = a != b
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(n, most)


def sharing_pairs(left: Collection, right: Collection, min_len: int) -> DataFrame:
    """(a, b): distinct keys of two collections whose sequences share ``min_len`` letters; of one collection a < b.

    Between two collections a pair is left out where b is the owner of a. Two classes meet in the digest group of the
    earliest unit of each stretch they share, not again at the units after it. A sort-merge join, so a unit that a third
    of all classes hold is split by adaptive execution and nothing is gathered; keys of equal sequences are paired last.
    """
    # both sides keep the same columns under the same names, so that a collection is shuffled once however often it is met
    cols = ["h", "id", "mark", "reach", "back", "around"]
    x, y = left.units.select(cols).alias("x"), right.units.select(cols).alias("y")
    keep = (F.col("x.back") == 0) | (F.col("x.back") != F.col("y.back"))
    if left is right:
        keep &= (F.col("x.id") < F.col("y.id")) | ((F.col("x.id") == F.col("y.id")) & (F.col("x.mark") < F.col("y.mark")))
    met = x.hint("merge").join(y, (F.col("x.h") == F.col("y.h")) & keep)
    named = [F.col(f"{side}.{c}").alias(f"{side}_{c}") for c in ("id", "mark", "reach", "around") for side in "xy"]
    met = met.select(named).mapInArrow(partial(_verify, ctx=min_len - unit_letters(min_len)), "a bigint, b bigint, am bigint, bm bigint").distinct()
    of_a = left.members.select(F.col("rep").alias("a"), F.col("mark").alias("am"), F.col("id").alias("ka"), "owner")
    of_b = right.members.select(F.col("rep").alias("b"), F.col("mark").alias("bm"), F.col("id").alias("kb"))
    pairs = met.join(of_a, ["a", "am"]).join(of_b, ["b", "bm"])
    if left is not right:
        return pairs.where("owner <> kb").select(F.col("ka").alias("a"), F.col("kb").alias("b")).distinct()
    copies = right.members.where("copied").select(F.col("rep").alias("a"), F.col("mark").alias("am"), F.col("id").alias("kb"))
    equal = of_a.join(copies, ["a", "am"]).select("ka", "kb")
    every = pairs.select("ka", "kb").where("ka <> kb").union(equal.where("ka < kb"))
    return every.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def _verify(batches: Iterator[pa.RecordBatch], ctx: int) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "am", "bm"]
    for b in batches:
        if not b.num_rows:
            continue
        reach = [b.column(i).to_numpy() for i in (4, 5)]
        (la, ra), (lb, rb) = _unpacked(b.column(6), ctx), _unpacked(b.column(7), ctx)
        left = _alike(la, lb, np.minimum(*(x >> 16 for x in reach)))
        right = _alike(ra, rb, np.minimum(*(x & 65535 for x in reach)))
        ok = pa.array(left + right >= ctx)
        # the same pair meets at every unit of a shared span: copies in a batch go before the shuffle
        t = pa.Table.from_batches([b.select([0, 1, 2, 3]).filter(ok).rename_columns(names)]).group_by(names).aggregate([])
        yield from t.combine_chunks().to_batches()


def shared_spans(df: DataFrame, key: str, seq: str, min_len: int) -> DataFrame:
    """``key, start, stop, kept``: the maximal stretches of a record whose every ``min_len`` letters occur in another record.

    ``kept`` marks what stays when shared text is kept once: stretches of which every window has its earliest occurrence
    (lowest key, then position) here; stretches are cut where this changes. Offsets count letters of the original
    sequence, from 0, half-open. Linear in the input: every window of ``min_len`` letters is looked at in the digest group
    of its own unit, which is the same wherever it occurs; no pair is formed. Repeated rows count once, one text of a key
    with several; records that share nothing give no row.
    """
    k = unit_letters(min_len)
    ctx = min_len - k
    if ctx > 1023:
        raise ValueError("spans of over 1055 letters are not looked for")
    c = Collection(df, key, seq, min_len, one=True)
    u = materialize(c.units.select("h", "id", "pos", "own", "around"))
    hot = materialize(u.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("h"))
    buckets = u.count() // _BUCKET + 1
    few = u.join(hot, "h", "left_anti") if not hot.isEmpty() else u

    def whole(t: pa.Table) -> pa.Table:
        return _in_groups(t, ctx)

    found = few.groupBy(F.pmod("h", F.lit(buckets)).alias("at")).applyInArrow(whole, _STRETCHES)
    if few is not u:
        win = u.join(hot, "h", "left_semi").mapInArrow(partial(_windows, ctx=ctx), _WINDOWS)
        first = win.groupBy("d1", "d2").agg(F.min(F.struct("id", "start")).alias("f"), ((F.min("id") != F.max("id")) | F.bool_or("copied")).alias("shared")).where("shared")
        one = win.join(first, ["d1", "d2"]).select("id", "start", (F.col("start") + 1).alias("stop"), ((F.col("id") == F.col("f.id")) & (F.col("start") == F.col("f.start"))).alias("kept"), "copied")
        found = found.union(one)
    found = materialize(found)
    out = _merged(found, ["id", "kept"])
    # a copy shares all that its first record has, and keeps nothing
    copies = c.members.where("id <> rep").select("rep", F.col("id").alias("copy"))
    of = _merged(found.where("copied"), ["id"]).join(copies, F.col("id") == F.col("rep")).select(F.col("copy").alias("id"), F.lit(False).alias("kept"), "start", "stop")
    release(u, hot)
    return out.union(of.select(out.columns)).select(F.col("id").alias(key), "start", (F.col("stop") + (min_len - 1)).alias("stop"), "kept")


_STRETCHES = "id bigint, start bigint, stop bigint, kept boolean, copied boolean"
_WINDOWS = "d1 bigint, d2 bigint, id bigint, start bigint, copied boolean"


def _merged(stretches: DataFrame, by: list[str]) -> DataFrame:
    """Stretches (start, stop) of a record that touch, and agree in the rest of ``by``, as one."""
    w = Window.partitionBy("id").orderBy("start")
    new = F.col("start") != F.lag("stop").over(w)
    for c in by[1:]:
        new = new | (F.col(c) != F.lag(c).over(w))
    runs = stretches.distinct().withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def _digests(h: np.ndarray, own: np.ndarray, around: pa.Array, ctx: int) -> tuple[np.ndarray, ...]:
    """(two digests, row, letters left of the unit) of every window of the units' own."""
    left, right = _unpacked(around, ctx)
    most, least = own >> 11, (own >> 1) & 1023
    unit = h.view(np.uint64)
    rights = [[np.zeros(len(h), np.uint64)] for _ in range(2)]
    for s in range(2):
        for j in range(ctx):
            rights[s].append(K.mix(rights[s][-1] ^ (right[:, j].astype(np.uint64) + np.uint64(1)), s))
    acc, out = [np.zeros(len(h), np.uint64) for _ in range(2)], []
    for n in range(ctx + 1):  # n letters to the left, ctx - n to the right
        if n:
            acc = [K.mix(acc[s] ^ (left[:, n - 1].astype(np.uint64) + np.uint64(7)), s + 2) for s in range(2)]
        ok = np.flatnonzero((n >= least) & (n <= most))
        if len(ok):
            # the letters are told apart by unit, offset of the unit and both sides
            d = [K.mix(unit[ok] ^ K.mix(acc[s][ok] + np.uint64(n), 5 + s) ^ (rights[s][ctx - n][ok] << np.uint64(1)), 9 + s) for s in range(2)]
            out.append((d[0], d[1], ok, np.full(len(ok), n, np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _in_groups(t: pa.Table, ctx: int) -> pa.Table:
    """The shared stretches of window starts in whole digest groups."""
    t = t.combine_chunks()
    h = t["h"].to_numpy()
    _, group, size = np.unique(h, return_inverse=True, return_counts=True)
    own = t["own"].to_numpy()
    t = t.filter(pa.array((size[group] > 1) | (own % 2 == 1)))  # what no other unit can hold is shared by copies alone
    none = pa.table({"id": pa.array([], pa.int64()), "start": pa.array([], pa.int64()), "stop": pa.array([], pa.int64()), "kept": pa.array([], pa.bool_()), "copied": pa.array([], pa.bool_())})
    if not t.num_rows:
        return none
    ids, pos, own = (t[c].to_numpy() for c in ("id", "pos", "own"))
    d1, d2, row, n = _digests(t["h"].to_numpy(), own, t["around"], ctx)
    start, key, copied = pos[row] - n, ids[row], own[row] % 2 == 1
    by = np.lexsort([start, key, d2, d1])
    d1, d2, start, key, copied = (x[by] for x in (d1, d2, start, key, copied))
    fresh = np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])])
    at = np.flatnonzero(fresh)
    which = np.cumsum(fresh) - 1
    last = np.append(at[1:], len(d1)) - 1
    shared = ((key[at] != key[last]) | np.logical_or.reduceat(copied, at))[which]
    kept = (key == key[at][which]) & (start == start[at][which])
    key, start, kept, copied = (x[shared] for x in (key, start, kept, copied))
    if not len(key):
        return none
    by = np.lexsort([start, key])
    key, start, kept, copied = (x[by] for x in (key, start, kept, copied))
    again = (key[1:] == key[:-1]) & (start[1:] == start[:-1])  # a row that came twice
    one = np.concatenate([[True], ~again])
    key, start, kept, copied = (x[one] for x in (key, start, kept, copied))
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1) | (kept[1:] != kept[:-1])]))
    end = np.append(new[1:], len(key)) - 1
    return pa.table({"id": key[new], "start": start[new], "stop": start[end] + 1, "kept": kept[new], "copied": copied[new]})


def _windows(batches: Iterator[pa.RecordBatch], ctx: int) -> Iterator[pa.RecordBatch]:
    """Digests (128 bits) of the windows of units, for groups too large to gather."""
    for b in batches:
        if b.num_rows:
            h, ids, pos, own = (b.column(i).to_numpy() for i in range(4))
            d1, d2, row, n = _digests(h, own, b.column(4), ctx)
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(d1)), pa.array(K.signed(d2)), pa.array(ids[row]), pa.array(pos[row] - n), pa.array(own[row] % 2 == 1)], ["d1", "d2", "id", "start", "copied"])


def coverage(df: DataFrame, spans: DataFrame, key: str, seq: str) -> DataFrame:
    """``key, n_letters, n_shared, n_removed`` for every distinct key: letters in all, inside shared stretches, and inside
    stretches whose earliest occurrence is elsewhere. NULL sequences have 0 letters; NULL keys are left out."""
    w = Window.partitionBy(key).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("stop").over(w), F.lit(0))
    gain = lambda: F.greatest(F.col("stop") - F.greatest(F.col("start"), F.col("__before")), F.lit(0))
    whole = spans.withColumn("__before", before).groupBy(key).agg(F.sum(gain()).alias("n_shared"))
    gone = spans.where("NOT kept").withColumn("__before", before).groupBy(key).agg(F.sum(gain()).alias("n_removed"))
    size = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("bigint").alias(key)).agg(F.max(F.coalesce(F.length(seq), F.lit(0))).cast("bigint").alias("n_letters"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return size.join(whole, key, "left").join(gone, key, "left").select(key, "n_letters", zero("n_shared"), zero("n_removed"))
