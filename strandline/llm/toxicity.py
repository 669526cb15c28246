"""Abusive, hateful or sexual content (problem 9): compression distance to two trained zstandard dictionaries.

A document is cut into windows of a few words, spelling tricks undone. One dictionary is trained on windows of toxic text,
one on windows of ordinary text; a window counts as toxic by how many bytes the toxic dictionary saves over the ordinary
one. A document scores as its most toxic window.

Labels tell which documents are toxic, with errors, but not where. So the training windows are found first: phrases that
occur nearly only in documents marked toxic are counted over all labelled documents, and the windows made of such phrases
are the toxic ones. The threshold is set on labelled documents by dictionaries that did not see them.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.notebooks import plain_text
from strandline.session import materialize, release, spread

# Digits and signs that stand for letters, and letters of other scripts that look like Latin ones.
LEET = str.maketrans("01345789@$!+", "oieastbgasit")
LOOKALIKES = str.maketrans("асеорхуіјѕԁһкмтвнгԛѡαοερνικτυχ", "aceopxyijsdhkmtbhrqwaoepviktux")
# Scripts written without spaces, each letter of which is taken as a word; marks over and under letters that
# are spelling only (Latin, Greek and Cyrillic accents, Hebrew points, Arabic vowel signs).
_UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\U00020000-\U0003ffff])")
_MARKS = re.compile("[\u0300-\u036f\u0591-\u05c7\u064b-\u0652]")

_BLOB = re.compile(r"[a-z0-9+/=]{60,}")
_CUT = re.compile(r"[\n\"\[\](){}<>=|;:\u3001\u3002\uff0c\uff01\uff1f]+|[.!?…\u061f\u0964]+\s+|'(?=\W)|(?<=\W)'")
_GAP = re.compile(r"[^a-z0-9@$!*+]+")
_WIDE_GAP = regex.compile(r"[^\p{L}\p{M}\p{N}@$!*+]+")
_DOUBLE = re.compile(r"(.)\1+")
_SPELLED = re.compile(r"(?<![a-z0-9])[a-z](?:[-._][a-z](?![a-z0-9])){2,}")
_NUMBERED = re.compile(r"^([^\W\d_]+)[0-9]+$")
_LETTER = re.compile(r"[^\W\d_]")
_LATIN = re.compile(r"[a-z]")
_LONG = 24  # letters of a word; longer ones are cut


@dataclass(frozen=True)
class Settings:
    """Bounds and sizes; none of them depends on the data. The bounds are on rows to fit on; every document is scored."""

    words: int = 14  #: a window's most words; longer units are cut into windows that overlap by half
    labelled: int = 50_000  #: most labelled documents fitted on, by a hash of the key
    unlabelled: int = 20_000  #: most other documents in which a first fit looks for further training windows
    purity: float = 0.6  #: share of a telling phrase's labelled documents that are marked toxic
    share: float = 0.25  #: share of a toxic training window's phrases that are telling; ordinary ones have under a third of it
    strength: float = 1.75  #: evidence of a toxic training window, in telling phrases of the least number of documents
    near: float = 0.97  #: thresholds that tell held-out documents apart as well as this share of the best are as good
    toxic_windows: int = 6_000  #: most toxic training windows of each fold
    plain_windows: int = 30_000  #: most ordinary training windows of each fold
    dictionary: int = 110_000  #: bytes of a dictionary
    level: int = 9

    def least_docs(self, n: int) -> int:
        """Toxic documents that a telling phrase occurs in: of more labels, more agree by chance."""
        return max(2, round(math.log10(max(n, 1)) - 1))

    def evidence(self, n: int, toxic: float) -> float:
        """Summed log-likelihood ratio of a toxic training window's telling phrases, ``toxic`` being the share so marked."""
        return self.strength * self.least_docs(n) * math.log(1 / toxic)


def _folded(text: str) -> str:
    if text.isascii():
        text = text.lower()
    else:
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
        text = unicodedata.normalize("NFC", "".join(c for c in text if unicodedata.category(c) != "Cf")).lower()
    return _BLOB.sub(" ", text)


def _joined(m: re.Match) -> str:
    return re.sub("[-._]", "", m[0])


def _disguised(unit: str) -> str:
    """Look-alike letters read as Latin ones: in words that mix them, and beside Latin words in words made of them alone."""
    out, latin = [], bool(_LATIN.search(unit))
    for w in unit.split(" "):
        seen = w.translate(LOOKALIKES)
        plain = all(c.isascii() for c in seen if c.isalpha())
        out.append(seen if latin and plain else w)
    return " ".join(out)


def _respelled(unit: str) -> str:
    """Words of a unit: single letters joined, letter signs read as letters, repeated letters once, numbers gone, words of
    over 24 letters cut."""
    gap = _GAP
    if not unit.isascii():
        gap = _WIDE_GAP
        unit = _UNSPACED.sub(r" \1 ", _disguised(gap.sub(" ", unit)))
    out: list[str] = []
    single: list[str] = []
    for w in gap.split(_SPELLED.sub(_joined, unit)):
        if len(w) == 1 and w.isalpha() and w.isascii():
            single.append(w)
            continue
        if single:
            out += ["".join(single)] if len(single) > 2 else single
            single = []
        if not w:
            continue
        if not w.isalpha():
            w = _NUMBERED.sub(r"\1", w.strip("!+"))
            if not _LETTER.search(w):
                continue
            if not w.isalpha():
                w = w.translate(LEET)
        if len(w) > _LONG:
            out += [w[i : i + _LONG] for i in range(0, len(w), _LONG)]
            continue
        out.append(w)
    if single:
        out += ["".join(single)] if len(single) > 2 else single
    return _DOUBLE.sub(r"\1", " ".join(out))


def windows(text: str | None, layout: str | None, words: int = 14) -> list[str]:
    """The distinct windows of a text: its units between line ends, sentence ends, quotes and brackets.

    A unit that has a letter of any script is in a window, however short it is.
    """
    found: dict[str, None] = {}
    for s in _CUT.split(_folded(plain_text(text, layout))):
        if not s or not _LETTER.search(s):
            continue
        u = _respelled(s)
        if not u:
            continue
        w = u.split(" ")
        if len(w) <= words:
            found[u] = None
        else:
            half = words // 2
            for i in range(0, len(w) - half, half):
                found[" ".join(w[i : i + words])] = None
    return list(found)


def _phrases(window: str) -> set[str]:
    w = window.split(" ")
    return set(w) | {" ".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)}


class Distance:
    """Bytes that the toxic dictionary saves on a window, by the root of the window's length."""

    def __init__(self, toxic: bytes, plain: bytes, level: int):
        self._toxic, self._plain = (self._compressor(x, level) for x in (toxic, plain))
        self._known: dict[str, float] = {}

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        d = zstandard.ZstdCompressionDict(content, dict_type=kind)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)

    def of(self, window: str) -> float:
        s = self._known.get(window)
        if s is None:
            b = window.encode()
            s = (len(self._plain.compress(b)) - len(self._toxic.compress(b))) / math.sqrt(len(b))
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[window] = s
        return s


def train(samples: list[str], size: int, level: int) -> bytes:
    """A zstandard dictionary; of too few samples to train on, their text itself is one."""
    raw = [s.encode() for s in samples]
    if sum(map(len, raw)) > 2 * size:
        try:
            return zstandard.train_dictionary(size, raw, level=level).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"\n".join(raw)[-size:] or b"\n"


@dataclass(frozen=True)
class Model:
    toxic: bytes
    plain: bytes
    threshold: float
    level: int


def fit(docs: DataFrame, key: str, text: str, layout: str | None, labels: DataFrame, label: str, s: Settings = Settings()) -> Model | None:
    """Dictionaries and threshold from documents marked 0 or 1 in ``label``, by majority of their distinct marks.

    Fitted on a bounded sample, taken by hashes: at most about ``s.labelled`` labelled documents, and ``s.unlabelled``
    others. Phrases are counted over all of the former; of several texts under one key each counts. What reaches the
    driver is bounded by the settings, whatever the number of tasks. None where there are no toxic and ordinary documents
    to learn from.
    """
    spark = docs.sparkSession
    y = labels.select(key, label, *[c for c in ("annotator",) if c in labels.columns]).distinct()
    y = y.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    y = y.groupBy(F.col(key).cast("bigint").alias("id")).agg(F.avg(F.col(label).cast("double")).alias("t")).where("t <> 0.5")
    y = materialize(y.select("id", (F.col("t") > 0.5).cast("int").alias("y")))
    part = min(1.0, s.labelled / max(1, y.count()))
    rows = _rows(docs, key, text, layout)
    others = min(1.0, s.unlabelled / max(1, rows.count()))
    marked = rows.join(F.broadcast(y.where(_within("id", part, 1))), "id", "left")  # about s.labelled rows of two numbers
    # a bounded number of texts, each costly: dealt to all cores, and copies dropped where they meet
    cores = spark.sparkContext.defaultParallelism
    marked = marked.where(F.col("y").isNotNull() | _within("id", others, 2)).repartition(cores, "id").distinct()
    marked = marked.select("id", "t", "l", "y", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("fold"))
    cut = materialize(marked.mapInArrow(partial(_cut, words=s.words), "id bigint, y int, fold int, w array<string>"))
    known = cut.where("y IS NOT NULL")
    size = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(size) < 2:
        release(y, cut)
        return None
    total = size[0] + size[1]
    share = size[1] / total
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    like = n1 * F.log(n1 / n / share) + F.when(n0 > 0, n0 * F.log(n0 / n / (1 - share))).otherwise(0.0)
    told = (
        known.mapInArrow(_told, "p string, y int").groupBy("p").agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
        .where((F.col("n1") >= s.least_docs(total)) & (n1 / n >= max(s.purity, share)))
        .select("p", like.alias("l"))
    )
    sent = spark.sparkContext.broadcast({r[0]: r[1] for r in told.toLocalIterator()})  # phrases of the toxic part of the labelled sample
    pick = partial(_pick, sent=sent, evidence=s.evidence(total, share), share=s.share)
    sample = _sampled(known.mapInArrow(pick, _PICKED), s)
    toxic, plain = {f: sample.get((1, f), []) for f in (0, 1)}, {f: sample.get((0, f), []) for f in (0, 1)}
    if not toxic[0] + toxic[1]:
        release(y, cut)
        return None
    more: list[str] = []

    def taught(*folds: int) -> tuple[bytes, bytes]:
        return (train([w for f in folds for w in toxic[f]] + more, s.dictionary, s.level), train([w for f in folds for w in plain[f]], s.dictionary, s.level))

    def judged() -> tuple[dict, float]:
        """The models that score fold 0, fold 1 and the unlabelled, and the threshold: a fold is scored by what the other taught."""
        pairs = {0: taught(1), 1: taught(0), None: taught(0, 1)}
        sent = spark.sparkContext.broadcast((pairs, s.level))
        by = F.floor(F.col("score") * 10).cast("int").alias("at")
        hist = known.mapInArrow(partial(_held_out, sent=sent), "y int, score double").groupBy(by).agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
        return pairs, _threshold([(r[0], r[1] - r[2]) for r in hist.collect()], s.near)  # a few hundred cells

    pairs, threshold = judged()
    # a second look: windows that the first fit finds in documents it did not see teach the second
    again = partial(_again, sent=spark.sparkContext.broadcast((pairs, s.level, threshold)))
    found = _sampled(cut.where("y IS NULL OR y = 1").mapInArrow(again, _PICKED), s)
    for f in (0, 1):
        toxic[f] = list(dict.fromkeys(toxic[f] + found.get((1, f), [])))[: s.toxic_windows]
    more = found.get((1, -1), [])
    pairs, threshold = judged()
    release(y, cut)
    return Model(*pairs[None], threshold, s.level)


def _within(key: str, part: float, salt: int):
    """About ``part`` of the rows, by a hash of ``key``."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30)) < F.lit(int(part * (1 << 30)))


def _sampled(windows: DataFrame, s: Settings) -> dict[tuple[int, int], list[str]]:
    """Distinct windows by (toxic, fold), of each about as many as the settings allow, by hash; nothing more reaches the driver."""
    picked = materialize(windows.distinct())
    most = {1: s.toxic_windows, 0: s.plain_windows}
    parts = {(r[0], r[1]): min(1.0, most[r[0]] / r[2]) for r in picked.groupBy("toxic", "fold").count().collect()}
    out: dict[tuple[int, int], list[str]] = {}
    for (toxic, fold), part in sorted(parts.items()):
        of = picked.where((F.col("toxic") == toxic) & (F.col("fold") == fold) & _within("w", part, 3))
        out[toxic, fold] = sorted(r[0] for r in of.select("w").collect())
    release(picked)
    return out


def _threshold(gains: list[tuple[int, int]], near: float) -> float:
    """The middle of the thresholds at which nearly the most toxic over ordinary documents are found; cells are tenths."""
    total, sums = 0, {}
    for at, gain in sorted(gains, reverse=True):
        total += gain
        sums[at] = total
    best = max(sums.values(), default=0)
    if best <= 0:
        return 1e5
    cells = range(max(1, min(sums)), max(sums) + 1)
    held, good = 0, []
    for at in reversed(cells):
        held = sums.get(at, held)
        if held >= near * best:
            good.append(at)
    return (good[0] + good[-1]) / 20 if good else 0.1


def _rows(docs: DataFrame, key: str, text: str, layout: str | None) -> DataFrame:
    return docs.where(F.col(key).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), (F.col(layout) if layout else F.lit(None).cast("string")).alias("l")
    )


def _cut(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        w = [windows(t, l, words) for t, l in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(w, pa.list_(pa.string()))], ["id", "y", "fold", "w"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases of a document, each once."""
    for b in batches:
        for y, ws in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if ws:
                p = list(set().union(*map(_phrases, ws)))
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array([y] * len(p), pa.int32())], ["p", "y"])


_PICKED = "fold int, toxic int, w string"


def _picks(out: list[tuple[int, int, str]]) -> Iterator[pa.RecordBatch]:
    if out:
        f, y, w = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(y, pa.int32()), pa.array(w)], ["fold", "toxic", "w"])


def _pick(batches: Iterator[pa.RecordBatch], sent, evidence: float, share: float) -> Iterator[pa.RecordBatch]:
    """Training windows: of toxic documents those made mostly of telling phrases, of ordinary ones those with few or none."""
    weight = sent.value
    for b in batches:
        out = []
        for y, fold, ws in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            for w in ws:
                phrases = _phrases(w)
                told = [weight[p] for p in phrases if p in weight]
                part = len(told) / len(phrases)
                if (y and part >= share and sum(told) >= evidence) or (not y and part < share / 3):
                    out.append((fold, y, w))
        yield from _picks(out)


def _again(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Windows over the threshold in documents marked toxic (by the other fold's model) and in unlabelled ones (fold -1)."""
    pairs, level, threshold = sent.value
    by = {f: _distance(*p, level) for f, p in pairs.items()}
    for b in batches:
        out = []
        for y, fold, ws in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            at = None if y is None else fold
            out += [(-1 if at is None else at, 1, w) for w in ws if by[at].of(w) >= threshold]
        yield from _picks(out)


@lru_cache(maxsize=4)
def _distance(toxic: bytes, plain: bytes, level: int) -> Distance:
    return Distance(toxic, plain, level)


def _held_out(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    pairs, level = sent.value
    by = {f: _distance(*p, level) for f, p in pairs.items()}
    for b in batches:
        y, fold, ws = (b.column(i).to_pylist() for i in (1, 2, 3))
        score = [max(map(by[f].of, w), default=-99.0) for f, w in zip(fold, ws, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(score, pa.float64())], ["y", "score"])


_SCORED = "doc_id bigint, score double, n_toxic int, passage string"


def score(docs: DataFrame, key: str, text: str, layout: str | None, model: Model | None, words: int = 14) -> DataFrame:
    """``doc_id, score, toxic, n_toxic, passage`` for every distinct document: its most toxic window and how many exceed
    the threshold.

    ``score`` is NULL and ``toxic`` false for a document without windows (NULL, empty, or without a letter) and for all
    where no model could be fitted. Units of every length and script are scored, but of one under about 12 bytes, a single
    short word, neither dictionary saves anything: it scores near 0. Repeated rows count once; rows with a NULL key are
    left out; whole texts are read.
    """
    rows = _rows(docs, key, text, layout)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of bounded size
    out = spread(rows).mapInArrow(partial(_score, sent=sent, words=words), _SCORED).distinct()
    return out.select("doc_id", "score", (F.col("n_toxic") > 0).alias("toxic"), "n_toxic", "passage")


def _score(batches: Iterator[pa.RecordBatch], sent, words: int) -> Iterator[pa.RecordBatch]:
    m = sent.value
    d = _distance(m.toxic, m.plain, m.level) if m else None
    for b in batches:
        best, count, passage = [], [], []
        for t, l in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            w = windows(t, l, words) if d else []
            s = np.fromiter(map(d.of, w), float, len(w)) if w else np.zeros(0)
            top = int(s.argmax()) if len(s) else -1
            best.append(float(s[top]) if len(s) else None)
            count.append(int((s >= m.threshold).sum()) if len(s) else 0)
            passage.append(w[top] if count[-1] else None)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(best, pa.float64()), pa.array(count, pa.int32()), pa.array(passage, pa.string())],
            ["doc_id", "score", "n_toxic", "passage"],
        )


def rates(scored: DataFrame, docs: DataFrame, key: str, source: str) -> DataFrame:
    """``source, n_docs, n_toxic, rate``; a NULL source is a source of its own."""
    of = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(source).alias("source")).distinct()
    both = of.join(scored.select("doc_id", "toxic"), "doc_id")
    by = both.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.col("toxic").cast("int")).cast("bigint").alias("n_toxic"))
    return by.select("source", "n_docs", "n_toxic", (F.col("n_toxic") / F.col("n_docs")).alias("rate"))
