"""Evaluation texts leaking into training text (problem 8): a generalised suffix automaton of the test items' words.

The automaton accepts every run of words of every item. Documents are streamed through it word by word; at each word it
holds the longest run ending there that some item has, and the items that have it.

Items come in blocks of bounded size, a block's automaton being what a task holds. Where there are several, one pass over
the corpus keeps the documents that may hold a run of any item (a bit filter of the items' runs, which has no misses), and
only these are streamed through the blocks one after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, partial, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.notebooks import plain_text, without
from strandline.operators import kernels as K
from strandline.session import materialize, release, spread

_WORD = re.compile(r"[^\W_]+")
_ASCII = bytes(b if chr(b).isalnum() and b < 128 else 32 for b in range(256)).lower()
#: Items are taken in blocks of at most this many words (a longer item is a block), each with its own automaton, about 1 kB a
#: word in a Python worker; a block is what is broadcast.
BLOCK_WORDS = 200_000
#: Most bits of the filter; past a thirty-second as many runs it lets more documents through, never fewer.
FILTER_BITS = 1 << 30


def words(text: str) -> list[str]:
    """The longest runs of letters and digits, in lower case."""
    if text.isascii():
        return text.encode().translate(_ASCII).decode().split()
    return _WORD.findall(text.lower())


def places(text: str) -> list[tuple[int, int]]:
    """Where each of :func:`words` lies in the text."""
    low = text.lower()
    if len(low) == len(text):
        return [m.span() for m in _WORD.finditer(low)]
    at = [i for i, c in enumerate(text) for _ in c.lower()]  # letters whose lower case is of several
    return [(at[i], at[j - 1] + 1) for i, j in (m.span() for m in _WORD.finditer("".join(map(str.lower, text))))]


class Automaton:
    """Suffix automaton of several word sequences, with the items of every state."""

    def __init__(self, items: dict[int, list[str]], least: int):
        self.least = least
        self.ids: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = {i: [self.ids.setdefault(w, len(self.ids)) for w in ws] for i, ws in items.items()}
        for ws in coded.values():
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.items: list[frozenset[int]] = self._owners(coded)
        # the state of the last ``least`` words of whatever reaches a state
        self.short = [0] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            up = self.link[s]
            self.short[s] = self.short[up] if self.length[up] >= least else s

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        cur = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return cur

    def _state(self, nxt: dict, length: int, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _owners(self, coded: dict[int, list[int]]) -> list[frozenset[int]]:
        own: list[set[int]] = [set() for _ in self.link]
        for item, ws in coded.items():
            s = 0
            for w in ws:
                s = self.next[s][w]
                up = s
                while up > 0 and item not in own[up]:
                    own[up].add(item)
                    up = self.link[up]
        return [frozenset(x) for x in own]

    def matches(self, ws: list[str]) -> list[tuple[int, int, int]]:
        """(position of the last word, length of the longest run ending there, state) where it has ``least`` words."""
        get = self.ids.get
        code = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        # a run of known words that is too short cannot hold a match
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (code >= 0).astype(np.int8), [0]])))
        out = []
        for a, b in zip(edge[0::2], edge[1::2], strict=True):
            if b - a < self.least:
                continue
            s, n = 0, 0
            for at, w in enumerate(code[a:b].tolist(), int(a)):
                while s and w not in self.next[s]:
                    s = self.link[s]
                    n = self.length[s]
                if w in self.next[s]:
                    s, n = self.next[s][w], n + 1
                if n >= self.least:
                    out.append((at, n, s))
        return out

    def by_item(self, found: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, int]]]:
        """Item -> (first, last) word of each of its maximal runs."""
        runs: dict[int, list[tuple[int, int]]] = {}
        for at, n, s in found:
            seen: set[int] = set()
            while n >= self.least:
                for item in self.items[s] - seen:
                    r = runs.setdefault(item, [])
                    first = at - n + 1
                    if r and r[-1][1] == at - 1 and r[-1][0] >= first:
                        r[-1] = (r[-1][0], at)
                    else:
                        r.append((first, at))
                seen |= self.items[s]
                s = self.link[s]
                n = self.length[s]
        return runs


_Block = list[tuple[int, list[str]]]


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[_Block]:
    """(key, words) of every distinct text in blocks of bounded size; the driver holds one block at a time."""
    block, n = [], 0
    for r in items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint"), text).distinct().toLocalIterator():
        ws = words(r[1])
        if n and n + len(ws) > BLOCK_WORDS:
            yield block
            block, n = [], 0
        block.append((r[0], ws))
        n += len(ws)
    if block:
        yield block


@lru_cache(maxsize=1)
def _automaton(sent) -> Automaton:
    block, least = sent.value
    return Automaton({i: ws for i, (_, ws) in enumerate(block)}, least)


def _runs_of(ws: list[str], least: int, known: dict[str, int]) -> np.ndarray:
    """A scattered number for every run of ``least`` words."""
    if len(ws) < least:
        return np.zeros(0, np.uint64)
    if len(known) > 500_000:
        known.clear()
    h = np.fromiter((known.get(w) or known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in ws), np.uint64, len(ws))
    n = len(ws) - least + 1
    with np.errstate(over="ignore"):
        out = reduce(lambda g, i: g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n], range(least), np.zeros(n, np.uint64))
    return K.mix(out)


def _filter(blocks: Callable[[], Iterator[_Block]], least: int) -> np.ndarray:
    """Four bits for every run of ``least`` words of the items, as bytes."""
    n = sum(max(0, len(ws) - least + 1) for block in blocks() for _, ws in block)
    bits = min(FILTER_BITS, 1 << max(10, (32 * n).bit_length()))
    held, known = np.zeros(bits // 8, np.uint8), {}
    for block in blocks():
        for _, ws in block:
            for at in _bits(_runs_of(ws, least, known), bits):
                np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
    return held


def _bits(g: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        step = K.mix(g, 1) | np.uint64(1)
        return [(g + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(4)]


def _may_hold(batches: Iterator[pa.RecordBatch], sent, least: int) -> Iterator[pa.RecordBatch]:
    held, known = sent.value, {}
    bit = lambda at: (held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    for b in batches:
        keep = []
        for text, layout in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            g = _runs_of(words(plain_text(text, layout)), least, known)
            keep.append(bool(np.bitwise_and.reduce([bit(at) for at in _bits(g, len(held) * 8)]).any()))
        yield b.filter(pa.array(keep, pa.bool_()))



def _texts(docs: DataFrame, key: str, text: str, layout: str | None) -> DataFrame:
    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"), (F.col(layout) if layout else F.lit(None).cast("string")).alias("l")
    )


def _streamed(rows: DataFrame, blocks: Callable[[], Iterator[_Block]], least: int, work: Callable, schema: str) -> tuple[DataFrame, bool]:
    """What ``work`` gives of the rows for each block of items, and whether there are several blocks."""
    spark = rows.sparkSession
    found = blocks()
    head = [b for _, b in zip(range(2), found, strict=False)]
    rows = spread(rows)
    if len(head) > 1:
        held = spark.sparkContext.broadcast(_filter(blocks, least))
        rows = materialize(rows.mapInArrow(partial(_may_hold, sent=held, least=least), rows.schema))
        found = blocks()
        head = []
    out = [rows.mapInArrow(partial(work, sent=spark.sparkContext.broadcast((block, least))), schema) for block in chain(head, found)]
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], schema), len(out) > 1


_LEAKS = "doc_id bigint, item_id bigint, n_spans int, longest int, n_words int, coverage double"


def leaks(docs: DataFrame, key: str, text: str, layout: str | None, items: DataFrame, item: str, item_text: str, least: int = 12) -> DataFrame:
    """``doc_id, item_id, n_spans, longest, n_words, coverage``: documents that hold ``least`` words in a row of an item.

    ``n_spans`` counts the maximal runs, ``longest`` is the longest in words, ``n_words`` the document's words inside runs
    of the item, ``coverage`` the latter by the item's words, at most 1. Words are runs of letters and digits in lower case;
    in layout ``json`` those of the decoded strings of the cells. Of several texts under one item, and of several under one
    document, the two that share most words are reported. NULL keys and texts, empty texts and items of fewer words match
    nothing. Repeated rows count once. Other columns are ignored; an empty table of either kind gives no rows.
    """
    out, _ = _streamed(_texts(docs, key, text, layout), lambda: _blocks(items, item, item_text), least, _scan, _LEAKS)
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "coverage", "longest", "n_spans")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_spans", "m.longest", "m.n_words", "m.coverage")


def _scan(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    auto, block = _automaton(sent), sent.value[0]
    for b in batches:
        rows = []
        for doc, text, layout in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            found = auto.matches(words(plain_text(text, layout)))
            if not found:
                continue
            for entry, runs in auto.by_item(found).items():
                covered = len({w for f, t in runs for w in range(f, t + 1)})
                item, ws = block[entry]
                rows.append((doc, item, len(runs), max(t - f + 1 for f, t in runs), covered, min(1.0, covered / len(ws))))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["doc_id", "item_id", "n_spans", "longest", "n_words", "coverage"],
            )


_SPANS = "id bigint, first bigint, t string, l string, spans array<struct<a:int,b:int>>"


def remove_leaks(
    docs: DataFrame, key: str, text: str, layout: str | None, items: DataFrame, item: str, item_text: str,
    least: int = 12, coverage: float = 0.5, floor: int = 6,
) -> DataFrame:
    """``doc_id, n_removed, text``: the documents that leak an item, without the leaked spans.

    A run of words of an item goes if it has ``least`` words, or at least ``floor`` words and ``coverage`` of the item.
    Everything between the first and last word of a span goes with it; a span may run over several strings of a ``json``
    notebook, each of which loses its part, and the notebook is written again. What a cut brings together is looked at
    again, until no such run is left; ``n_removed`` counts all spans. Documents without such a span give no row; a row for
    each distinct text of a key.
    """
    rows, done = _texts(docs, key, text, layout).select("*", F.xxhash64("t", "l").alias("first")), None
    while True:  # the first round reads the corpus, every other what the one before has cut
        work = partial(_mark, least=least, coverage=coverage)
        found, several = _streamed(rows, lambda: _blocks(items, item, item_text), min(floor, least), work, _SPANS)
        if several:
            found = found.groupBy("id", "first", "t", "l").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # spans of one text
        cut = materialize(found.distinct().mapInArrow(_cut, "id bigint, first bigint, n int, t string, l string"))
        if done is not None and cut.isEmpty():
            release(cut)
            return done.select(F.col("id").alias("doc_id"), F.col("n").alias("n_removed"), F.col("t").alias("text"))
        if done is None:
            done = cut
        else:
            old, new = done.select("id", "first", "n", "t", "l"), cut.select("id", "first", F.col("n").alias("n2"), F.col("t").alias("t2"))
            both = old.join(new, ["id", "first"], "left")
            more = materialize(both.select("id", "first", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.coalesce("t2", "t").alias("t"), "l"))
            release(done)
            done = more
        rows = cut.select("id", "t", "l", "first")


def _mark(batches: Iterator[pa.RecordBatch], sent, least: int, coverage: float) -> Iterator[pa.RecordBatch]:
    """The texts that hold runs to remove, with the places of these in the plain text."""
    auto, block = _automaton(sent), sent.value[0]
    for b in batches:
        rows = []
        for doc, text, layout, first in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            plain = plain_text(text, layout)
            found = [(at, n) for at, n, s in auto.matches(words(plain)) if n >= least or any(n >= coverage * len(block[i][1]) for i in auto.items[s])]
            if found:
                at = places(plain)
                rows.append((doc, first, text, layout, [{"a": at[w - n + 1][0], "b": at[w][1]} for w, n in found]))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "first", "t", "l", "spans"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, new = [], []
        for text, layout, spans in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
            cuts: list[tuple[int, int]] = []
            for i, j in sorted((x["a"], x["b"]) for x in spans):
                if cuts and i < cuts[-1][1]:
                    cuts[-1] = (cuts[-1][0], max(j, cuts[-1][1]))
                else:
                    cuts.append((i, j))
            n.append(len(cuts))
            new.append(without(text, layout, cuts))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(new, pa.string()), b.column(3)], ["id", "first", "n", "t", "l"])
