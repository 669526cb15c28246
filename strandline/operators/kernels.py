"""Vectorized kernels over the letters of many sequences at once (numpy, used inside Arrow functions)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_CODE = np.full(256, 4, np.uint8)
for _i, _pair in enumerate((b"Aa", b"Cc", b"Gg", b"Tt")):
    for _b in _pair:
        _CODE[_b] = _i
PIECE = 1 << 20


def letters(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code of every letter, offsets of the rows); codes are 0-3 for A C G T in either case and 4 for all else."""
    col = pa.array(col, pa.large_string()) if not isinstance(col, pa.Array) else col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return _CODE[raw], off - off[0]


def pieces(code: np.ndarray, off: np.ndarray, halo: int, size: int = PIECE) -> Iterator[tuple]:
    """Cut rows into work of about ``size`` letters: (rows, codes, offsets, shift, first, last).

    Short rows share a piece; a longer row is cut into pieces that overlap by ``halo`` letters on both sides. ``shift`` is
    the position in its row of a piece's first letter; windows may begin at letters ``first`` to ``last`` of the piece.
    """
    n, at = len(off) - 1, 0
    while at < n:
        if off[at + 1] - off[at] > size:
            lo, hi = off[at], off[at + 1]
            for s in range(lo, hi, size):
                a, b = max(lo, s - halo), min(hi, s + size + halo)
                yield np.array([at]), code[a:b], np.array([0, b - a]), a - lo, s - a, min(hi, s + size) - a
            at += 1
            continue
        end = int(np.searchsorted(off, off[at] + size, "right")) - 1
        end = max(at + 1, min(end, n))
        a, b = off[at], off[end]
        yield np.arange(at, end), code[a:b], off[at : end + 1] - a, 0, 0, b - a
        at = end


def runs(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every letter, where the run of A C G T around it begins and ends; both are the letter itself where it is none."""
    n = len(code)
    bad = np.flatnonzero(code > 3)
    size = np.diff(off)
    end = np.repeat(off[1:], size)
    begin = np.repeat(off[:-1], size)
    if len(bad):
        i = np.arange(n, dtype=np.int64)
        at = np.searchsorted(bad, i)
        end = np.minimum(end, np.append(bad, n)[at])
        begin = np.maximum(begin, np.append(-1, bad)[at] + 1)
        begin[bad] = bad
    return begin, end


def window_codes(code: np.ndarray, k: int) -> np.ndarray:
    """2-bit codes of the k letters from each position (k <= 32), first letter highest; the tail is padded with zeros."""
    return _rolled(code.astype(np.uint64) & np.uint64(3), k, False)


def window_codes_rc(code: np.ndarray, k: int) -> np.ndarray:
    """As :func:`window_codes`, of the reverse complement."""
    return _rolled((code.astype(np.uint64) & np.uint64(3)) ^ np.uint64(3), k, True)


def _rolled(c: np.ndarray, k: int, backward: bool) -> np.ndarray:
    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        y = np.zeros_like(x)
        if by < len(x):
            y[: len(x) - by] = x[by:]
        return y

    def put(a: np.ndarray, n_a: int, b: np.ndarray, n_b: int) -> np.ndarray:
        return a | (b << np.uint64(2 * n_a)) if backward else (a << np.uint64(2 * n_b)) | b

    part, size, out, have, left = c, 1, None, 0, k
    while True:
        if left & 1:
            out, have = (part, size) if out is None else (put(out, have, ahead(part, have), size), have + size)
        left >>= 1
        if not left:
            return out
        part, size = put(part, size, ahead(part, size), size), size * 2


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits that scatters neighbouring codes (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def window_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each position the position of the least of the w values from it on, the last of equal ones."""
    n = len(h)
    val, pos = h.copy(), np.arange(n, dtype=np.int64)

    def fold(val, pos, by):
        if by >= n:
            return val, pos
        v, p = val.copy(), pos.copy()
        take = val[by:] <= val[: n - by]
        v[: n - by] = np.where(take, val[by:], val[: n - by])
        p[: n - by] = np.where(take, pos[by:], pos[: n - by])
        return v, p

    size = 1
    while size * 2 <= w:
        val, pos = fold(val, pos, size)
        size *= 2
    if size < w:
        val, pos = fold(val, pos, w - size)
    return pos


def minimizers(code: np.ndarray, off: np.ndarray, k: int, w: int, first: int, last: int) -> tuple[np.ndarray, ...]:
    """Positions that hold the least k-letter code (scattered by :func:`mix`) of some run of w of them inside A C G T.

    Returns (position, first and number of the runs of w it is the least of, begin and end of its run of A C G T, the
    scattered codes of all positions). Every w + k - 1 letters in a row have one such position, the last of equal ones,
    which depends on these letters alone.
    """
    none = np.zeros(0, np.int64)
    if len(code) < k:
        return none, none, none, none, none, none.astype(np.uint64)
    begin, end = runs(code, off)
    h = mix(window_codes(code, k))
    i = np.arange(len(code), dtype=np.int64)
    start = np.flatnonzero((i + (w + k - 1) <= end) & (i >= first) & (i < last))
    if not len(start):
        return none, none, none, none, none, h
    p, at, n = np.unique(window_argmin(h, w)[start], return_index=True, return_counts=True)
    return p, start[at], n, begin[p], end[p], h


def binary_column(rows: np.ndarray) -> pa.Array:
    """A pyarrow binary column of the rows of a 2-d uint8 array."""
    n, size = rows.shape
    off = pa.py_buffer(np.arange(0, (n + 1) * size, max(size, 1), dtype=np.int32)[: n + 1].tobytes() if size else np.zeros(n + 1, np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, off, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
