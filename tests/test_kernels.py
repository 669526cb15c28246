import random

import numpy as np
import pyarrow as pa

from strandline.operators import kernels as K
from strandline.operators.sketch import record_minimizers


def _seqs(seed, n=12):
    r = random.Random(seed)
    return ["".join(r.choice("ACGTacgtN" if r.random() < 0.1 else "ACGT") for _ in range(r.randint(0, 120))) for _ in range(n)]


def test_runs_and_codes_by_brute_force():
    seqs = _seqs(1) + ["", "NNNN", "A"]
    code, off = K.letters(pa.array(seqs))
    begin, end = K.runs(code, off)
    fwd, rc = K.window_codes(code, 7), K.window_codes_rc(code, 7)
    for i, s in enumerate(seqs):
        s = s.upper()
        for p, ch in enumerate(s):
            g = off[i] + p
            if ch not in "ACGT":
                assert begin[g] == end[g] == g
                continue
            a = max((q + 1 for q in range(p) if s[q] not in "ACGT"), default=0)
            b = min((q for q in range(p, len(s)) if s[q] not in "ACGT"), default=len(s))
            assert (begin[g] - off[i], end[g] - off[i]) == (a, b)
            if p + 7 <= b:
                w = s[p : p + 7]
                num = lambda t: int("".join(str("ACGT".index(c)) for c in t), 4)
                assert fwd[g] == num(w)
                assert rc[g] == num("".join("TGCA"["ACGT".index(c)] for c in reversed(w)))


def test_minimizers_by_brute_force_and_in_pieces():
    seqs = _seqs(2)
    code, off = K.letters(pa.array(seqs))
    k, w = 5, 6
    whole = {(i, int(p - off[i])) for p in K.minimizers(code, off, k, w, 0, len(code))[0] for i in [int(np.searchsorted(off, p, "right")) - 1]}
    want = set()
    for i, s in enumerate(seqs):
        s = s.upper()
        h = [int(K.mix(np.array([K.window_codes(K.letters(pa.array([s[p : p + k]]))[0], k)[0]], np.uint64))[0]) for p in range(len(s) - k + 1)]
        for a in range(len(s) - (w + k - 1) + 1):
            if set(s[a : a + w + k - 1]) <= set("ACGT"):
                want.add((i, max(range(a, a + w), key=lambda p: (-h[p], p))))
    assert whole == want
    cut = set()
    for rows, c, o, shift, first, last in K.pieces(code, off, 2 * (w + k), size=40):
        p = K.minimizers(c, o, k, w, first, last)[0]
        row = np.searchsorted(o, p, "right") - 1
        cut |= set(zip(rows[row].tolist(), (p - o[row] + shift).tolist(), strict=True))
    assert cut == want


def test_rolling_hash_ignores_strand_and_skips_other_letters():
    r = random.Random(5)
    s = "".join(r.choice("ACGT") for _ in range(300))
    rc = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    code = lambda x: K.letters(pa.array([x]))[0]
    a, b = record_minimizers(code(s), 15, 10), record_minimizers(code(rc), 15, 10)
    assert set(a[1].tolist()) == set(b[1].tolist()) and len(a[0]) > 20
    assert len(record_minimizers(code("ACGT" * 5), 15, 10)[0]) == 0
    p, _ = record_minimizers(code(s[:150] + "N" + s[150:]), 15, 10)
    assert all("N" not in (s[:150] + "N" + s[150:])[x : x + 15] for x in p)
