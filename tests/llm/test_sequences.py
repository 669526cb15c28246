import random

import pytest

from strandline.llm import fusion, near_dup, overlap, spans
from tests.conftest import rows


def _rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _set(s, k):
    s = (s or "").upper()
    w = [s[i : i + k] for i in range(len(s) - k + 1)]
    return {min(x, _rc(x)) for x in w if set(x) <= set("ACGT")}


def _families(r, n, size, length=300):
    out = []
    for _ in range(n):
        base = "".join(r.choice("ACGT") for _ in range(length))
        for _ in range(size):
            s = list(base)
            for _ in range(r.randint(0, 3)):
                s[r.randrange(len(s))] = r.choice("ACGT")
            t = "".join(s)
            out.append(r.choice([t, _rc(t), t.lower(), t[: length - r.randint(0, 40)]]))
    return out


def _groups(texts, k, th):
    sets = {i: _set(s, k) for i, s in texts}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j] and len(sets[i] & sets[j]) >= th * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [512, 3])
def test_near_duplicates_by_brute_force(spark, hot):
    r = random.Random(4)
    texts = list(enumerate(_families(r, 6, 7) + ["".join(r.choice("ACGT") for _ in range(250)) for _ in range(10)] + [None, "", "ACGT", "N" * 50, "A" * 200, "A" * 90]))
    df = spark.createDataFrame([(i, s, "clash", 1) for i, s in [*texts, texts[0], texts[5]]] + [(None, "ACGT" * 9, "x", 2)], "key bigint, seq string, id string, rep int")
    got = {x["key"]: x["group_id"] for x in near_dup.near_duplicates(df.repartition(3), "key", "seq", hot=hot).collect()}
    assert got == _groups(texts, 15, 0.5)
    pairs = rows(near_dup.group_pairs(near_dup.near_duplicates(df, "key", "seq", hot=hot), "key"))
    assert len(pairs) == sum(1 for a in got for b in got if a < b and got[a] == got[b])


@pytest.mark.parametrize("hot", [512, 1])
def test_each_text_of_a_key_is_compared_as_itself(spark, hot):
    r = random.Random(12)
    low, high = ("A" * 3 + "".join(r.choice("ACGT") for _ in range(200)), "T" * 3 + "".join(r.choice("ACGT") for _ in range(200)))
    texts = [(1, low), (1, high), (2, low + "G"), (3, high + "C"), (4, low + "C"), (5, "".join(r.choice("ACGT") for _ in range(200)))]
    df = spark.createDataFrame(texts, "key bigint, seq string")
    got = rows(near_dup.near_duplicates(df, "key", "seq", hot=hot))
    assert got == [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 5)]


@pytest.mark.parametrize("hot", [512, 2])
def test_hot_lists_give_the_same_groups(spark, hot):
    """Families that share a stretch, so that unrelated records meet in long lists, and copies under several keys."""
    r = random.Random(7)
    shared = "".join(r.choice("ACGT") for _ in range(60))
    texts = []
    for n in (40, 12, 3, 1, 1, 1, 1, 1):
        base = shared + "".join(r.choice("ACGT") for _ in range(240))
        for _ in range(n):
            s = list(base)
            for _ in range(r.randint(0, 6)):
                s[r.randrange(len(s))] = r.choice("ACGT")
            texts.append((len(texts), "".join(s)))
    texts += [(len(texts) + i, texts[i * 5][1]) for i in range(6)]
    df = spark.createDataFrame(texts, "key bigint, seq string")
    sets = {i: frozenset(_set(s, 15)) for i, s in texts}
    group = _groups(texts, 15, 0.5)
    want = [(i, min(j for j in sets if sets[j] == sets[i]), group[i]) for i, _ in texts]
    assert rows(near_dup.near_duplicates(df, "key", "seq", hot=hot)) == sorted(want, key=repr)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "key bigint, seq string")
    assert rows(near_dup.near_duplicates(df, "key", "seq")) == []


def test_string_sets_of_long_rows_in_pieces():
    import pyarrow as pa

    from strandline.operators import kernels as K

    r = random.Random(8)
    seqs = ["".join(r.choice("ACGTN") for _ in range(n)) for n in (5, 700, 90, 0, 400)]
    old, K.PIECE = K.PIECE, 128
    K.pieces.__defaults__ = (128,)
    try:
        got = [len(x) for x in near_dup._sets(pa.array(seqs), 7)]
    finally:
        K.PIECE = old
        K.pieces.__defaults__ = (old,)
    assert got == [len(_set(s, 7)) for s in seqs]


def test_fusion_by_brute_force(spark):
    r = random.Random(1)
    nan = float("nan")
    data = [(g, i, r.choice([r.random(), 0.5]), r.choice([r.random() * 1000, nan, None] + [7.0] * 3), r.randint(0, 3) * 1.0) for i in range(400) for g in [r.choice([1, 1, 1, 2, None])]]
    df = spark.createDataFrame([(*d, "x") for d in data + data[:50]], "grp int, item bigint, a double, b double, c double, fused string").repartition(4)
    got = {(x["grp"], x["item"]): (x["fused"], x["place"]) for x in fusion.fuse_ranks(df, "item", "grp", {"a": True, "b": False, "c": True}).collect()}
    want = {}
    for g in (1, 2, None):
        part = [d for d in data if d[0] == g and d[3] is not None and d[3] == d[3]]
        total = {}
        for d in part:
            rank = lambda j, up: sum((x[j] > d[j]) if up else (x[j] < d[j]) for x in part) + (sum(x[j] == d[j] for x in part) + 1) / 2  # noqa: E731, B023
            total[d[1]] = sum(sorted(1 / (60 + q) for q in (rank(2, True), rank(3, False), rank(4, True))))
        for n, i in enumerate(sorted(total, key=lambda i: (-total[i], i))):
            want[g, i] = (total[i], n + 1)
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1] for k in want)
    keep = spark.createDataFrame([(1, 3), (2, None), (None, 2)], "grp int, n int")
    assert len(rows(fusion.keep_best(fusion.fuse_ranks(df, "item", "grp", {"a": True}), keep, "grp", "n"))) == 5
    assert rows(fusion.fuse_ranks(df.limit(0), "item", "grp", {"a": True})) == []


def test_a_key_scored_twice_is_ranked_once(spark):
    data = [(1, 10, 0.9, 5.0), (1, 10, 0.1, 9.0), (1, 11, 0.5, 1.0), (1, 12, 0.4, 2.0), (1, 12, None, 7.0)]
    df = spark.createDataFrame(data, "grp int, item bigint, a double, b double")
    got = rows(fusion.fuse_ranks(df, "item", "grp", {"a": True, "b": True}).select("item", "place"))
    want = rows(fusion.fuse_ranks(df.where("NOT (item = 10 AND a = 0.9)"), "item", "grp", {"a": True, "b": True}).select("item", "place"))
    assert got == want and len(got) == 3


@pytest.mark.parametrize("hot", [20_000, 2])
def test_spans_by_brute_force(spark, monkeypatch, hot):
    r = random.Random(6)
    n = 24
    share = ["".join(r.choice("ACGT") for _ in range(m)) for m in (n - 1, n, n + 9, 3 * n)]
    texts = []
    for _ in range(30):
        s = "".join(r.choice("ACGT") for _ in range(r.randint(0, 60)))
        for _ in range(r.randint(0, 2)):
            s += r.choice(share) + "".join(r.choice("ACGTN") for _ in range(r.randint(0, 20)))
        texts.append(s if r.random() < 0.7 else s.lower())
    texts += [None, "", "N" * 80, "A" * 100, "A" * 40, _rc(share[3]), texts[4].lower(), texts[7], texts[7], "AC" * 30, "AC" * 30]
    monkeypatch.setattr(spans, "HOT", hot)
    df = spark.createDataFrame([(i, s, "x", 0) for i, s in enumerate(texts)] + [(3, texts[3], "x", 1), (None, texts[3], "x", 1)], "key int, seq string, id string, h int")
    has = {i: {(s or "").upper()[p : p + n] for p in range(len(s or "") - n + 1)} for i, s in enumerate(texts)}
    has = {i: {w for w in ws if set(w) <= set("ACGT")} for i, ws in has.items()}
    want = [(a, b) for a in has for b in has if a < b and has[a] & has[b]]
    u = spans.Collection(df, "key", "seq", n)
    assert rows(spans.sharing_pairs(u, u, n)) == sorted(want, key=repr) and len(want) > 20
    drawn = spark.createDataFrame([(100, 3, texts[3]), (101, None, share[3]), (102, 5, "ACGT")], "sig bigint, own int, seq string")
    got = rows(spans.sharing_pairs(spans.Collection(drawn, "sig", "seq", n, "own"), u, n))
    full = {share[3][p : p + n] for p in range(2 * n + 1)}
    assert got == sorted([(100, b) for b in has if b != 3 and has[3] & has[b]] + [(101, b) for b in has if full & has[b]], key=repr)
    first = {}
    for i in sorted(has):
        s = (texts[i] or "").upper()
        for p in range(len(s) - n + 1):
            if s[p : p + n] in has[i]:
                first.setdefault(s[p : p + n], (i, p))
    inside = {i: set() for i in has}
    kept = {i: set() for i in has}
    for x in spans.shared_spans(df, "key", "seq", n).collect():
        inside[x["key"]] |= set(range(x["start"], x["stop"]))
        if x["kept"]:
            kept[x["key"]] |= set(range(x["start"], x["stop"] - n + 1))
    for i in has:
        s = (texts[i] or "").upper()
        at = [p for p in range(len(s) - n + 1) if s[p : p + n] in has[i] and any(s[p : p + n] in has[j] for j in has if j != i)]
        assert inside[i] == {q for p in at for q in range(p, p + n)}
        assert kept[i] == {p for p in at if first[s[p : p + n]] == (i, p)}
    cov = {x["key"]: x["n_shared"] for x in spans.coverage(df, spans.shared_spans(df, "key", "seq", n), "key", "seq").collect()}
    assert cov == {i: len(v) for i, v in inside.items()}
    none = df.limit(0)
    assert rows(spans.shared_spans(none, "key", "seq", n)) == []


def test_spans_of_keys_with_several_texts(spark):
    r = random.Random(2)
    x, y, z = ("".join(r.choice("ACGT") for _ in range(60)) for _ in range(3))
    data = [(1, x), (1, y), (2, x[:40] + z[:20]), (3, y), (4, y.lower()), (4, z), (1, x)]
    df = spark.createDataFrame(data, "key bigint, seq string")
    u = spans.Collection(df, "key", "seq", 30)
    # 2 and 3 share nothing, though both share a text with 1
    assert rows(spans.sharing_pairs(u, u, 30)) == [(1, 2), (1, 3), (1, 4), (3, 4)]
    got = spans.shared_spans(df, "key", "seq", 30)
    assert got.columns == ["key", "start", "stop", "kept"] and got.where("stop - start < 30").count() == 0
    assert rows(spans.coverage(df, got, "key", "seq").select("key", "n_letters")) == [(1, 60), (2, 60), (3, 60), (4, 60)]


@pytest.mark.parametrize("hot", [256, 4, 1])
def test_overlaps_by_brute_force(spark, hot):
    r = random.Random(hot)
    sets = {s: {r.randint(0, 6) if r.random() < 0.3 else r.randint(0, 400) + s // 4 * 1000 for _ in range(r.choice([1, 3, 40]))} for s in range(40)}
    data = [(s, x) for s, xs in sets.items() for x in xs]
    df = spark.createDataFrame([(*d, "c") for d in data + data[:20]] + [(None, 1, "c"), (1, None, "c")], "grp int, item bigint, l string").repartition(3)
    want = [(a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 2 * min(len(sets[a]), len(sets[b]))]
    assert rows(overlap.overlapping_sets(df, "grp", "item", 0.4, hot=hot)) == sorted(want, key=repr)
    assert rows(overlap.overlapping_sets(df.limit(0), "grp", "item")) == []
