import math
import random

import pytest

from strandline import api
from strandline.operators import align
from strandline.operators.align import GAP, KAPPA, LAMBDA, MATCH, MISMATCH
from strandline.plans import queries


def _rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _best(q, s):
    """Score of the best local alignment of all, over every cell."""
    best, last = 0, [0] * (len(s) + 1)
    for x in q:
        row = [0]
        for j, y in enumerate(s):
            row.append(max(0, last[j] + (MATCH if x == y else MISMATCH), last[j + 1] + GAP, row[j] + GAP))
        best, last = max(best, max(row)), row
    return best


def test_alignments_of_diverged_copies_are_those_of_exhaustive_alignment(spark, tmp_path):
    r = random.Random(11)
    q = {i: "".join(r.choice("ACGT") for _ in range(180)) for i in range(4)}
    noise = ["".join(r.choice("ACGT") for _ in range(64)) for _ in range(2)]

    def diverge(s, step):  # exact runs of step - 1 letters
        return "".join(_rc(c) if i % step == step - 1 else c for i, c in enumerate(s))

    copies = {  # (query, strand) by record
        0: (0, 1, diverge(q[0], 24)),
        1: (1, -1, _rc(diverge(q[1], 24))),
        2: (2, 1, diverge(q[2][:90], 24) + diverge(q[2][93:], 24)),  # with a gap
        3: (3, 1, q[3][40:63]),
        4: (3, 1, q[3][100:116]),  # a seed and no more: an E-value of over 1e-5
        5: (0, 1, q[0]),
    }
    seq = {i: noise[0] + c[2] + noise[1] for i, c in copies.items()}
    spark.createDataFrame(list(q.items()), "sig_no bigint, seq string").write.parquet(f"{tmp_path}/signatures.parquet")
    rec = [(i, i % 2, i // 2, f"r{i}", s) for i, s in seq.items()]
    spark.createDataFrame(rec, "record_idx int, assembly_idx int, record_no int, record_id string, seq string").write.parquet(f"{tmp_path}/records.parquet")
    got = {}
    for x in queries.alignments(spark, str(tmp_path)).collect():
        pair = (x["qseqid"], 2 * x["record_no"] + x["assembly_idx"], 1 if x["sstart"] <= x["send"] else -1)
        got[pair] = max(got.get(pair, 0), x["bitscore"])
    want = {}
    for i, (a, strand, _) in copies.items():
        score = _best(q[a] if strand > 0 else _rc(q[a]), seq[i])
        want[a, i, strand] = (LAMBDA * score / 2 - math.log(KAPPA)) / math.log(2)
    assert want.keys() <= got.keys()
    assert all(abs(got[p] - want[p]) < 1e-9 for p in want)
    letters = sum(map(len, seq.values()))
    assert 180 * letters * 2.0 ** -want[3, 4, 1] > 1e-5
    assert got.keys() <= want.keys()


def _markers(spark, r):
    q = ["".join(r.choice("ACGT") for _ in range(120)) for _ in range(3)]
    seq = {0: q[0] + "T" * 5000 + q[0][:80] + "CC" + q[1], 1: "G" * 30 + q[0], 2: _rc(q[1][:100]), 3: "ACGT" * 50, 4: q[0]}
    rec = spark.createDataFrame([(i, 0, f"r{i}", s) for i, s in seq.items()], "assembly_idx int, record_no int, record_id string, seq string")
    assemblies = spark.createDataFrame([(0, True), (1, True), (2, False), (3, False), (4, None)], "assembly_idx int, is_target boolean")
    return q, rec, assemblies, spark.createDataFrame(list(enumerate(q)), "qseqid int, seq string")


def test_limits_columns_and_tasks_of_a_search(spark):
    q, rec, _, queries_ = _markers(spark, random.Random(3))
    whole = align.align(queries_, rec, max_hsps=None, max_targets=None)
    far = [x for x in whole.collect() if x["qseqid"] == 0 and x["assembly_idx"] == 0]
    assert {(x["sstart"], x["send"]) for x in far} >= {(1, 120), (5121, 5200)}  # positions are those of the record
    assert all(x["sseq"] == q[0] for x in far if x["sstart"] == 1 and x["nident"] == 120)
    one = align.align(queries_, rec, max_hsps=1, columns=["qseqid", "assembly_idx", "nident"])
    assert one.columns == ["qseqid", "assembly_idx", "nident"] and max(one.groupBy("qseqid", "assembly_idx").count().collect(), key=lambda x: x["count"])["count"] == 1
    best = align.align(queries_.where("qseqid = 0"), rec, max_targets=2).select("assembly_idx").distinct()
    assert best.count() == 2
    short = align.align(spark.createDataFrame([(0, q[2][:14])], "qseqid int, seq string"), spark.createDataFrame([(0, 0, "r", q[2])], "assembly_idx int, record_no int, record_id string, seq string"), task="blastn-short")
    assert [x["nident"] for x in short.collect() if x["qend"] == 14][0] == 14
    with pytest.raises(ValueError):
        align.align(queries_, rec, task="other")


def test_markers_are_evaluated(spark):
    _, rec, assemblies, m = _markers(spark, random.Random(3))
    best, ev = api.eval_markers(m, rec, assemblies, 2, 2)
    got = {x["qseqid"]: x for x in ev.collect()}
    assert got[0]["conservation"] == 1.0 and got[0]["f_neg_hits"] == 0.0 and got[0]["avg_repeats_tar"] > 1
    assert got[1]["f_tar_hits"] == 0.5 and got[1]["f_neg_hits"] == 0.5 and got[2]["conservation"] == 0.0
    assert {x["assembly_idx"] for x in best.collect()} == {0, 1, 2}
    _, ev = api.eval_markers(m, rec, assemblies, 2, 2, neg_only=True)
    got = {x["qseqid"]: x for x in ev.collect()}
    assert got[1]["f_neg_hits"] == 0.5 and got[0]["conservation"] == got[1]["f_tar_hits"] == 0.0
    with pytest.raises(RuntimeError):
        api.eval_markers(m.where("qseqid = 2"), rec, assemblies, 2, 2)


def test_planted_diverged_copies_are_found(spark):
    """Copies with one in 25 letters changed, in records of noise: found by their seeds, nearly all."""
    r = random.Random(9)
    q = ["".join(r.choice("ACGT") for _ in range(200)) for _ in range(40)]
    seq = []
    for i in range(120):
        s = "".join(_rc(c) if r.random() < 0.04 else c for c in q[i % 40])
        seq.append("".join(r.choice("ACGT") for _ in range(300)) + (s if i % 2 else _rc(s)) + "".join(r.choice("ACGT") for _ in range(300)))
    rec = spark.createDataFrame([(i, 0, "r", s) for i, s in enumerate(seq)], "assembly_idx int, record_no int, record_id string, seq string")
    got = {(x["qseqid"], x["assembly_idx"]) for x in align.align(spark.createDataFrame(list(enumerate(q)), "qseqid int, seq string"), rec).where("nident >= 150").collect()}
    assert sum((i % 40, i) in got for i in range(120)) >= 114 and all(a == b % 40 for a, b in got)
