import math
import random

from strandline.operators.selection import keyed_quantiles, occurrence_report
from tests.conftest import rows


def test_quantiles_of_hot_and_cold_keys(spark):
    r = random.Random(3)
    data = [(1, r.choice([r.randint(-(2**62), 2**62), r.randint(0, 50)])) for _ in range(6000)]
    data += [(k, r.randint(-5, 5)) for k in range(2, 40) for _ in range(k % 9)]
    data += [(None, v) for v in (7, 9, 11, 13, 15)] + [(2, None), (99, None)] + [(50, 4)] * 500
    df = spark.createDataFrame([(k, v, "clash") for k, v in data], "key bigint, val bigint, n string").repartition(5)
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = {x["key"]: x for x in keyed_quantiles(df, "key", "val", probs, bins=16).collect()}
    by = {}
    for k, v in data:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        vs.sort()
        want = [vs[max(1, math.ceil(p * len(vs))) - 1] for p in probs]
        assert (got[k]["n"], got[k]["lo"], got[k]["hi"], got[k]["quantiles"]) == (len(vs), vs[0], vs[-1], want), k


def test_no_rows_and_no_probs(spark):
    empty = spark.createDataFrame([], "k bigint, v bigint")
    assert rows(keyed_quantiles(empty, "k", "v")) == []
    df = spark.createDataFrame([(1, 5), (1, 6)], "k bigint, v bigint")
    assert [tuple(r) for r in keyed_quantiles(df, "k", "v", ()).collect()] == [(1, 2, 5, 6, [])]


def test_occurrences_against_stated_ranges(spark):
    k = [(1, 10), (2, 10), (2, 10), (3, 20), (4, None), (None, 10)]
    n = [(0, 10, 1, 3), (0, 10, 1, 3), (0, 20, 3, 5), (1, 30, 5, 5), (1, 40, 5, 6), (1, None, 4, 5), (2, 20, None, 9)]
    kmers = spark.createDataFrame(k, "kmer_no bigint, hash bigint")
    nodes = spark.createDataFrame(n, "segment_no int, hash bigint, start bigint, stop bigint")
    got = {r["hash"]: (r["n_kmers"], r["n_stated"], r["agrees"]) for r in occurrence_report(kmers, nodes).collect()}
    assert got == {10: (2, 2, True), 20: (1, 2, False), 30: (0, 0, True), 40: (0, 1, False), None: (1, 1, True)}
    assert rows(occurrence_report(kmers.limit(0), nodes.limit(0))) == []
