import random
from collections import Counter

from pyspark.sql import functions as F

from strandline.operators.components import connected_components
from strandline.operators.ranking import row_numbers, tied_ranks
from tests.conftest import rows


def test_numbers_inside_groups_of_any_size(spark):
    r = random.Random(1)
    data = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.randint(0, 40), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, v int, id int").repartition(7)
    got = {x["id"]: x["rank"] for x in row_numbers(df, ["g"], [F.col("v").desc(), F.col("id").asc()]).collect()}
    want, seen = {}, Counter()
    for g, _, i in sorted(data, key=lambda x: (-x[1], x[2])):
        seen[g] += 1
        want[i] = seen[g]
    assert got == want
    assert rows(row_numbers(df.limit(0), ["g"], [F.col("id")])) == []


def test_tied_values_are_counted_once(spark):
    data = [("a", 1.0)] * 5 + [("a", 2.0), ("a", 3.0), ("a", 3.0), ("b", 9.0), ("b", None), (None, 1.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(3)
    got = rows(tied_ranks(df, ["g"], "v"))
    assert got == sorted([("a", 1.0, 5, 0), ("a", 2.0, 1, 5), ("a", 3.0, 2, 6), ("b", 9.0, 1, 0), (None, 1.0, 1, 0)], key=repr)
    assert ("a", 1.0, 5, 3) in rows(tied_ranks(df, ["g"], "v", descending=True))


def test_components_of_paths_stars_and_random_edges(spark):
    r = random.Random(2)
    e = [(i, i + 1) for i in range(100, 180)] + [(1000, 1000 + i) for i in range(60)] + [(r.randint(0, 90), r.randint(0, 90)) for _ in range(60)]
    e += [(5, 5), (None, 3), (3, None), (100, 101)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in e:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    df = spark.createDataFrame(e, "a bigint, b bigint")
    assert rows(connected_components(df)) == sorted(((x, find(x)) for x in parent), key=repr)
    assert rows(connected_components(df.limit(0))) == []
