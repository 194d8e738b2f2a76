import random

import pytest

from talkloom.llm import splits


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rnd = random.Random(seed)
    edges = [(f"n{rnd.randint(0, 80)}", f"n{rnd.randint(0, 80)}") for _ in range(60)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [("hub", f"leaf{i}") for i in range(200)] + [(None, "x"), ("y", "y")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in splits.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_nothing(spark):
    assert splits.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_largest_differencing():
    rnd = random.Random(1)
    weights = [rnd.randint(1, 100) for _ in range(300)]
    bins = splits.largest_differencing(weights, 10)
    loads = [sum(w for w, b in zip(weights, bins) if b == k) for k in range(10)]
    assert max(loads) - min(loads) <= 3
    assert splits.largest_differencing([], 3) == [] and splits.largest_differencing([5], 3) in ([0], [1], [2])


def test_balance_over_several_shards(spark):
    d = spark.createDataFrame([(f"g{i}", i % 13 + 1) for i in range(500)], "group_name string, weight int")
    rows = splits.balance(d, bins=8, shard=60).join(d, "group_name").collect()
    loads = {}
    for r in rows:
        loads[r["bin"]] = loads.get(r["bin"], 0) + r["weight"]
    assert len(rows) == 500 and len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 13


def tables(spark):
    c = spark.createDataFrame([("A_Ann", "A"), ("A_Bob", "A"), ("A_Cid", "A"), ("B_Ann", "B"), ("A_Dot", "A")], "child_name string, corpus string")
    t = spark.createDataFrame([("A/1.cha", "Bob", "A", 1), ("A/2.cha", None, "A", 1), ("A/3.cha", "A_DOT ", "A", 1), ("B/4.cha", "B-Ann", "B", 1), ("B/5.cha", None, "B", 1)], "transcript_file string, child_name string, corpus string, group_name int")
    u = spark.createDataFrame([("A/1.cha", "A__Ann", "A"), ("./A/2.CHA", "a cid", "A"), ("A/2.cha", "Bob", "A"), (None, "A_Dot", "A"), ("A/3.cha", None, "A"), ("A/3.cha", "", "A")] * 2, "transcript_file string, child_name string, corpus string")
    return t, u, c


def test_groups(spark):
    got = {r["transcript_file"]: r["group_name"] for r in splits.transcript_groups(*tables(spark)).collect()}
    assert got == {"A/1.cha": "A_Ann", "A/2.cha": "A_Ann", "A/3.cha": "A_Dot", "B/4.cha": "B_Ann", "B/5.cha": None}


def test_splits_keep_groups_whole(spark):
    rows = splits.split_transcripts(*tables(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["group_name"], set()).add(r["split"])
    assert len(rows) == 5 and all(len(s) == 1 for s in by.values())
    t, u, c = tables(spark)
    assert splits.split_transcripts(t.limit(0), u, c).count() == 0


def test_splits_are_near_their_shares(spark):
    d = "/root/testdata/sf0.01"
    s = splits.split_transcripts(*[spark.read.parquet(f"{d}/{n}.parquet") for n in ("transcripts", "utterances", "children")])
    n = {r["split"]: r["count"] / 800 for r in s.groupBy("split").count().collect()}
    assert abs(n["train"] - 0.8) < 0.05 and abs(n["test"] - 0.1) < 0.05 and abs(n["validation"] - 0.1) < 0.05
