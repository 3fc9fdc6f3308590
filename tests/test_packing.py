"""Bins across partitions, batches and samples by selection, against plain walks."""

import random

import pytest

from examloom.operators import packing


def plain_bins(costs, budget):
    out, used, at = [], 0, 0
    for c in costs:
        if used and used + c > budget:
            at, used = at + 1, 0
        used += c
        out.append(at)
    return out


@pytest.mark.parametrize(("seed", "budget", "top", "tasks"), [(1, 10, 4, 7), (2, 100, 30, 5), (3, 5, 9, 9), (4, 1000, 9, 6), (5, 7, 3, 1), (6, 0, 2, 4)])
def test_bins_equal_the_walk(spark, seed, budget, top, tasks):
    dice = random.Random(seed)
    keys = {"a": 300, "b": 3, "c": 40, None: 25}
    rows = [(k, 10 * p, dice.choice([0, 0, 1, dice.randint(0, top)])) for k, n in keys.items() for p in range(n)]
    want = {(k, p): b for k in keys for (_, p, _), b in zip([r for r in rows if r[0] == k], plain_bins([r[2] for r in rows if r[0] == k], budget), strict=True)}
    df = spark.createDataFrame(rows, "k string, p int, c int").repartition(3)
    got = packing.pack(df, "k", "p", "c", budget, tasks=tasks)
    assert got.columns == ["k", "p", "c", "bin"]
    assert {(r.k, r.p): r.bin for r in got.collect()} == want


def test_bins_of_odd_rows(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, 20), ("k", 3, 0), ("k", 3, None), ("k", None, 1)], "k string, p int, c int")
    got = packing.pack(df, "k", "p", "c", 10).collect()
    assert sorted(r.bin for r in got) == [0, 0, 1, 2, 2]
    assert packing.pack(df.limit(0), "k", "p", "c", 10).collect() == []
    with pytest.raises(ValueError):
        packing.pack(df, "k", "p", "c", 10, strict=True).collect()
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([("k", 1, -1)], "k string, p int, c int"), "k", "p", "c", 10)


def test_one_key_is_packed_in_many_tasks(spark):
    df = spark.range(40_000).selectExpr("1 AS k", "id AS p", "id * 7919 % 13 AS c")
    got = packing.pack(df, "k", "p", "c", 50, tasks=16)
    rows = sorted((r.p, r.bin) for r in got.collect())
    assert [b for _, b in rows] == plain_bins([p * 7919 % 13 for p, _ in rows], 50)


@pytest.mark.parametrize("percent", [1, 20, 50, 99])
def test_percent_sample_takes_the_smallest_hashes(spark, percent):
    def fnv(text):
        h = 2166136261
        for c in text.encode("utf-16-le")[::2]:
            h = ((h ^ c) * 16777619) & 0xFFFFFFFF
        return h

    sizes = {"a": 400, "b": 1, "c": 37}
    rows = [(k, i) for k, n in sizes.items() for i in range(n)]
    got = packing.percent_sample(spark.createDataFrame(rows, "dataset string, id int"), "dataset", "id", percent)
    want = {(k, i) for k, n in sizes.items() for i in sorted(range(n), key=lambda i: (fnv(f"{k}::{i}"), i))[: max(1, -(-n * percent // 100))]}
    assert {tuple(r) for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "__h" not in plan[plan.index("Window") : plan.index("\n", plan.index("Window"))]


def test_selection_ranks_ties_only(spark):
    df = spark.createDataFrame([("g", v, i) for i, v in enumerate([5, 5, 5, 5, 1, 9, 4095, 1 << 23])], "g string, v long, i int")
    for n in range(1, 10):
        got = packing.lowest(df, "g", "v", 24, ["i"], spark.createDataFrame([("g", n)], "g string, n int"))
        assert sorted((r.v, r.i) for r in got.collect()) == sorted((r.v, r.i) for r in df.collect())[:n]
