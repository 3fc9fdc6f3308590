"""Joins by similarity below all pairs, against all pairs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from examloom.functions.textsim import token_set
from examloom.operators import dedup, similarity
from examloom.plans.registry import QUERIES


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def all_pairs(x, t):
    s = unit(x) @ unit(x).T
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= t)) if i < j}


def frame(spark, x):
    return spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "id long, v array<double>").repartition(4)


@pytest.mark.parametrize(("threshold", "block", "cells"), [(0.9, 2048, 4096), (0.5, 30, 40), (0.0, 50, 9), (-0.3, 60, 9), (0.99, 7, 600)])
def test_vector_pairs_equal_all_pairs(spark, threshold, block, cells):
    dice = np.random.default_rng(5)
    x = dice.normal(size=(9, 6))[np.arange(200) % 9] + dice.normal(size=(200, 6)) * 0.4
    x[150:] = x[3]  # one vector that many rows share
    got = [(r.i, r.j) for r in similarity.near_pairs(frame(spark, x), "id", "v", threshold, block=block, cells=cells).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, threshold)


def test_clustered_vectors_are_compared_with_few(spark):
    dice = np.random.default_rng(6)
    x = dice.normal(size=(40, 32))[np.arange(2000) % 40] + dice.normal(size=(2000, 32)) * 0.2
    n = spark.sparkContext.accumulator(0)
    got = {(r.i, r.j) for r in similarity.near_pairs(frame(spark, x), "id", "v", 0.9, compared=n).collect()}
    assert got == all_pairs(x, 0.9)
    assert n.value < 2000 * 1999 / 2 / 3


def test_vector_pairs_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [3.0, 0.1])], "id long, v array<double>")
    assert {(r.i, r.j) for r in similarity.near_pairs(df, "id", "v", 0.9).collect()} == {(3, 4)}
    assert similarity.near_pairs(df.limit(0), "id", "v", 0.9).collect() == []
    best = similarity.near_pairs(frame(spark, np.array([[1, 0], [1, 0.1], [1, 0.2]])), "id", "v", 0.5, top_k=1)
    assert {(r.i, r.j) for r in best.collect()} <= {(0, 1), (1, 2)}


def plain_fuzzy(texts, t):
    return {(i, j, round(token_set(a, b), 9)) for i, a in texts for j, b in texts if i < j and token_set(a, b) >= t}


def some_texts(n, seed, vocabulary=60):
    dice = random.Random(seed)
    words = ["".join(dice.choice("abcdef") for _ in range(dice.randint(1, 7))) for _ in range(vocabulary)]
    out = []
    for i in range(n):
        kind = dice.random()
        if kind < 0.3 and out:
            w = out[dice.randrange(len(out))][1].split()
            w = [x if dice.random() < 0.9 else x[:-1] + "z" for x in w if dice.random() < 0.95]
        else:
            w = [dice.choice(words[:4] if dice.random() < 0.3 else words) for _ in range(dice.choice([1, 2, 5, 12, 30]))]
        out.append((i, " ".join(w)))
    return [*out, (n, ""), (n + 1, "  "), (n + 2, out[0][1]), (n + 3, "ß 漢字   é")]


@pytest.mark.parametrize(("threshold", "block"), [(100.0, 9), (95.0, 1024), (80.0, 13), (60.0, 40), (0.0, 60)])
def test_fuzzy_pairs_equal_all_pairs(spark, threshold, block):
    texts = some_texts(90, seed=int(threshold))
    df = spark.createDataFrame([*texts, (777, None), (None, "a b")], "id long, t string").repartition(4)
    got = [(r.i, r.j, round(r.sim, 9)) for r in dedup.fuzzy_pairs(df, "id", "t", threshold, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_fuzzy(texts, threshold)


def test_fuzzy_pairs_compare_few(spark):
    texts = some_texts(200, seed=3, vocabulary=400)
    n = spark.sparkContext.accumulator(0)
    got = {(r.i, r.j, round(r.sim, 9)) for r in dedup.fuzzy_pairs(spark.createDataFrame(texts, "id long, t string"), "id", "t", 90.0, compared=n).collect()}
    assert got == plain_fuzzy(texts, 90.0)
    assert n.value < len(texts) ** 2 / 2 / 10
    assert dedup.fuzzy_pairs(spark.createDataFrame([], "id long, t string"), "id", "t", 90.0).collect() == []


def test_near_pairs_are_placed_and_made_in_frames_of_bounded_size(monkeypatch):
    monkeypatch.setattr(similarity, "PART", 4000)
    monkeypatch.setattr(similarity, "ROWS", 100)
    x = unit(np.random.default_rng(3).normal(size=(300, 8)) + 5)
    keys = np.arange(300)
    frames = list(similarity.placements(similarity.Cells(x[:20], 0.2), keys, pd.Series(list(x))))
    assert max(map(len, frames)) <= 100
    placed = pd.concat(frames)
    assert sorted(placed["k"][~placed["copy"]]) == list(range(300)) and placed["copy"].sum() > 300
    assert np.allclose(np.array(placed["v"].to_list()), x[placed["k"]])
    frames = list(similarity.products(keys, x, keys, x, True, 0.2))
    assert max(map(len, frames)) <= 4000 and sum(map(len, frames)) == 300 * 299 // 2


def shuffled(spark):
    """Bytes that this session has written to shuffles so far."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))


def test_vectors_without_clusters_are_moved_a_few_times(spark):
    x = np.random.default_rng(8).normal(size=(2000, 32))
    df, before = spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "id long, v array<double>"), shuffled(spark)
    got = [(r.i, r.j) for r in similarity.near_pairs(df, "id", "v", 0.4, block=50).collect()]
    assert len(got) == len(set(got)) and set(got) == all_pairs(x, 0.4)
    assert shuffled(spark) - before < 2 * x.nbytes


def test_pairs_take_a_column_along(spark):
    x = np.random.default_rng(9).normal(size=(60, 3))
    df = frame(spark, x).withColumn("l", F.when(F.col("id") % 4 > 0, F.col("id") * 10**16 + 1))
    label = lambda i: i * 10**16 + 1 if i % 4 else None
    for block in (7, 2048):
        got = similarity.near_pairs(df, "id", "v", 0.8, block=block, beside="l").collect()
        assert {(r.i, r.j) for r in got} == all_pairs(x, 0.8)
        assert all((r.ei, r.ej) == (label(r.i), label(r.j)) for r in got)


def test_split_pairs_are_not_shuffled(spark, tmp_path):
    x = np.random.default_rng(10).normal(size=(700, 3))
    rows = [(i, [float(t) for t in v], None if i == 5 else i % 3) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a large table's joins
    got = {(r.i, r.j): r.decision for r in QUERIES["verification_split"](spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    s = unit(x) @ unit(x).T
    same = lambda i, j: 5 not in (i, j) and i % 3 == j % 3
    assert got == {(i, j): "trusted" if s[i, j] >= 0.48 or same(i, j) and s[i, j] >= 0.45 else "verify" for i, j in all_pairs(x, 0.4)}
    assert len(got) > 50000 and shuffled(spark) - before < 200_000


def test_listed_pairs_are_shuffled_once(spark, tmp_path):
    x = np.random.default_rng(11).normal(size=(700, 3))
    label = [None if i == 5 else i % 3 for i in range(700)]
    spark.createDataFrame([(i, [float(t) for t in v], label[i]) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a large table's joins
    got = sorted(((r.list, r.place, r.i, r.j) for r in QUERIES["verdict_lists"](spark, str(tmp_path)).collect()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved, s, want = shuffled(spark) - before, unit(x) @ unit(x).T, []
    for name, same in (("recovered", False), ("removed", True)):
        pairs = sorted((-round(s[i, j], 6), i, j) for i, j in all_pairs(x, 0.4) if (label[i] is not None and label[i] == label[j]) == same)
        want += [(name, at, i, j) for at, (_, i, j) in enumerate(pairs, 1)]
    assert got == want and moved < 40 * len(want)


def test_greedy_resolution_makes_few_of_the_pairs(spark, tmp_path):
    x = np.random.default_rng(12).normal(size=(600, 4))
    spark.createDataFrame([(i, [float(t) for t in v], i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # a large table's joins
    got = {(r.kept, r.removed, r.similarity) for r in QUERIES["embedding_greedy_dedup"](spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved, s, gone, want = shuffled(spark) - before, unit(x) @ unit(x).T, set(), set()
    pairs = sorted((-s[i, j], i, j) for i, j in all_pairs(x, 0.4))
    for sim, i, j in pairs:
        if i not in gone and j not in gone:
            kept, removed = (i, j) if i % 3 > j % 3 or i % 3 == j % 3 else (j, i)
            gone.add(removed)
            want.add((kept, removed, round(-sim, 6)))
    assert {(k, r) for k, r, _ in got} == {(k, r) for k, r, _ in want} and got == want
    assert moved < 60 * len(pairs), (moved, len(pairs))
