"""Leader clusters in rounds against the walk from row to row."""

import random

from examloom.functions.textsim import indel_ratio
from examloom.operators import dedup

SCHEMA = "pos int, id string, answer_key string, question_blob string, options_blob string, image_ids array<string>, size int"


def walk(rows, t):
    out = []
    for key in {r[2] for r in rows}:
        found, exact = [], {}
        for _, i, _, q, o, im, size in sorted(r for r in rows if r[2] == key):
            im = set(im or [])
            score = (len(im) > 0, len(im), size)
            at = exact.get(q)
            if at is None:
                at = next((k for k, c in enumerate(found) if indel_ratio(q, c["q"]) >= t and (indel_ratio(o, c["o"]) >= t or im & c["im"])), None)
                if at is None:
                    exact[q] = len(found)
                    found.append({"id": i, "q": q, "o": o, "im": im, "score": score, "all": {i}, "fuzzy": False})
                    continue
                found[at]["fuzzy"] = True
            c = found[at]
            c["all"].add(i)
            if score > c["score"]:
                c.update(id=i, q=q, o=o, im=im, score=score)
        out += [(c["id"], tuple(sorted(c["all"])), ("mixed" if c["fuzzy"] else "exact") if len(c["all"]) > 1 else None, len(c["all"])) for c in found]
    return sorted(out)


def inputs(n, seed, size=14):
    """n random inputs side by side, each with an answer key of its own."""
    dice, rows = random.Random(seed), []
    for k in range(n):
        base = ["".join(dice.choice("abc ") for _ in range(dice.choice([4, 8, 12]))) for _ in range(dice.randint(1, 3))]
        for _ in range(dice.randint(1, size)):
            edit = lambda x: "".join(dice.choice("abc") if dice.random() < 0.12 else c for c in x)
            q, o = edit(dice.choice(base)), edit(dice.choice(base)) if dice.random() < 0.5 else base[0]
            rows.append([f"i{len(rows):05d}", f"key{k}", q, o, [f"m{dice.randint(0, 2)}"] if dice.random() < 0.3 else [], dice.randint(1, 4)])
    dice.shuffle(rows)
    return [(p, *r) for p, r in enumerate(rows)]


def test_rounds_equal_the_walk_on_a_thousand_inputs(spark):
    rows = inputs(1000, 5)
    got = dedup.leader_clusters(spark.createDataFrame(rows, SCHEMA).repartition(4), 75.0)
    assert sorted((r.canonical_id, tuple(r.sources), r.method, r.cluster_size) for r in got.collect()) == walk(rows, 75.0)


def test_one_key_with_near_copies(spark):
    rows = [(p, i, "K", *rest) for p, i, _, *rest in inputs(25, 8, 10)]
    got = dedup.leader_clusters(spark.createDataFrame(rows, SCHEMA), 70.0, block=40)
    assert sorted((r.canonical_id, tuple(r.sources), r.method, r.cluster_size) for r in got.collect()) == walk(rows, 70.0)
    assert dedup.leader_clusters(spark.createDataFrame([], SCHEMA), 70.0).collect() == []
