import random

import pytest
from pyspark.sql import functions as F

from examloom.functions.textsim import indel_ratio, token_set
from examloom.operators import aggregates, chunking, dedup, diff, indexing, packing, resume, retrieval, similarity
from examloom.sources import files


def sequential(edges, weight):
    alive, out = set(weight), []
    for i, j, _ in sorted(edges, key=lambda e: e[2]):
        if i in alive and j in alive:
            keep, drop = (i, j) if (weight[i], -i) > (weight[j], -j) else (j, i)
            alive.discard(drop)
            out.append((keep, drop))
    return sorted(out)


def test_greedy_fixture(spark):
    edges = [(0, 1, 0.99), (1, 2, 0.95), (0, 2, 0.90), (2, 3, 0.80)]
    nodes = spark.createDataFrame([(0, 5), (1, 5), (2, 9), (3, 5)], "id long, weight long")
    got = dedup.greedy(spark.createDataFrame(edges, "i long, j long, sim double"), nodes, by_similarity=True)
    assert sorted((r.kept, r.removed) for r in got.collect()) == [(0, 1), (2, 0), (2, 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_equals_sequential(spark, seed):
    dice = random.Random(seed)
    weight = {i: dice.randint(1, 3) for i in range(14)}
    edges = [(i, j, dice.random()) for i in weight for j in weight if i < j and dice.random() < 0.3]
    got = dedup.resolve(spark.createDataFrame(edges, "i long, j long, rank double"), spark.createDataFrame(list(weight.items()), "id long, weight long"))
    assert sorted((r.kept, r.removed) for r in got.collect()) == sequential(edges, weight)


def test_similarities():
    assert indel_ratio("abc", "abc") == 100
    assert indel_ratio("", "") == 100
    assert indel_ratio("ab", "cd") == 0
    assert indel_ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)
    assert token_set("a b c", "c b") == 100
    assert token_set("x", "y") == 0


def test_near_pairs_in_blocks(spark):
    dice = random.Random(3)
    rows = [(i, [dice.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(99, [0.0] * 4)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    small = {(r.i, r.j) for r in similarity.near_pairs(df, "id", "v", 0.8, block=7).collect()}
    whole = {(r.i, r.j) for r in similarity.near_pairs(df, "id", "v", 0.8).collect()}
    assert small == whole and all(99 not in p for p in whole)


def test_leader_clusters(spark):
    rows = [(0, "a", "A", "what is the colour", "x", [], 5), (1, "b", "A", "what is the colour", "y", [], 9), (2, "c", "A", "what is the color", "x", ["i"], 5), (3, "d", "B", "what is the colour", "x", [], 5)]
    df = spark.createDataFrame(rows, "pos int, id string, answer_key string, question_blob string, options_blob string, image_ids array<string>, size int")
    got = {r.canonical_id: (r.sources, r.method) for r in dedup.leader_clusters(df, 80.0).collect()}
    assert got["d"] == (["d"], None)
    assert set(got) == {"b", "c", "d"} or got.get("c", got.get("b"))


def test_score_merge(spark):
    rows = [("d", "X", s) for s in (1.0, 0.0, 1.0, 1.0)] + [("d", "Y", 0.0)]
    parts = aggregates.score_partials(spark.createDataFrame(rows, "dataset string, experiment string, s double"), ["dataset", "experiment"], F.col("s"))
    each = {r.experiment: r for r in aggregates.final_scores(parts).collect()}
    assert (each["X"].mean, each["X"].variance, each["X"].se) == (0.75, 0.25, 0.25)
    assert (each["Y"].mean, each["Y"].variance, each["Y"].se) == (0.0, 0.0, 0.0)
    m = aggregates.final_scores(aggregates.merged(parts, ["dataset"])).first()
    assert m.scored == 5 and m.mean == pytest.approx(0.6) and m.variance == pytest.approx(0.3)
    o = aggregates.over_experiments(aggregates.final_scores(parts), ["dataset"]).first()
    assert o.unweighted_mean == 0.375 and o.unweighted_se == 0.125
    blind = aggregates.summary_partials(parts, F.col("total") / F.col("scored"), F.col("scored"), F.col("lowest"), F.col("highest"))
    assert aggregates.merged(blind, ["dataset"]).first().squares is None


def test_diff(spark):
    local = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    remote = spark.createDataFrame([("b", 2), ("c", 4), ("d", 5)], "k string, v int")
    plan = diff.snapshot_diff(local, remote, "k", ["v"])
    assert {r.k: (r.action, r.changed) for r in plan.collect()} == {"a": ("append", []), "b": ("unchanged", []), "c": ("patch", ["v"]), "d": ("delete", [])}
    assert sorted(map(tuple, diff.apply_diff(local, remote, plan, "k").collect())) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(ValueError):
        diff.require_unique(local.unionByName(local), "k")


def test_packing(spark):
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate([5, 6, 30, 1, 1])], "k string, p int, c int")
    assert [r.bin for r in packing.pack(df, "k", "p", "c", 10).orderBy("p").collect()] == [0, 1, 2, 3, 3]
    ten = spark.createDataFrame([("d", i) for i in range(10)], "dataset string, id int")
    a = packing.percent_sample(ten, "dataset", "id", 20).collect()
    assert len(a) == 2 and a == packing.percent_sample(ten, "dataset", "id", 20).collect()
    assert packing.percent_sample(ten.limit(3), "dataset", "id", 1).count() == 1
    got = packing.renumbered(ten, [F.desc("id")]).orderBy("new_id").collect()
    assert [r.id for r in got] == list(range(9, -1, -1)) and [r.new_id for r in got] == list(range(1, 11))


def test_chunkers(spark):
    text = "One two. Three four?\nFive six. " * 20
    for method in ("fast", "recursive", "semantic"):
        cut = list(chunking.METHODS[method](text, **({"chunk_size": 50} if method == "fast" else {"chunk_size": 10})))
        assert "".join(text[a:b] for a, b, _ in cut) == text
    assert all(len(text[a:b].encode()) <= 50 for a, b, _ in chunking.fast(text, 50))
    assert list(chunking.fast("ééé", 3)) == [(0, 1, 1), (1, 2, 1), (2, 3, 1)]
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert {r.doc_id for r in chunking.chunk(df, "fast").collect()} == {1}
    with pytest.raises(NotImplementedError):
        chunking.chunk(df, "neural")


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma", [1.0, 0.0]), (2, "delta epsilon zeta", [0.0, 1.0])], "doc_id long, text string, v array<double>")
    q = spark.createDataFrame([(7, "beta", [0.1, 1.0])], "q long, qt string, qv array<double>")
    assert [r.doc_id for r in retrieval.retrieve(q, docs, "q", "doc_id", sparse=("qt", "text"), limit=2).collect()] == [1]
    both = retrieval.retrieve(q, docs, "q", "doc_id", dense=("qv", "v"), sparse=("qt", "text"), limit=2)
    assert {r.doc_id for r in both.collect()} == {1, 2}
    with pytest.raises(ValueError):
        retrieval.plan(False, False, True)
    assert (retrieval.plan(True, True, False), retrieval.plan(True, False, False), retrieval.plan(True, False, True)) == ("fusion", "single", "rerank")


def test_index(spark, tmp_path):
    a, b = {"dense": {"size": 4}, "sparse": {}}, {"sparse": {}, "dense": {"size": 4}}
    assert indexing.schema_id(a) == indexing.schema_id(b) and len(indexing.schema_id(a)) == 12
    with pytest.raises(ValueError):
        indexing.require_same_schema(a, {"dense": {"size": 5}})
    with pytest.raises(ValueError):
        indexing.schema_id({"late": {}})


def test_resume(spark, tmp_path):
    assert resume.mismatches({"a": 1, "limit": 5}, {"a": 1, "limit": 9}, ("a", "limit"), may_grow=("limit",)) == []
    assert resume.mismatches({"a": 2}, {"a": 1}, ("a", "b")) == ["a: 2 saved, 1 wanted", "b is missing"]
    assert resume.latest_state(["x/run-2.json", "x/run-10.json", "y.json"], "run-1") == "x/run-10.json"
    work = spark.createDataFrame([(i,) for i in range(7)], "id long")
    path = str(tmp_path / "done")
    work.where("id < 2").withColumn("r", F.lit(0)).write.parquet(path)
    out = resume.run_in_steps(work, path, ["id"], lambda d: d.withColumn("r", F.lit(1)), "id", 2)
    assert [(r.id, r.r) for r in out.collect()] == [(0, 0), (1, 0)] + [(i, 1) for i in range(2, 7)]
    texts = spark.createDataFrame([(i, "x" * 5) for i in range(9)], "i long, t string")
    assert resume.summarised(texts, "t", "i", 12, lambda xs: xs[0][:3]) == "xxx"


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"questions": [{"id": 1, "question": "q", "options": {"A": "x"}}], "n": 1}')
    (tmp_path / "b.json").write_text('[{"id": 2, "question": "r"}]')
    (tmp_path / "c.json").write_text("not json")
    assert sorted(r.id for r in files.questions(spark, str(tmp_path)).collect()) == [1, 2]
    g = tmp_path / "g"
    g.mkdir()
    (g / "g.json").write_text('[{"id": "g", "questions": [{"id": "1", "questionText": "t", "options": [{"id": "A", "text": "x"}], "correctOptionIds": ["A"]}, {"id": "2", "questionText": "t"}]}]')
    rows = files.question_groups(spark, str(g))
    assert {r.id: r.invalid for r in files.validated(rows).collect()} == {"1": None, "2": "options"}
    with pytest.raises(ValueError):
        files.decode_or_fail(rows)
    pages = spark.createDataFrame([("d", "p10.md", "z"), ("d", "p2.md", "y")], "doc string, name string, text string")
    assert files.merged_pages(pages, "doc", "name", "text").first().text == "y\n\nz"


def test_paged_source(spark):
    from examloom.sources.remote import paged_source

    def fetch(cursor, options):
        n = int(cursor or 0)
        return [(options["key"], n)], None if n == 2 else str(n + 1)

    spark.dataSource.register(paged_source("paged_test", "key string, n int", fetch))
    got = spark.read.format("paged_test").option("keys", "a,b").load()
    assert sorted(map(tuple, got.collect())) == [(k, n) for k in "ab" for n in range(3)]


def test_stream_index(spark, tmp_path):
    from examloom.streaming.incremental import index_stream

    src, idx, cp = (str(tmp_path / x) for x in ("in", "index", "cp"))
    spark.createDataFrame([("a", "one. two."), ("b", "three.")], "source string, text string").write.parquet(src)
    index_stream(spark, src, "source string, text string", idx, cp)
    assert spark.read.parquet(idx).select("source").distinct().count() == 2
    spark.createDataFrame([("c", "four.")], "source string, text string").write.mode("append").parquet(src)
    index_stream(spark, src, "source string, text string", idx, cp)
    assert {r.source for r in spark.read.parquet(idx).collect()} == {"a", "b", "c"}


def test_semantic_chunker_by_vectors():
    from examloom import hooks

    hooks.EMBEDDERS["topics"] = lambda t: [float(t.count("sea")), float(t.count("sun")), float(t.count("ice"))]
    cut = lambda text, **k: [text[a:b].strip() for a, b, _ in chunking.semantic(text, embedder="topics", **k)]
    text = "The sea one. A sea two. Now sun. More sun here. The sea again. And ice."
    assert cut(text, threshold=0.5, window=1) == ["The sea one. A sea two.", "Now sun. More sun here.", "The sea again.", "And ice."]
    assert cut(text, threshold=0.5, window=1, skip=1) == ["The sea one. A sea two. Now sun. More sun here. The sea again.", "And ice."]
    assert cut(text, threshold=0.5, window=1, chunk_size=3) == ["The sea one.", "A sea two.", "Now sun.", "More sun here.", "The sea again.", "And ice."]
    # A window of three sentences still knows the sea, so that the last one is not apart from what is before it.
    assert cut("The sea. A sea. Deep sea. The sun. And sea.", threshold=0.5, window=3) == ["The sea. A sea. Deep sea.", "The sun. And sea."]
    assert cut("", threshold=0.5) == []
    del hooks.EMBEDDERS["topics"]


def test_patient_retries():
    from examloom import hooks

    class Limited(Exception):
        reset_at = 107.0

    slept, errors, alive = [], [Limited(), ConnectionError(), ValueError(), ValueError()], [True, False, False]

    def call():
        if errors:
            raise errors.pop(0)
        return "done"

    clock = (lambda: 100.0, slept.append, lambda: 0.5)
    assert hooks.patiently(call, alive.pop, first=2.0, clock=clock) == "done"
    assert slept == [8.0, 10.0, 10.0, 8.0 + 4.0, 16.0 + 8.0]
    errors += [ValueError()] * 9
    with pytest.raises(ValueError):
        hooks.patiently(call, attempts=3, clock=clock)


def test_remap_takes_the_exact_file_first(spark):
    rows = spark.createDataFrame([("e", 1, "a"), ("e", 1, "b"), ("e", 2, "x"), ("e", 2, "y"), ("e", 3, "a")], "exam string, id int, name string")
    files = spark.createDataFrame([("e", 1, "a", "2.png"), ("e", 1, "c", "1.png"), ("e", 2, "z", "3.png")], "exam string, id int, name string, file string")
    got = diff.remapped(rows, files, ["exam", "id", "name"], "id", "file", "file")
    assert sorted((r.id, r.name, r.found) for r in got.collect()) == [(1, "a", "2.png"), (1, "b", "1.png"), (2, "x", "3.png"), (2, "y", "3.png")]


def test_greedy_takes_all_copies_of_a_node_in_few_rounds(spark, monkeypatch):
    n = 60
    weight = [(i * 7) % 5 for i in range(n)]
    edges = [(i, j, i * n + j) for i in range(n) for j in range(i + 1, n) if i % 4 == j % 4]
    gone, want = set(), []
    for i, j, rank in edges:
        if i not in gone and j not in gone:
            kept, removed = (i, j) if weight[i] >= weight[j] else (j, i)
            gone.add(removed)
            want.append((kept, removed, rank))
    rounds = []
    stored = dedup.stored
    monkeypatch.setattr(dedup, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    out = dedup.resolve(spark.createDataFrame(edges, "i long, j long, rank long"), spark.createDataFrame(list(enumerate(weight)), "id long, weight long"))
    assert sorted((r.kept, r.removed, r["rank"]) for r in out.collect()) == sorted(want)
    assert rounds.count("decided") <= 7


def test_chunks_are_given_out_in_frames_of_bounded_size():
    rows = [("d", i, "x" * 50, 0, 50, 1) for i in range(1000)]
    got = list(chunking.frames(iter(rows), 3000))
    assert max(map(len, got)) <= 20 and [tuple(r) for f in got for r in f.itertuples(index=False)] == rows
    assert list(chunking.frames(iter([]))) == []


def test_nearest_keeps_its_best_from_slice_to_slice(spark, monkeypatch):
    """A slice of one row at a time, many equal scores: ties by key, and k rows a query and task leave it."""
    monkeypatch.setattr(similarity, "PART", 3)
    rows = [(f"k{(i * 37) % 90:02d}", [1.0, float(i % 3)]) for i in range(90)]
    corpus = spark.createDataFrame(rows, "c string, v array<double>").repartition(2)
    queries = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 2.0]), ("z", [0.0, 0.0])], "q string, w array<double>")
    got = {(r.q, r.c, r["rank"]) for r in similarity.nearest(queries, corpus, "q", "c", "w", "v", 4).collect()}
    best = lambda m: sorted(k for k, v in rows if m is None or v[1] == m)[:4]
    assert got == {(q, c, n + 1) for q, m in (("a", 0.0), ("b", 2.0), ("z", None)) for n, c in enumerate(best(m))}


def test_embedding_of_the_retries_never_cancels_words():
    import re

    from examloom import hooks

    lone = {w: hooks.hash_embedding(w) for w in (f"w{i}" for i in range(400))}
    a, b = next((a, b) for a in lone for b in lone if [-x for x in lone[a]] == lone[b])
    assert not any(hooks.hash_embedding(f"{a} {b}"))
    for text in (f"{a} {b}", "a", "", "-", "жук", "жук 1"):
        assert any(hooks.count_embedding(text)) == bool(re.search(r"\w", text, re.ASCII))


def test_bm25_shuffles_words_by_document_only(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 3 + 1) + f"x{i}") for i in range(20)], "d long, t string")
    queries = spark.createDataFrame([("p", "a x3"), ("q", "b x4 x5")], "q string, t string")
    got = retrieval.bm25_topk(queries, docs, "q", "d", "t", "t", 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(d#" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(" in x and "d#" in x and ("term#" in x or ", d#" in x)]
    assert {(r.q, r.d) for r in got.collect() if r["rank"] == 1} in ({("p", 3), ("q", 4)}, {("p", 3), ("q", 5)})


def test_evaluator_sees_each_distinct_pair_once(spark):
    from examloom import hooks

    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(x):
        calls.add(1)
        return 0.25 * len(x)

    hooks.register_evaluator("counted", lambda p, e: F.struct(score(p).alias("score"), F.lit("x").alias("label")))
    rows = spark.createDataFrame([(["a"],), (["a", "b"],), (None,)] * 50, "p array<string>").where("p IS NOT NULL")
    got = hooks.evaluated_totals(rows, "counted", F.col("p"), F.array(F.lit("a"))).collect()
    assert [tuple(r) for r in got] == [("x", 100, 37.5)] and calls.value <= 4


def test_collection_names_come_from_the_table(spark, tmp_path):
    from examloom.plans.registry import QUERIES

    rows = [(1, [0.0] * 8, 3), (2, [0.0] * 8, 3), (3, [0.0] * 5, 4), (4, None, 5), (5, [0.0] * 2, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.label: (r.name, r["size"]) for r in QUERIES["collection_name"](spark, str(tmp_path)).collect()}
    want = indexing.table_name("fast", {"dense": {"model": "label3", "size": 8}, "sparse": {"model": "bm25"}})
    assert got[3] == (want, 8) and got[4][1] == 5 and got[5] == (None, None) and got[None] == (None, 2)
