"""Queries do the whole job: no pair, member or text is left out."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from examloom.functions import text as X
from examloom.operators import leakage, similarity
from examloom.plans.registry import ORACLE_SQL, QUERIES


def tables(spark, folder, **rows):
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_leakage_of_unequal_residues(spark, tmp_path):
    docs = [(1, "Some words before. The quick brown fox jumps, and so on."), (2, "nothing of it"), (41, None)]
    d = tables(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=([(7, "the quick brown fox jumps"), (8, "unrelated words altogether here")], "item_id long, text string"))
    assert [(r.item_id, r.doc_id, r.leak) for r in QUERIES["answer_leakage"](spark, d).collect()] == [(7, 1, True)]


def test_leakage_equals_all_pairs(spark):
    dice = random.Random(5)
    words = ["the", "of", "ab", "alpha", "beta", "gamma", "delta", "epsilon", "zeta", "extraordinary", "ñandú", "船舶安全管理规定第一条"]
    text = lambda least, most: " ".join(dice.choice(words) + dice.choice(["", "", ",", "."]) for _ in range(dice.randint(least, most)))
    docs = spark.createDataFrame([(i, text(0, 14)) for i in range(120)] + [(None, "alpha beta gamma delta"), (500, "xextraordinary alphas")], "doc_id long, text string")
    items = spark.createDataFrame([(i, text(0, 7)) for i in range(80)] + [(100, "extraordinary"), (101, "ordinary alpha"), (102, "..."), (103, None)], "item_id long, answer string")
    want = docs.crossJoin(items).where(X.answer_leaks("text", "answer")).select("item_id", "doc_id")
    order = lambda df: sorted(map(repr, df.collect()))
    assert want.count() > 100
    for block_words in (1_000_000, 50):
        assert order(leakage.leaking_pairs(docs, items, "doc_id", "item_id", "text", "answer", block_words)) == order(want)


def test_maxsim_scores_all_groups(spark, tmp_path):
    dice = random.Random(3)
    vectors = [(i, [dice.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(203)]
    d = tables(spark, tmp_path, embeddings=(vectors, "vec_id long, embedding array<float>"))
    late = {}
    for i, v in vectors:
        late.setdefault(i // 5, []).append(v)
    score = lambda q, c: sum(max(sum(x * y for x, y in zip(a, b, strict=True)) for b in late[c]) for a in late[q])
    want = {q: sorted((-score(q, c), c) for c in late)[:5] for q in late if q % 20 == 0}
    got = {}
    for r in QUERIES["maxsim_rerank"](spark, d).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append((-r.score, r.c_id))
    assert got == want and any(c % 4 != q // 20 % 4 for q in want for _, c in want[q])


def test_nearest_late_in_blocks(spark):
    dice = random.Random(4)
    rows = spark.createDataFrame([(i, [[dice.choice([0.0, 1.0]) for _ in range(3)] for _ in range(dice.randint(0, 4))]) for i in range(60)], "g long, late array<array<double>>")
    q, c = rows.withColumnRenamed("g", "q"), rows.withColumnRenamed("g", "c")
    whole = sorted(map(tuple, similarity.nearest_late(q, c, "q", "c", "late", "late", 3).collect()))
    assert whole == sorted(map(tuple, similarity.nearest_late(q, c, "q", "c", "late", "late", 3, block=7).collect())) and len(whole) > 100


def test_keyed_sets_have_all_members(spark, tmp_path):
    d = tables(spark, tmp_path, events=([("a", 50), ("a", 7), ("b", 3), ("a", 7)], "event_type string, user_id long"))
    assert {r.event_type: r.users for r in QUERIES["keyed_set_upsert"](spark, d).collect()} == {"a": [7, 50], "b": [3]}


MARKS = r"""Line one & <b>two</b> &amp; "x" 'y'. In 1990. The C. next (B) of A) \\ \. 3\n\n2. Second [12] * 4 + **7.** x
| A. | B. | one | two |\n<!-- page 4 --> {5}------------ Correct answer: C KEY: A D．z A、w ñA. q 同上""".replace("\\n", "\n")


@pytest.mark.parametrize("name", ["html_page_extract", "markdown_exam_parse", "key_format_parse"])
def test_parsers_get_whole_texts(spark, tmp_path, name):
    docs = [(1, MARKS), (2, "word " * 30000 + "end of it"), (3, None)]
    quiz = '<h3>Inland Only</h3><td colspan="3"><b>Which of these holds?</b></td><label><input value="A" checked>A. yes</label>'
    d = tables(spark, tmp_path, documents=(docs, "doc_id long, text string"), pages=([(9, quiz), (8, "<p>nothing</p>")], "page_id long, html string"))
    rows = QUERIES[name](spark, d).collect()
    head = "" if name == "html_page_extract" else "Q "
    assert {r.doc_id: r.question for r in rows if r.doc_id} == {i: head + " ".join(t.split()) for i, t in docs if t}
    assert all(r.answer == {"html_page_extract": "A", "markdown_exam_parse": "B", "key_format_parse": "C"}[name] and r.number == 1 for r in rows)
    if name == "html_page_extract":
        assert [(r.page_id, r.question) for r in rows if r.doc_id is None] == [(9, "Which of these holds?")]


@pytest.mark.parametrize("name", ["key_format_parse", "questions_table_function"])
def test_key_questions_of_texts_without_words_and_of_new_digits(spark, tmp_path, name):
    docs = [(1, ""), (2, " \n\u3000"), (3, "[\U00011f50] one * \U00011f50 + two"), (4, None), (5, "A."), (6, "\uffff \\ Question")]
    d = tables(spark, tmp_path, documents=(docs, "doc_id long, text string"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    df = QUERIES[name](spark, d)
    rows = sorted(map(tuple, df.collect()))
    assert rows == sorted(duck.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall())
    assert [r[2] for r in rows] == ["Q", "Q", f"Q {docs[2][1]}", "Q A.", "Q \uffff \\ Question"]
