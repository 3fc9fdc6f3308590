import pytest
from pyspark.sql import functions as F

from examloom.functions import metrics as M
from examloom.functions import text as X
from examloom.sources import parsers


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("12. The  FUEL pump ( )", "the fuel pump"), ("1.2. x", "2. x"), ("　A b ", "a b"), ("", "")])
def test_normalize(spark, text, want):
    assert one(spark, X.normalize_text(F.lit(text))) == want


@pytest.mark.parametrize(("text", "want"), [(" NULL ", True), ("", True), (None, True), ("none", False)])
def test_null_like(spark, text, want):
    assert one(spark, X.is_null_like(F.lit(text).cast("string"))) is want


@pytest.mark.parametrize(("q", "o", "want"), [("What?", "船舶", "chinese"), ("What?", "船ab", "english"), ("What?", "船a", "mixed"), ("船?", "yes", "chinese")])
def test_language(spark, q, o, want):
    assert one(spark, X.language_of_question(F.lit(q), F.array(F.lit(o)))) == want


def test_leakage(spark):
    assert one(spark, X.answer_leaks(F.lit("What is the safe working load here?"), F.lit("safe working load")))
    assert not one(spark, X.answer_leaks(F.lit("What is oil?"), F.lit("oil")))


def test_images_and_tags(spark):
    html = 'Look <img src="http://a/b.png"> and <70 <b>x</b><img src=null><br/>'
    assert one(spark, X.image_sources(F.lit(html))) == ["http://a/b.png"]
    assert one(spark, X.images_valid(F.lit('<img src="x.png">'))) is False
    assert one(spark, X.strip_tags(F.lit("a <70 <b>x</b>"))) == "a <70 x"


def test_answers_and_ids(spark):
    valid = F.array(*map(F.lit, "ABCD"))
    assert one(spark, X.answer_letters(F.lit("A, b"), valid)) == ["A", "B"]
    assert one(spark, X.answer_letters(F.lit("AC"), valid)) == ["A", "C"]
    assert one(spark, X.answer_letters(F.lit("z"), valid)) == []
    assert one(spark, X.output_ids(F.lit('{"answerId":"B"}'))) == ["B"]
    assert one(spark, X.output_ids(F.lit('{"answerIds":["A","C"]}'))) == ["A", "C"]
    assert one(spark, X.question_number(F.lit("Q007"), F.lit(3))) == "0007"
    assert one(spark, X.question_number(F.lit("x"), F.lit(3))) == "0003"


@pytest.mark.parametrize(("score", "why", "want"), [(0.4, "", "A"), (0.5, "", "A"), (0.6, "", "B"), (0.0, "", "D"), (1.0, "they don't matter", "E"), (1.0, "", "C"), (0.7, "", None), (0.7, "judgment=B", "B")])
def test_legacy_choice(spark, score, why, want):
    assert one(spark, X.legacy_choice(F.lit(score), F.lit(why))) == want


@pytest.mark.parametrize(("p", "e", "want"), [("B", "B", (1, 1, 1, 1)), ("A,B", "B,C", (1, 0.5, 0.5, 0.5)), ("A", "C", (0, 0, 0, 0)), ("", "A", (0, 0, 0, 0)), (" a ,A,b", "A,B", (2, 1, 1, 1)), ("A,Z", "A", (1, 0.5, 1, 2 / 3))])
def test_prf1(spark, p, e, want):
    a, b = F.split(F.lit(p), ","), F.split(F.lit(e), ",")
    got = spark.range(1).select(M.true_positives(a, b), M.precision(a, b), M.recall(a, b), M.f1(a, b)).first()
    assert tuple(got) == pytest.approx(want)


def test_error_scores_zero(spark):
    none = F.lit(None).cast("array<string>")
    assert tuple(one(spark, M.evaluated(M.f1, none, F.array(F.lit("A"))))) == (0.0, "error")


def test_group_label(spark):
    m = '{"model":{"id":"m"},"retrieval":{"limit":5,"collection":"c"},"embeddings":{"dense":{"model":"d"},"sparse":{"model":"s"}},"chunking":{"method":"fast"}}'
    assert one(spark, X.group_label(F.lit(m))) == "m (RAG, k=5, collection=c, d+s, chunking=fast)"
    assert one(spark, X.group_label(F.lit('{"model":{"id":"m"}}'))) == "m"


def test_verdicts(spark):
    assert one(spark, X.duplicate_verdict(F.lit("DUPLICATE\nbecause"))) == "DUPLICATE"
    assert one(spark, X.duplicate_verdict(F.lit("hm\nDIFFERENT"))) == "DIFFERENT"
    assert one(spark, X.duplicate_verdict(F.lit("hm"))) is None
    assert one(spark, X.quality_verdict(F.lit("good: clear"))) == "GOOD"


def test_audit(spark):
    def audit(c, o):
        return one(spark, M.multi_answer_category(F.array(*map(F.lit, c)), F.array(*map(F.lit, o))))

    assert audit("AA", "ABCD") == "garbled"
    assert audit("AB", "AB") == "all_correct"
    assert audit("AB", "ABCD") == "plausible_multi"


def test_roman():
    q = "Which hold? Ⅰ first; Ⅱ second; Ⅲ third。"
    assert parsers.selected_statements("Ⅱ", q) == "second"
    assert parsers.selected_statements("Ⅰ、Ⅲ", q) == "first; third"
    assert parsers.selected_statements("I-III", q) == "first; second; third"
    assert parsers.selected_statements("Ⅳ", q) is None
    assert parsers.selected_statements("plain", q) == "plain"


def test_parsers():
    md = "**1.** Which?\n- A. one\n- B. two\n- C. three\n- D. four\nCorrect answer: B\n2. No answer\n| 3. What | A. | B. | C. | D. | w | x | y | z |\nCorrect answer: D"
    got = parsers.markdown_exam(md)
    assert [(q["number"], q["answer"]) for q in got] == [(1, "B"), (3, "D")]
    assert got[1]["options"] == {"A": "w", "B": "x", "C": "y", "D": "z"}
    key = parsers.key_format("1. What is it? A. a B. b C. c D. d KEY: c why\n2. 同上\n3. No key A. x")
    assert len(key) == 1 and key[0]["answer"] == "C" and key[0]["explanation"] == "why"
    page = '<h3>INLAND ONLY</h3><td colspan="3"><b>What light is shown?</b></td><label><input name="CheckAns" value="A" checked>A. red</label><label><input name="CheckAns" value="B">B. green</label><img src="/logo.gif"><img src="/i.gif">'
    q = parsers.html_question(page, "http://h/")[0]
    assert (q["answer"], q["options"], q["images"], q["explanation"]) == ("A", {"A": "red", "B": "green"}, ["http://h/i.gif"], "inland")
    assert parsers.json_in_text('so {"a": 1} end') == {"a": 1}
    assert parsers.longest_cjk_run(["a", "船舶", "机", "b", "船"]) == "船舶\n机"
    assert parsers.answer_in_stem("1. It is ( B ) here A. x B. y\n")[0]["answer"] == "B"
    assert parsers.answer_table("1. Q one A. x B. y\nAnswers\n1. B")[0]["answer"] == "B"
    assert parsers.marked_option("1. Q one A. x **B. y**\n")[0]["answer"] == "B"
    assert parsers.columns_format("1  What is it  B\nA. x\nB. y\n")[0]["options"] == {"A": "x", "B": "y"}


def test_answers_in_the_stem():
    text = "0001.  D\tare published for the correction of charts. [12]\nA．Charts B．Notices\n译文\nC. Lists D．Notices to Mariners\n0036. Attention is \tD  the advice [3]\nA．x\nB．y\n0002. no answer here\n0040. It is so  C ．\nA. one\n0041. nothing after B ."
    got = parsers.embedded_answer(text)
    assert [(q["number"], q["answer"]) for q in got] == [(1, "D"), (2, "D"), (3, "C")]
    assert got[0]["question"] == "are published for the correction of charts." and got[0]["options"] == {"A": "Charts", "B": "Notices", "C": "Lists", "D": "Notices to Mariners"}
    assert got[1]["question"] == "Attention is ______ the advice" and got[1]["options"] == {"A": "x", "B": "y"}
    assert got[2]["question"] == "It is so ______"
    assert parsers.embedded_answer("") == parsers.embedded_answer("A. x\nB. y") == []


def test_answers_in_blanks():
    text = "head\n0001. The ___B___ of it\n说明\nA．one B．two\nB. again\n0002. none\nA. x\nB. y\n0003. Goes on\nhere __A__ so\nsome x参考C．z A. w\n0004. one option ___A___\nA. x"
    got = parsers.blank_answer(text)
    assert [(q["number"], q["question"], q["answer"], q["options"]) for q in got] == [(1, "The ______ of it", "B", {"A": "one", "B": "two"}), (3, "Goes on here ______ so", "A", {"C": "z", "A": "w"})]


def test_coloured_answers():
    text = '【单选】Which one is it?\nA.red\n<font color="#FF6600">B.green</font>\nC.blue D.none\n【单选】Goes\non [7]\nA.x <font color="FF0000">B</font>.y\n【单选】Beside A.first\nB.second\n<font color="00FF00">C.third</font>\n【单选】no options'
    got = parsers.coloured_answer(text)
    assert [(q["question"], q["answer"], q["options"]) for q in got] == [("Which one is it?", "B", {"A": "red", "B": "green", "C": "blue", "D": "none"}), ("Goes on", "B", {"A": "x", "B": "y"}), ("Beside", "", {"A": "first", "B": "second", "C": "third"})]


def test_two_labels_before_their_texts():
    assert parsers._cells("| A. | B. | one | two | three | four |") == ["A. one", "B. two", "three", "four"]
    assert parsers._cells("| A. | one | B. | two |") == ["A. one", "B. two"]


def test_fnv_hashes_code_units(spark):
    assert one(spark, X.fnv1a(F.lit("a😀b"))) == 2412414209
    assert one(spark, X.fnv1a(F.lit(""))) == 2166136261


def test_retries():
    from examloom import hooks

    waited, left = [], [3]

    def call():
        left[0] -= 1
        if left[0]:
            raise ConnectionError
        return "done"

    assert hooks.with_retries(call, sleep=waited.append) == "done" and waited == [1.0, 2.0]
    left[0] = 9
    with pytest.raises(ConnectionError):
        hooks.with_retries(call, waits=(0.0,), sleep=waited.append)
