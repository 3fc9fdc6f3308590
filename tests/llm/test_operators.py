"""The training-data operators against brute force, round trips and held-out accuracy, with odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from examloom.llm import automaton, bcr, bpe, components, decontaminate, fmindex, langid, licenses, neardup, pages, quality, tokencount

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, __r int"


def corpus(n=60, seed=5):
    """Texts with copies, near copies, shared passages, repeated lines, one long text, and null and empty ones."""
    dice = random.Random(seed)
    vocabulary = ["".join(dice.choice("abcdeéß") for _ in range(dice.randint(2, 8))) for _ in range(400)]
    words = lambda k: [dice.choice(vocabulary) for _ in range(k)]
    passage, period = words(60), words(3) * 30
    texts = [None, "", "   ", "\n", "one", "one two"]
    while len(texts) < n:
        w = words(dice.choice([5, 30, 90, 200]))
        kind = dice.random()
        if kind < 0.2:
            w[len(w) // 2 : len(w) // 2] = [" ".join(passage)]
        elif kind < 0.3:
            w += period
        elif kind < 0.5 and texts[-1]:
            w = texts[-1].split()
            for _ in range(dice.randint(0, 3)):
                if w:
                    w[dice.randrange(len(w))] = dice.choice(vocabulary)
        elif kind < 0.55 and texts[-1]:
            texts.append(texts[-1])
            continue
        texts.append("".join(x + dice.choice([" ", " ", " ", "\n", "  "]) for x in w))
    texts.append(" ".join(words(6000)))
    return texts


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "xy"[i % 2], f"s{i % 3}", None if t is None else len(t), "r", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, texts):
    for r in quality.measures(docs).collect():
        text = texts[r.doc_id] or ""
        w = WORD.findall(text)
        seen = Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        inside = {i for j in range(len(w) - 7) if seen[tuple(w[j : j + 8])] > 1 for i in range(j, j + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < len(texts)


def brute_near(texts, width, percent):
    sets = []
    for t in texts:
        w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = comp[i], comp[j]
                comp = [min(x, y) if c in (x, y) else c for c in comp]
    return sets, comp


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, width, percent):
    sets, comp = brute_near(texts, width, percent)
    got = {r.id: (r.n, r.component) for r in neardup.near_classes(docs, width, percent).collect()}
    assert got == {i: (len(sets[i]), comp[i]) for i in range(len(texts))}


def test_near_odd_rows(spark):
    """Rows without id link others, rows of equal ids are one document; a column's name may clash."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(None, base, 1), (4, base + " x", 2), (9, "y " + base, 3), (9, "quite another text here", 4), (None, "all alone here", 5), (None, "all alone here", 6), (2, None, 7), (7, "", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep int").withColumn("component", F.lit(1))
    got = sorted((r.id is None, r.id or 0, r.n, r.component) for r in neardup.near_classes(df, 3, 85).collect())
    assert got == sorted([(True, 0, 58, 4), (False, 4, 59, 4), (False, 9, 59, 4), (False, 9, 2, 4), (True, 0, 1, None), (True, 0, 1, None), (False, 2, 0, 2), (False, 7, 0, 7)])
    assert neardup.one_of_each(df, 3, 85).columns == df.columns


def test_near_group_with_outliers(spark):
    """One group of many near copies around the threshold, which leaders alone don't settle."""
    dice = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(150):
        w = list(base)
        for _ in range(dice.choice([1, 2, 4, 5, 6, 9])):
            w[dice.randrange(120)] = f"x{dice.randrange(40)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, comp = brute_near(texts, 3, 85)
    assert {r.id: r.component for r in neardup.near_classes(df, 3, 85).collect()} == dict(enumerate(comp))


def test_estimate():
    dice = np.random.RandomState(1)
    every = dice.randint(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    a, b = np.sort(every[:2000]), np.sort(every[500:2500])
    regs = [neardup.sketch(np.zeros(len(x), dtype=np.int64), x, 1) for x in (a, b)]
    j, _ = neardup.estimate(*regs, np.array([2000]), np.array([2000]))
    assert abs(j[0] - 1500 / 2500) < 0.2


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 8), (8, 7), (7, 6), (3, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 6, 9: 6}


def test_construct():
    dice = random.Random(1)
    for _ in range(40):
        strings = [bytes(dice.choice(b"ab\xff\x00") for _ in range(dice.randint(1, 14))) for _ in range(dice.randint(1, 8))]
        owner, length, lcp = bcr.construct(strings, 5)
        suffixes = [strings[a][len(strings[a]) - n :] for a, n in zip(owner.tolist(), length.tolist(), strict=True)]
        assert suffixes == sorted(suffixes)
        for i in range(1, len(suffixes)):
            same = next((k for k, (x, y) in enumerate(zip(suffixes[i], suffixes[i - 1], strict=False)) if x != y), min(len(suffixes[i]), len(suffixes[i - 1])))
            assert min(same, 5) == lcp[i]


def test_passages(docs, texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    want = {}
    for k, x in enumerate(data):
        gone = [False] * len(x)
        for i in range(len(x) - 199):
            if seen[x[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        rest = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[k] = (len(x), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    assert sum(x[1] for x in want.values()) > 0
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bcr.removed(docs).collect()} == want
    cut = bcr.without_repeats(docs)
    assert cut.columns == docs.columns
    for r in cut.collect():
        assert (r.text is None) == (texts[r.doc_id] is None) and (r.text is None or r.n_chars == len(r.text))


def test_words_removed(docs, texts):
    seen, want = set(), {}
    for k, t in enumerate(texts):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        rest = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[k] = (len(w), sum(gone), hashlib.sha256(rest.encode()).hexdigest())
    assert sum(x[1] for x in want.values()) > 0
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in fmindex.removed(docs).collect()} == want


def test_wavelet_matrix():
    x = np.random.RandomState(2).randint(0, 37, 500)
    w = fmindex.WaveletMatrix(x, 37)
    for c in (0, 5, 36):
        at = np.array([0, 1, 63, 64, 65, 250, 500])
        assert w.rank(np.full(len(at), c), at).tolist() == [int((x[:i] == c).sum()) for i in at]


def test_tiles_reordered(spark):
    item = "the quick brown fox jumps over the lazy dog near a river bank while nine grey geese fly south today"
    w = item.split()
    texts = [(1, "intro words here " + item.upper() + "."), (2, " ".join(w[10:]) + " filler stuff " + " ".join(w[:10])), (3, " ".join(w[:6]) + " and nothing else of it"), (4, None), (5, ""), (6, "far too short, indeed"), (7, "我们都喜欢在海边看日出啊")]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame([("7", item), ("8", None), ("9", "Too short"), (None, "喜欢在海边看日出"), ("10", " . ")], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.leaks(df, bench).collect()}
    assert {k: r.item_id for k, r in got.items()} == {1: "7", 2: "7", 6: "9", 7: None} and got[1].coverage == 1.0 and got[2].n_tiles == 2
    clean = decontaminate.without_leaks(df, bench)
    assert {r.doc_id for r in clean.collect()} == {3, 4, 5} and clean.columns == df.columns
    assert decontaminate.leaks(df, bench.limit(0)).count() == decontaminate.leaks(df.limit(0), bench).count() == 0


def plain_coverage(doc, item):
    """Greedy string tiling by comparing all places."""
    a, b, n = [False] * len(doc), [False] * len(item), 0
    while True:
        best, found = 5, []
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best:
                    found.append((j - i, i, j))
        for _, i, j in sorted(found, key=lambda x: (-x[0], x[1])):
            if not any(a[i : i + best]) and not any(b[j : j + best]):
                a[i : i + best] = [True] * best
                b[j : j + best] = [True] * best
                n += best
        if not found:
            return n / len(item)


@pytest.mark.parametrize("most", [decontaminate.HITS, 1])
def test_tiling_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "HITS", most)
    dice = random.Random(12)
    items = [[dice.choice("abcdef") for _ in range(dice.choice([2, 4, 9, 20, 30]))] for _ in range(12)] + [["a"] * 9]
    docs = []
    for _ in range(40):
        w = [dice.choice("abcdefgh") for _ in range(40)]
        for _ in range(3):
            x = dice.choice(items)
            at, cut = dice.randrange(len(w)), dice.randrange(len(x))
            w[at:at] = x[cut:]
        docs.append(w)
    docs.append(["a"] * 300)
    want = {}
    for i, d in enumerate(docs):
        for j, x in enumerate(items):
            c = plain_coverage(d, x) if len(x) >= 5 else float(any(d[k : k + len(x)] == x for k in range(len(d))))
            if c >= 0.5:
                want[i, j] = round(c, 9)
    block = decontaminate.Block(decontaminate.pa.RecordBatch.from_pydict({"t": [" ".join(d) for d in docs]}), "t", lower=True, blank=decontaminate.PARTS, unspaced=True)
    got = {(r, i): round(c, 9) for r, i, c, _, _ in decontaminate.matches(block, decontaminate.Items(list(range(len(items))), [" ".join(x) for x in items]), 0.5) if c >= 0.5}
    assert len(want) > 50 and got == want


def test_automaton():
    words = [(1, 2, 1), (2, 1, 1, 2)]
    a = automaton.SuffixAutomaton(words)
    for w in words:
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                assert a.state(w[i:j])
    with pytest.raises(KeyError):
        a.state((2, 2))


def test_bpe(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.default_path()
    lib = tokenizers.Tokenizer.from_file(path)
    words = bpe.Encoder(bpe.Vocabulary(path)).words
    dice = random.Random(4)
    odd = ["<|startoftext|>hi<|endoftext|>", "a<|ENDOFTEXT|>b", "É é İstanbul ΣΑΣ ς", "don't I'LL we'Ve", "x y　", "船舶 １２３ 12345", "́a b́", "", " ", "👍🏽👍", "aaaaaaaa", "!!!???", "\x1c a"]
    odd += ["".join(dice.choice("aAbthein'sS .é́ <|endoftext>船0\n") for _ in range(dice.randint(1, 60))) for _ in range(1500)]
    for x in odd:
        want = lib.encode(x, add_special_tokens=False)
        ids, text = bpe.encode(x.encode(), words)
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert text.decode() == lib.decode(want.ids, skip_special_tokens=False)
    got = bpe.encoded(docs, path).where("doc_id = 0").first()
    assert (got.n_tokens, got.ids, got.decoded) == (0, [], "")


def test_token_counts(docs, texts):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokencount.default_path()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rest = tokencount.Lengths(open(path, "rb").read())
    dice = random.Random(3)
    for _ in range(4000):
        x = "".join(dice.choice(["a", "the", " ", "  ", "\n", "\t", "é", "船", "<s>", "▁", ".", "\x00"]) for _ in range(dice.randint(0, 12)))
        assert tokencount.tokens(x.encode(), {}, rest) == len(lib.encode(x))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.counts(docs, path).collect()}
    assert got == {i: (len((t or "").encode()), n := len(lib.encode(t or "")), n > 4096) for i, t in enumerate(texts)}


def test_languages(spark):
    dice = random.Random(8)
    sound = {"xx": "ba da ga lo mi", "yy": "stra klem prot vish zun"}
    rows = [(i, " ".join("".join(dice.sample(sound[k].split(), 2)) for _ in range(30)), k) for i in range(120) for k in ("xy"[i % 2] * 2,)]
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 34 !", "yy"), (902, "", None)], "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id < 80"))
    got = {r.doc_id: r for r in langid.predicted(df, model).collect()}
    held = [r for r in rows if r[0] >= 80]
    assert sum(got[i].lang_pred == k for i, _, k in held) >= 0.95 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predicted(df.limit(0), model).count() == 0
    empty = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predicted(df, empty).collect()} == {"und"}


def test_phrases_are_greedy():
    """Against a plain parse by substring search, with large alphabets, unknown letters, and texts of very different lengths."""
    dice = random.Random(6)
    scripts = {"aa": [chr(0x4E00 + i) for i in range(1500)], "bb": [chr(0xAC00 + i) for i in range(1500)], "cc": list("abc ")}
    sample = {k: ["".join(dice.choice(v) for _ in range(dice.choice([5, 400, 3000]))) for _ in range(6)] for k, v in scripts.items()}
    model = langid.Model(sample)
    code = model.codes()
    texts = ["".join(dice.choice(scripts[dice.choice(list(scripts))] + ["д"]) for _ in range(k)) for k in (0, 1, 3)] + ["".join(dice.choice(scripts[k]) for _ in range(n)) for k in scripts for n in [3, 40, 900] * 5 + [20_000]]
    texts += [sample["cc"][0], "дд" + sample["aa"][1]]
    codes = [langid.squeeze(code[np.frombuffer(t.encode("utf-32-le"), "<u4")], np.array([0, len(t)]))[0] for t in texts]
    seen = {k: ["".join(chr(c) for c in langid.squeeze(code[np.frombuffer(t.encode("utf-32-le"), "<u4")], np.array([0, len(t)]))[0]) for t in v] for k, v in sample.items()}
    got = langid.phrases(model, model.steps(), np.concatenate(codes), np.concatenate([[0], np.cumsum([len(c) for c in codes])]))
    for i, c in enumerate(codes):
        t = "".join(map(chr, c.tolist()))
        if len(t) > 2000:
            continue
        for j, lang in enumerate(model.langs):
            at = n = 0
            while at < len(t):
                k = 1
                while at + k < len(t) and any(t[at : at + k + 1] in x for x in seen[lang]):
                    k += 1
                n += 1 if any(t[at : at + k] in x for x in seen[lang]) else 2
                at += k
            assert got[i, j] == n
    assert got[:, :2].max() > 1000
    for k in ("aa", "bb"):
        right = ["".join(dice.choice(scripts[k]) for _ in range(40)) for _ in range(30)]
        codes = [code[np.frombuffer(t.encode("utf-32-le"), "<u4")] for t in right]
        n = langid.phrases(model, model.steps(), np.concatenate(codes), np.arange(31) * 40)
        assert (n.argmin(axis=1) == model.langs.index(k)).all()


def test_licenses(spark):
    notice = licenses.NOTICES["mit"]
    rows = [(1, "Under the MIT License, or the mit-license; Apache License too"), (2, notice.replace("free of charge", "free, of all charge")), (3, "GNU General Public License"), (4, None), (5, ""), (6, "license mit general license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.licenses(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 2, 8, "apache,mit")
    assert got[2].n_base == 0 and got[2].labels == "mit" and 0.6 <= got[2].score < 1
    assert (got[3].base_labels, got[3].first_word) == ("gpl", 1)
    for k in (4, 5, 6):
        assert (got[k].n_base, got[k].first_word, got[k].labels, got[k].score) == (0, None, "", 0.0)


PAGE = "<html><head><title>T</title><style>x{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><main><article><h1>A &amp; B</h1><p>First  <b>bold</b>\n text<p>Second&nbsp;one.<aside><p>Related things</p></aside><form><p>Sign up</p><input></form><p>Third.</p><div class='comments'><h3>Comments</h3><p>Nice article, thank you for it</p></div></article></main><script>var t='</p>';</script><footer>c</footer>"


SENTENCE = "This is one sentence of about eighty seven characters that stands alone in a paragraph."
#: Pages of other makes than the labelled ones.
PLAIN = [
    ("<body><section><h2>Head</h2><p>{s}</p></section></body>", "Head\n{s}"),
    ("<div class='x'><h1>Head</h1><p>{s}</p></div>", "Head\n{s}"),
    ("<div><div><p>{s}</p><p>{s}</p></div></div>", "{s}\n{s}"),
    ("{s} {s}", "{s} {s}"),
    ("<p>Just one.</p>", "Just one."),
    ("<article><p>Just one.</p></article>", "Just one."),
    ("<body><article><header><h1>Title</h1></header><p>{s}</p></article></body>", "Title\n{s}"),
    ("<article><h1>Links</h1><p>{s}</p><ul><li><a href=1>First good link</a></li><li><a href=2>Second good link</a></li></ul><p>{s}</p></article>", "Links\n{s}\nFirst good link\nSecond good link\n{s}"),
    ("<main><h1>T</h1><p>{s}</p></main><div id='comments' class='content'><h3>Comments</h3><p>Nice one, thanks for it.</p></div>", "T\n{s}"),
    ("<main><h1>T</h1><p>{s}</p></main><div class='kommentare'><p>Bob</p><p>Sehr gut, danke.</p></div>", "T\n{s}"),
    ("<table><tr><td><a href=/>Home</a><a href=/n>News</a></td><td><h1>T</h1><p>{s}</p></td></tr></table>", "T\n{s}"),
    ("<article><p>Let <math><mi>x</mi></math> be. {s}</p></article>", "Let x be. {s}"),
    ("<article><p>A. {s}</p><object><p>B. {s}</p></article>", "A. {s}\nB. {s}"),
    ("<article><p>A. {s}</p><svg><svg><text>no</text></svg><text>leak</text></svg><p>B. {s}</p></article>", "A. {s}\nB. {s}"),
    ("<article><p>A. {s}</p><!-- <p>no</p> --><p title='a > b'>B. {s}</p><p>All rights reserved.</p></article>", "A. {s}\nB. {s}\nAll rights reserved."),
]


@pytest.fixture(scope="module")
def model():
    return pages.train()


@pytest.mark.parametrize(("page", "want"), [(PAGE, "A & B\nFirst bold text\nSecond one.\nThird."), ("", ""), ("<", ""), ("<article><p>cut <a href='x", "cut"), ("<body><article><p>One<ul><li>a<li>b</ul></article>", "One\na\nb"), *PLAIN])
def test_pages(model, page, want):
    assert model.extract(page.replace("{s}", SENTENCE)) == want.replace("{s}", SENTENCE)


def test_pages_of_other_makes(model):
    """60 pages whose class names the labelled ones have not, in layouts put together otherwise."""
    dice = random.Random(21)
    word = lambda: "".join(dice.choice("abcdefghijklmnop") for _ in range(dice.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k)).capitalize() + "."
    links = lambda: "".join(f"<li class=zz-item><a href='/{word()}'>{word()}</a></li>" for _ in range(5))
    right = 0
    for _ in range(60):
        blocks = [text(dice.choice([3, 20, 60])) for _ in range(dice.randint(3, 7))]
        body = "".join(f"<p class=zz-par>{b}</p>" if dice.random() < 0.8 else f"<h3>{b}</h3>" for b in blocks)
        core = dice.choice(["<article class=zz-core>{}</article>", "<main><div class=zz-core>{}</div></main>", "<div class=zz-outer><article>{}</article></div>"]).format(body)
        page = f"<html><head><title>x</title></head><body class=zz-page><div class=zz-up><ul>{links()}</ul></div>{core}<aside class=zz-by><h4>Latest</h4><ul>{links()}</ul></aside>"
        page += dice.choice(["", f"<form class=zz-in><p>{text(4)}</p><input><button>Go</button></form>"]) + f"<footer class=zz-low>&copy; 2024 {text(4)}</footer></body></html>"
        right += model.extract(page) == "\n".join(blocks)
    assert right >= 57


@pytest.mark.parametrize("unit", ["<a b='", '<p class="', "<div>", "<b>", "</i>", "<svg>", "<!--", "<i><div></i>", "<td>", "<", "<select><p>x"])
def test_hostile_pages_take_linear_time(model, unit):
    import time

    took = []
    for k in (100_000, 400_000):
        began = time.process_time()
        model.extract(unit * (k // len(unit)))
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.05)


def test_long_and_odd_pages(spark, model):
    long = "<article>" + f"<p>{SENTENCE}</p>" * 50_000 + "</article>"
    rows = [(1, "u", long, "a"), (1, "u", long, "b"), (None, None, None, None), (2, "v", "", "c"), (3, None, "<p>One &lt;two&gt;.</p>", "d")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = pages.main_text(df, model).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, 50_000 * (len(SENTENCE) + 1) - 1), (1, 50_000 * (len(SENTENCE) + 1) - 1), (2, 0), (3, 10)]


def test_marginals_are_exact(model):
    """Sum-product against the sum over all labellings of a small tree."""
    import itertools

    nodes = pages.measured(pages.parse("<div class='content'><p>some text</p><ul class='menu'><li>x</li></ul></div>")[0])
    table = []
    for n in nodes:
        p = [1.0, 1.0, 1.0]
        for f in model.potentials(n):
            p = [a * b for a, b in zip(p, f, strict=True)]
        table.append(p)
    at = {id(n): i for i, n in enumerate(nodes)}
    total = [[0.0] * 3 for _ in nodes]
    for states in itertools.product(range(3), repeat=len(nodes)):
        p = 1.0
        for i, n in enumerate(nodes):
            p *= table[i][states[i]] * (model.edges[states[at[id(n.parent)]]][states[i]] if n.parent else 1.0)
        for i, s in enumerate(states):
            total[i][s] += p
    for got, want in zip(model.marginals(nodes), total, strict=True):
        assert got == pytest.approx([x / sum(want) for x in want])


def test_empty_tables(none, spark):
    assert quality.measures(none).count() == 0
    assert neardup.near_classes(none).count() == 0
    assert bcr.removed(none).count() == 0
    assert fmindex.removed(none).count() == 0
    assert licenses.licenses(none).count() == 0
    assert tokencount.counts(none, tokencount.default_path()).count() == 0
    assert bpe.encoded(none, bpe.default_path()).count() == 0
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long, runs string, copies int"


def odd_rows(spark):
    """Repeated rows, equal ids with other texts, rows without id or text, and columns whose names clash."""
    dice = random.Random(3)
    words = lambda k: " ".join("".join(dice.choice("abcdefgh") for _ in range(5)) for _ in range(k))
    one, two, three = words(80), words(80), words(80)
    rows = [(1, one), (1, one), (1, two), (None, one), (None, three), (None, three), (2, None), (3, ""), (4, words(10) + " " + two[: 5 * 60] + " " + words(10)), (5, words(90))]
    return spark.createDataFrame([(i, t, "xx", "s", None if t is None else len(t), "r", 7) for i, t in rows], ODD).repartition(3), [x[1] for x in rows]


def test_passages_of_odd_rows(spark):
    df, texts = odd_rows(spark)
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    want = Counter()
    for x in data:
        gone = {j for i in range(len(x) - 199) if seen[x[i : i + 200]] > 1 for j in range(i, i + 200)}
        want[len(x), len(gone)] += 1
    assert Counter((r.n_bytes, r.n_removed) for r in bcr.removed(df).collect()) == want
    cut = bcr.without_repeats(df)
    assert cut.columns == df.columns and cut.count() == len(texts)


def test_words_removed_from_odd_rows(spark):
    """Of rows with equal ids and texts one keeps its words; rows without id come last."""
    df, texts = odd_rows(spark)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in fmindex.removed(df).collect()))
    assert [x for x in got if x[:2] == (False, 1)] == [(False, 1, 80, 0), (False, 1, 80, 0), (False, 1, 80, 80)]
    assert [x for x in got if x[0]] == [(True, 0, 80, 0), (True, 0, 80, 80), (True, 0, 80, 80)]
    assert got[3:5] == [(False, 2, 0, 0), (False, 3, 0, 0)] and got[5][3] >= 20 and got[6] == (False, 5, 90, 0)


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_anchors_are_split(docs, texts, monkeypatch, hot):
    """The same results where anchors with few distinct segments count as hot already, and portions are small."""
    from examloom.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "PORTION", 20)
    test_passages(docs, texts)
    test_words_removed(docs, texts)


def test_every_removed_word_comes_from_the_index(docs, monkeypatch):
    """An index that reports nothing leaves every word where it is."""
    assert fmindex.removed(docs).where("n_removed > 0").count() > 0
    blind = lambda columns: iter(())
    monkeypatch.setattr(fmindex, "shard", blind)
    assert fmindex.removed(docs).where("n_removed > 0").count() == 0


def test_statistics_are_matching_statistics():
    """Against the longest repeated word sequences before each end, found by plain search."""
    dice = np.random.RandomState(5)
    text = np.concatenate([np.append(dice.randint(1, 4, 30), 0) for _ in range(6)])
    index = fmindex.FMIndex(text, 4, 6)
    ends = np.array([i + 6 for i in range(len(text) - 6) if 0 not in text[i : i + 6]])
    matched, lo, hi = fmindex.statistics(index, text, ends, 6, np.ones(len(text), dtype=np.int64))
    as_text = "".join(map(str, text.tolist()))
    times = lambda x: sum(as_text.startswith(x, i) for i in range(len(as_text)))
    for e, m, a, b in zip(ends.tolist(), matched.tolist(), lo.tolist(), hi.tolist(), strict=True):
        want = max((k for k in range(7) if times(as_text[e - k : e]) > 1), default=0)
        assert m == want and (m < 6 or b - a == times(as_text[e - 6 : e]))


def test_quality_lines_do_not_collide(spark):
    """Long lines that a polynomial modulo 2**64 can't tell apart."""
    line = "a"
    for _ in range(11):
        line += line.translate({97: 98, 98: 97})
    other = line.translate({97: 98, 98: 97})
    df = spark.createDataFrame([(1, line + "\n" + other), (2, line + "\n" + line), (2, line + "\n" + line), (None, None)], "doc_id long, text string").withColumn("kept", F.lit("x"))
    assert sorted((r.n_dup_lines, r.n_words) for r in quality.measures(df).collect()) == [(0, 0), (0, 2), (1, 2), (1, 2)]
    assert quality.keep_good(df).columns == df.columns


def test_licenses_of_odd_rows(spark):
    rows = [(1, "under the mit license here"), (1, "under the mit license here"), (None, "mit license"), (2, "x"), (2, "apache license"), (None, None), (3, "word " * 30_000 + "general public license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS h", "2 AS th", "3 AS id", "4 AS key")
    got = Counter((r.doc_id or 0, r.n_base, r.base_labels, r.first_word) for r in licenses.licenses(df).collect())
    assert got == Counter([(1, 1, "mit", 2), (1, 1, "mit", 2), (0, 1, "mit", 0), (2, 0, "", None), (2, 1, "apache", 0), (0, 0, "", None), (3, 1, "gpl", 30_000)])


def test_caches_stay_small():
    from examloom.llm.blocks import Recent

    cache = Recent(100_000, lambda k: k * 2, lambda k, got: len(k) + len(got))
    for i in range(5000):
        assert cache[f"{i}".encode()] == f"{i}".encode() * 2
    assert len(cache) + len(cache.old) <= 2 * 100_000 // Recent.ENTRY
    assert cache[b"x" * 10_000] == b"x" * 20_000 and b"x" * 10_000 not in cache


def test_op_queries_against_sql(spark):
    """The registered queries with SQL, on the smallest tables."""
    import duckdb

    from examloom.llm.registry import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    flat = lambda v: round(v, 9) if isinstance(v, float) else v
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, d)
        cols = sorted(df.columns)
        cur = con.execute(sql)
        at = [[x[0] for x in cur.description].index(c) for c in cols]
        assert Counter(tuple(flat(r[c]) for c in cols) for r in df.collect()) == Counter(tuple(flat(r[i]) for i in at) for r in cur.fetchall()), name


def test_op_queries_without_sql(spark):
    """The other registered queries run over their whole tables and return a row for every row (decontamination: for every pair)."""
    from examloom.llm.registry import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    docs, pages_ = spark.read.parquet(f"{d}/documents.parquet").count(), spark.read.parquet(f"{d}/pages.parquet").count()
    for name in QUERIES.keys() - ORACLE_SQL.keys():
        n = QUERIES[name](spark, d).count()
        assert n == (pages_ if name.startswith("op2") else docs) or name.startswith("op1_") and n > 0


def test_stages_on_odd_rows(spark):
    """Every stage by itself: rows without text or id, repeated rows, clashing columns, and an empty table."""
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    df, texts = odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, df, d), stage(spark, df.limit(0), d)
        assert none.count() == 0 and none.columns == out.columns
        if name == "encoding":
            assert out.columns == ["doc_id", "n_tokens", "ids"] and out.count() == len(texts)
        else:
            assert out.columns == df.columns and 0 < out.count() <= len(texts)
    kept = corpus_pipeline.passage_dedup(spark, df, d)
    assert all((r.text is None and r.n_chars is None) or len(r.text) == r.n_chars for r in kept.collect())


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, d)
    one = corpus_pipeline.near_dedup(spark, good, d)
    sets, comp = brute_near([r.text for r in good.orderBy("doc_id").collect()], 5, 80)
    assert one.count() == len(set(comp))
    assert good.columns == one.columns == docs.columns
    out = corpus_pipeline.run(spark, d)
    assert 0 < out.count() <= one.count() and out.columns == ["doc_id", "n_tokens", "ids"]
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
