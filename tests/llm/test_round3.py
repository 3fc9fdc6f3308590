"""SimHash classes, hard negatives and the Merkle manifest against brute force, with odd rows."""

import collections
import hashlib
import itertools
import pickle
import random
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from examloom.llm import anchors, bcr, bpe, decontaminate, fmindex, hardneg, langid, merkle, neardup, repeats, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, start string, id string, g string"


def rows_of(texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    return [(i, t, "xy"[k % 2] if k % 5 else None, sources[k] if sources else f"s{k % 3}", None if t is None else len(t), k, "a", "b", "c") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


# SimHash


def plain_fingerprint(text):
    words = [] if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(ids, fps, radius):
    part = list(range(len(fps)))
    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius and part[i] != part[j]:
            old, new = part[j], part[i]
            part = [new if p == old else p for p in part]
    least = {}
    for i, p in zip(ids, part, strict=True):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    return [least.get(p) for p in part]


def near_copies(n=120, seed=3):
    dice = random.Random(seed)
    vocabulary = ["".join(dice.choice("abcdeéßZ") for _ in range(dice.randint(2, 8))) for _ in range(300)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a b c d"]
    while len(texts) < n:
        if dice.random() < 0.6 and len(texts) > 10:
            w = (texts[dice.randrange(7, len(texts))] or "x").split()
            for _ in range(dice.randint(0, 2)):
                w[dice.randrange(len(w))] = dice.choice(vocabulary)
        else:
            w = [dice.choice(vocabulary) for _ in range(dice.choice([6, 40, 200, 400]))]
        texts.append(dice.choice([" ", "\n", "\x0b "]).join(w))
    return texts + [" ".join(dice.choice(vocabulary) for _ in range(70_000))]


def test_simhash_equals_brute_force(spark):
    texts = near_copies()
    ids = [i if i % 11 else None for i in range(len(texts))]
    ids[20] = ids[21] = 5
    docs = spark.createDataFrame(rows_of(texts, ids), DOCS).repartition(3)
    fps = [plain_fingerprint(t) for t in texts]
    got = sorted((r.id if r.id is not None else -1, r.fp & ((1 << 64) - 1), r.component if r.component is not None else -1) for r in simhash.near_classes(docs).collect())
    want = sorted((i if i is not None else -1, f, c if c is not None else -1) for i, f, c in zip(ids, fps, plain_classes(ids, fps, 4), strict=True))
    assert got == want
    assert len({c for _, _, c in want}) < len(set(fps))


@pytest.mark.parametrize(("variants", "most"), [(1 << 40, 1 << 40), (1 << 12, 1 << 16), (1 << 14, 2500)])
def test_starts_of_any_length_find_all_links(spark, variants, most):
    dice = np.random.default_rng(7)
    base = dice.integers(0, 1 << 63, size=60, dtype=np.uint64)
    # One ball holds a third of all fingerprints: its starts are made longer.
    near = [int(base[0]) ^ sum(1 << int(b) for b in dice.choice(64, size=dice.integers(1, 5), replace=False)) for _ in range(60)]
    near += [int(base[i]) ^ sum(1 << int(b) for b in dice.choice(64, size=4, replace=False)) for i in range(1, 30)]
    fps = sorted({*map(int, base), *near})
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges = [(a & ((1 << 64) - 1), b & ((1 << 64) - 1)) for a, b in simhash.links(df, 4, variants, most).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in edges)
    at = {f: i for i, f in enumerate(fps)}
    part = list(range(len(fps)))
    for a, b in edges:
        old, new = part[at[b]], part[at[a]]
        part = [new if p == old else p for p in part]
    want = plain_classes(range(len(fps)), fps, 4)
    assert len({*zip(part, want, strict=True)}) == len(set(part)) == len(set(want))


def test_each_start_has_all_its_variants():
    # Every variant of a fingerprint belongs to exactly one of its starts.
    for bits in (0, 5, 64):
        rest = 64 - bits
        made = sum(len(simhash.flips(rest, 2 - int(k).bit_count())) for k in simhash.flips(bits, 2))
        assert made == len(simhash.flips(64, 2)) == 2081


def test_simhash_of_no_rows(spark):
    assert simhash.near_classes(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        simhash.near_classes(spark.createDataFrame([], DOCS), radius=3)


# Hard negatives


def plain_negatives(rows, every, change=lambda i, label: label):
    seen, part = set(), []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        x = [int(np.floor(256 * x)) for x in v]
        row = (i, change(i, label), tuple(x))
        if row not in seen:
            seen.add(row)
            part.append(row)
    out = []
    for a in part:
        if a[0] is None or a[0] % every:
            continue
        score = lambda r: sum(p * q for p, q in zip(a[2], r[2], strict=False))  # noqa: B023, E731
        by = lambda r: (-score(r), r[0] is None, r[0] or 0)  # noqa: B023, E731
        for p in sorted((r for r in part if r is not a and r[1] == a[1]), key=by)[:5]:
            ps = score(p)
            good = sorted((r for r in part if r[1] != a[1] and 50 * ps <= 100 * score(r) <= 95 * ps), key=by)[:3]
            out += [(a[0], p[0], k + 1, r[0], ps, score(r)) for k, r in enumerate(good)]
    return sorted(out, key=repr)


def clustered(n=400, seed=2):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(12, 8))
    rows = []
    for i in range(n):
        x = centres[i % 12 if i % 3 else 0] + dice.normal(size=8) * 0.3
        rows.append((i, [float(np.float32(t)) for t in x], i // 3 % 4 if i % 5 else int(dice.integers(0, 4))))
    rows += [(1000 + i, rows[5][1], 1) for i in range(150)]  # one vector that many rows share
    rows += [rows[0], rows[10], rows[10]]
    rows += [(2000, None, 1), (2010, [1.0, None] + [0.0] * 6, 1), (2020, [float("nan")] * 8, 2), (2030, [float("inf")] * 8, 2), (2040, [0.5] * 8, None), (2050, [0.0] * 8, 3), (2060, [1.0] * 3, 2), (2070, [], 1)]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, v int, rk int, g string, cell string"


@pytest.mark.parametrize(("pivots", "sample", "group", "chunk"), [(1024, 2048, 512, 8192), (40, 250, 4, 50), (3, 1, 1000, 7)])
def test_negatives_equal_brute_force(spark, pivots, sample, group, chunk):
    rows = clustered()
    df = spark.createDataFrame([(*r, 1, 2, "g", "c") for r in rows], VECTORS).repartition(4)
    counted = []
    got = hardneg.hard_negatives(df, 10, change=lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label), pivots=pivots, sample=sample, group=group, chunk=chunk, counted=counted)
    want = plain_negatives([(r[0], None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]], r[2]) for r in rows], 10, lambda i, label: (label + 1) % 10 if i % 7 == 0 else label)
    assert sorted(map(tuple, got.collect()), key=repr) == want and want


def test_bounds_spare_rows_most_groups(spark):
    dice = np.random.default_rng(8)
    x = dice.normal(size=(12, 16))[np.arange(720) % 12] + dice.normal(size=(720, 16)) * 0.25
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, [float(np.float32(t)) for t in v], int(i // 12 % 3)) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 1, 2, "g", "c") for r in rows], VECTORS)
    counted = []
    got = hardneg.hard_negatives(df, 10, sample=300, group=5, counted=counted)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_negatives(rows, 10)
    assert counted[1] > 5 and counted[0] < 0.4 * counted[1] * len(rows)


def test_negatives_of_large_numbers_and_odd_tables(spark):
    dice = np.random.default_rng(4)
    rows = [(i, [float(x) for x in dice.integers(-(1 << 19), 1 << 19, size=6)], i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hardneg.hard_negatives(df, 10).collect()), key=repr) == plain_negatives(rows, 10)
    assert hardneg.hard_negatives(df.where("vec_id % 10 <> 0"), 10).collect() == []
    assert hardneg.hard_negatives(df.limit(0), 10).collect() == []
    nameless = df.withColumn("vec_id", F.when(F.col("vec_id") % 3 > 0, F.col("vec_id")).when(F.col("vec_id") == 30, 30))
    got = sorted(map(tuple, hardneg.hard_negatives(nameless, 10).collect()), key=repr)
    assert got == plain_negatives([(i if i % 3 else (30 if i == 30 else None), v, y) for i, v, y in rows], 10) and any(r[1] is None or r[3] is None for r in got)


# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, lower):
    def leaf(i, source, lang, n, text):
        return sha(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))

    def climb(nodes):
        """Root, and of each node its siblings before and after by level."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for k, path in enumerate(paths):
                run = at[k] // 16 * 16
                path.append(("".join(level[run : at[k]]), "".join(level[at[k] + 1 : run + 16])))
                at[k] //= 16
            level = [sha(*level[j : j + 16]) for j in range(0, len(level), 16)]
        return (level[0] if level else None), paths

    by_source = {}
    for i, text, lang, source, n in rows:
        shown = text
        if text is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0:
            shown = lower(text)
        by_source.setdefault(source, []).append((i, leaf(i, source, lang, n, text), leaf(i, source, lang, n, shown)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = climb([r[1] for r in by_source[s]])
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (i, own, shown), path in zip(by_source[s], trees[s][1], strict=True):
            folded = shown
            for pre, post in path + top:
                folded = sha(pre, folded, post)
            out.append((i, own, trees[s][0], root, sha(*(x for p in path + top for x in p)), folded, folded == root))
    return sorted(out, key=repr)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("sizes", [[1], [16], [17, 1, 2], [300, 257, 256, 15], [1] * 20, [4, 33] * 140])
def test_manifest_equals_brute_force(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "WANTED", 3)  # so that nodes at the top have copies
    dice = random.Random(9)
    sources = [None, "", "Ä", "a", "Z", "z b"] + [f"s{k}" for k in range(len(sizes))]
    rows = []
    for k, n in enumerate(sizes):
        for _ in range(n):
            text = dice.choice([None, "", "Some Text", "lower only", "ÄÖ 漢字 ABC", "x" * 300])
            rows.append((len(rows) * 3, text, dice.choice([None, "en"]), sources[k], dice.choice([None, 5, -1])))
    rows += [rows[0], (rows[0][0], "Other", None, rows[0][3], 1), (None, "T", "en", rows[0][3], 1), (None, None, None, rows[0][3], None)]
    df = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], DOCS).repartition(4)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    got = merkle.manifest(df, tampered={"text": F.when(hit, F.translate("text", merkle.UPPER, merkle.LOWER)).otherwise(F.col("text"))})
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows, lowered)


def test_manifest_of_no_rows_and_of_untouched_ones(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []
    some = merkle.manifest(spark.createDataFrame(rows_of(["A", "b", None] * 20), DOCS)).collect()
    assert len(some) == 60 and all(r.verified for r in some)


def test_one_source_with_most_rows_is_ranked_in_many_tasks(spark):
    df = spark.range(5000).select(F.lit("one").alias("g"), (F.col("id") % 2).alias("k"))
    got = merkle.ranked(df, "g", ["k"])
    assert sorted(r.idx for r in got.collect()) == list(range(5000))
    assert got.where("k = 0").agg(F.max("idx")).first()[0] < got.where("k = 1").agg(F.min("idx")).first()[0]


# Rows that are equal, and texts that repeat themselves


def test_one_row_of_each_class_whatever_its_id(spark):
    t, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"z{i}" for i in range(40))
    rows = [(1, t), (1, t), (None, t), (None, t), (9, t + " x"), (9, other), (None, None), (3, ""), (3, ""), (None, "alone here"), (None, "alone here")]
    df = spark.createDataFrame([(*r, "a", k) for k, r in enumerate(rows)], "doc_id long, text string, component string, row int").repartition(3)
    got = neardup.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect()), key=repr) == sorted([(1, t), (9, other), (0, ""), (3, ""), (3, ""), (0, "alone here")], key=repr)


def test_many_equal_rows_have_their_segments_once(spark):
    dice = random.Random(1)
    text = " ".join("".join(dice.choice("abcdefg") for _ in range(6)) for _ in range(400))
    df = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    began = time.time()
    assert bcr.repeats(df).select(F.size("runs").alias("n")).first().n < 100
    assert fmindex.repeats(df).select(F.size("runs").alias("n")).where("n >= 200").isEmpty()
    kept = fmindex.removed(df)
    assert kept.count() == 3000 and kept.where("n_removed = 0").count() == 1
    assert time.time() - began < 120


def test_intervals_decide_by_weight():
    """A segment that stands alone in its shard but occurs twice is covered by the interval's weight, not by its number."""
    words = np.arange(1, 26, dtype=np.uint64).tobytes()
    for n in (1, 2):
        columns = {"content": [words], "n": [n], "id": [1], "th": [2], "s": [0]}
        assert bool(list(fmindex.shard(columns))) == (n == 2)


def test_tiling_of_texts_that_repeat_themselves():
    items = decontaminate.Items([0, 1], ["zero " * 400, "one two " * 100])
    block = decontaminate.Block(decontaminate.pa.RecordBatch.from_pydict({"t": ["zero " * 160_000, "one two three " * 40 + "one two " * 30_000]}), "t", lower=True, blank=decontaminate.PARTS, unspaced=True)
    tracemalloc.start()
    began = time.time()
    got = decontaminate.matches(block, items, 0.5)
    took, most = time.time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((r, i, c) for r, i, c, _, _ in got) == [(0, 0, 1.0), (1, 1, 1.0)]
    assert took < 20 and most < 300e6


def test_long_tiles_are_the_tiles_of_all_places():
    dice = random.Random(6)
    for _ in range(300):
        a, b = ([dice.choice([1, 1, 2, 3]) for _ in range(dice.randint(0, 60))] for _ in range(2))
        if a and dice.random() < 0.5:
            b[len(b) // 2 : len(b) // 2] = a[: dice.randint(0, len(a))]
        x, y = np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)
        p, q = (np.array(z, dtype=np.int64) for z in zip(*[(i, j) for i in range(len(a) - 4) for j in range(len(b) - 4) if a[i : i + 5] == b[j : j + 5]], strict=True)) if any(a[i : i + 5] == b[j : j + 5] for i in range(len(a) - 4) for j in range(len(b) - 4)) else (np.zeros(0, dtype=np.int64),) * 2
        assert decontaminate.long_tiles(x, y) == decontaminate.tiles(p, q, len(b))


# Pages: lists in lists, comments and boxes inside articles

S1 = "The harbour master wrote down every ship that came in during the long winter of that year."
S2 = "Nobody at the station could say for certain when the old line had last been used by trains."
S3 = "A second survey of the coast was made in spring, and it found the same shallow channels again."
REPLY = "I was there too and loved it."


def around(body):
    return f"<html><head><title>t</title></head><body><header><a href=/>Site</a><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav></header>{body}<footer><p>© 2024 Site</p></footer></body></html>"


def article(inside, tag="article"):
    return around(f"<{tag}><h1>Head line</h1><p>{S1}</p><p>{S2}</p>{inside}</{tag}>")


PAGES = [
    (around(f"<article><h1>Title of it</h1><p>{S1}</p><ul><li>one<ul><li>two</li></ul></li><li>three</li></ul><p>{S2}</p></article>"), f"Title of it\n{S1}\none\ntwo\nthree\n{S2}"),
    ("<article><ul><li>one<ul><li>two</li></ul></li><li>three</li></ul></article>", "one\ntwo\nthree"),
    (around(f"<article><p>{S1}</p><ol><li>{S2}<ul><li>{S3}</li></ul></li><li>Next step.</li></ol></article>"), f"{S1}\n{S2}\n{S3}\nNext step."),
    (around(f"<main><h1>How to</h1><p>{S1}</p><ul><li>First<ul><li>Second<ul><li>Third</li></ul></li></ul></li></ul></main>"), f"How to\n{S1}\nFirst\nSecond\nThird"),
    (article(f"<div id='comments' class='content'><h3>2 Comments</h3><div><b>ann</b><p>{REPLY}</p></div><div><b>bob</b><p>Great piece, thank you.</p></div></div>"), f"Head line\n{S1}\n{S2}"),
    (article("<section><h2>Related stories</h2><ul><li><a href=/x>Other story of the day</a></li><li><a href=/y>Another story told</a></li></ul></section>", "main"), f"Head line\n{S1}\n{S2}"),
    (article(f"<div>Advertisement</div><p>{S3}</p>"), f"Head line\n{S1}\n{S2}\n{S3}"),
    (article(f"<div class='signup'><p>Get our best stories in your inbox every week.</p></div><p>{S3}</p>"), f"Head line\n{S1}\n{S2}\n{S3}"),
    (article("<div>Share on Facebook</div>"), f"Head line\n{S1}\n{S2}"),
    (article("<div><h3>You may also like</h3><ul><li><a href=/x>Other story of the day</a></li></ul></div>"), f"Head line\n{S1}\n{S2}"),
    (around(f"<article><h1>Comments on a law</h1><p>{S1}</p><h2>Comments</h2><p>{S2}</p></article>"), f"Comments on a law\n{S1}\nComments\n{S2}"),
]


@pytest.fixture(scope="module")
def reader():
    from examloom.llm import pages

    return pages.train()


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_lists_comments_and_boxes(reader, page, want):
    assert reader.extract(page) == want


def test_pages_of_other_makes(reader):
    made = []
    for tag, mark in itertools.product(["div", "section", "ul", "aside"], ["id=comments class=content", "class=comments", "class='comment-list'", "id=discussion"]):
        reply = f"<li><p>ann</p><p>{REPLY}</p></li>" if tag == "ul" else f"<h3>Comments</h3><div><b>ann</b><p>{REPLY}</p></div>"
        made += [(article(f"<{tag} {mark}>{reply}</{tag}>", core), [S1, S2], [REPLY, "ann"]) for core in ("article", "main")]
    for tag, said in itertools.product(["div", "section", "aside"], ["Related articles", "Read more", "Mehr zum Thema"]):
        made.append((article(f"<{tag}><h3>{said}</h3><ul><li><a href=/x>Other story of the day</a></li><li><a href=/y>One more of them</a></li></ul></{tag}>"), [S1, S2], [said, "Other story of the day"]))
    for tag, mark in itertools.product(["div", "section"], ["newsletter", "subscribe", "ad", "sponsored", "share"]):
        made.append((article(f"<{tag} class={mark}><p>Have all of it in your box each week.</p></{tag}><p>{S3}</p>"), [S1, S2, S3], ["Have all of it in your box each week."]))
    for outer, inner in itertools.product(["ul", "ol"], repeat=2):
        made += [(article(f"<{outer}><li>{a}<{inner}><li>{b}</li><li>{c}</li></{inner}></li></{outer}>", core), [S1, S2, a, b, c], []) for core in ("article", "main") for a, b, c in [("alpha", "beta", "gamma"), (S3, "beta", "gamma")]]
    wrong = [(keep, drop) for page, keep, drop in made if not set(keep) <= set(got := reader.extract(page).split("\n")) or set(drop) & set(got)]
    assert len(made) >= 60 and len(wrong) <= 0.05 * len(made), wrong


def test_counts_do_not_depend_on_the_sample(spark, monkeypatch):
    from examloom.llm import tokencount

    docs = spark.createDataFrame([(i, f"some words {i} and  more\nof them " * (i % 5)) for i in range(60)], "doc_id long, text string")
    frequent = tokencount.frequent_pretokens
    got = []
    for choose in (frequent, lambda d, text: frequent(d, text, rows=1), lambda d, text: []):
        monkeypatch.setattr(tokencount, "frequent_pretokens", choose)
        got.append(sorted(tuple(r) for r in tokencount.counts(docs, tokencount.default_path()).collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 60


def test_parts_of_hot_anchors_are_few(spark, monkeypatch):
    """A segment of a hot anchor makes a few rows, not one for each of its windows."""
    dice = random.Random(11)
    words = lambda k: " ".join("".join(dice.choice("abcdefgh") for _ in range(7)) for _ in range(k))
    passage, made = words(60), []
    texts = [f"{words(40)} {passage} {words(40)}" for _ in range(120)]

    def counted(df, name, stored=repeats.stored):
        out = stored(df, name)
        if name in ("windows", "parts"):
            made.append(out.count())
        return out

    monkeypatch.setattr(repeats, "stored", counted)
    monkeypatch.setattr(repeats, "HOT", 30)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data = [t.encode() for t in texts]
    seen = collections.Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
    want = {k: len({j for i in range(len(x) - 199) if seen[x[i : i + 200]] > 1 for j in range(i, i + 200)}) for k, x in enumerate(data)}
    assert {r.doc_id: r.n_removed for r in bcr.removed(df).collect()} == want
    assert made and sum(made) < 120 * 40


def test_hot_anchors_are_split_by_distinct_segments(spark, monkeypatch):
    """However often the segments of a hot anchor occur, they are split once, and the documents are read once for all rounds."""
    dice = random.Random(12)
    words = lambda k: " ".join("".join(dice.choice("abcdefgh") for _ in range(7)) for _ in range(k))
    passage, made = words(60), []
    texts = [f"{words(40)} {passage} {words(40)}" for _ in range(40)]

    def counted(df, name, stored=repeats.stored):
        out = stored(df, name)
        made.append((name, out.count() if name == "parts" else 0))
        return out

    monkeypatch.setattr(repeats, "stored", counted)
    monkeypatch.setattr(repeats, "HOT", 5)
    parts = []
    for some in (texts, texts + texts[:20] + texts[:20]):
        made.clear()
        df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
        data = [t.encode() for t in some]
        seen = collections.Counter(x[i : i + 200] for x in data for i in range(len(x) - 199))
        want = {k: len({j for i in range(len(x) - 199) if seen[x[i : i + 200]] > 1 for j in range(i, i + 200)}) for k, x in enumerate(data)}
        assert {r.doc_id: r.n_removed for r in bcr.removed(df).collect()} == want
        parts.append([n for name, n in made if name == "parts"])
        assert [name for name, _ in made].count("contents") == 1
    assert len(parts[0]) > 1 and parts[0] == parts[1]


def test_pairs_of_outliers_are_bounded_by_place(spark, monkeypatch):
    """Sets that share an item late in their order, and little with the leader, make no pair."""
    dice = random.Random(4)
    texts = []
    for _ in range(250):
        w = [f"w{i}" for i in range(120)]
        for _ in range(dice.randint(3, 9)):
            w[dice.randrange(120)] = f"x{dice.randrange(8)}"
        texts.append(" ".join(w))
    table, total = neardup._likely, spark.sparkContext.accumulator(0)

    def counted(share):
        run = table(share)

        def each(batches):
            for batch in batches:
                total.add(batch.num_rows)
                yield from run(iter([batch]))

        return each

    monkeypatch.setattr(neardup, "_likely", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component for r in neardup.near_classes(df, 3, 85).collect()}
    sets = [{tuple(t.split()[i : i + 3]) for i in range(118)} for t in texts]
    part = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if part[i] != part[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
            old, new = max(part[i], part[j]), min(part[i], part[j])
            part = [new if p == old else p for p in part]
    assert got == dict(enumerate(part))
    assert 0 < total.value < 40_000  # without the bound 104,354


def test_construction_keeps_its_files_open(monkeypatch):
    """Four files in all, whatever the number of rounds; chunks of any size give the same rows."""
    opened = []
    monkeypatch.setattr(bcr, "open", lambda *x, **k: opened.append(x) or open(*x, **k), raising=False)
    dice = random.Random(2)
    strings = [bytes(dice.choice(b"ab") for _ in range(dice.randint(1, 60))) for _ in range(40)]
    want = bcr.construct(strings, 20)
    assert len(opened) == 4
    suffixes = [strings[k][len(strings[k]) - n :] for k, n in zip(want[0].tolist(), want[1].tolist(), strict=True)]
    assert suffixes == sorted(suffixes)
    monkeypatch.setattr(bcr, "CHUNK", 37)
    assert all((x == y).all() for x, y in zip(want, bcr.construct(strings, 20), strict=True))


def test_covered_units_of_a_block():
    """Runs of texts end to end, with null and empty lists, runs beyond a text's end, and a slice of a column."""
    kind = pa.list_(pa.struct([("s", pa.int32()), ("cover", pa.list_(pa.int32()))]))
    runs = [[{"s": 0, "cover": [0, 9]}], None, [{"s": 2, "cover": [0, 2, 3, 9]}, {"s": 0, "cover": [1, 3]}], [], [{"s": 9, "cover": [0, 3]}, {"s": 0, "cover": []}]]
    sizes = [4, 3, 7, 5, 6]
    want = np.concatenate([[any(x["s"] + a <= j < x["s"] + b for x in r or () for a, b in zip(x["cover"][::2], x["cover"][1::2], strict=True)) for j in range(n)] for r, n in zip(runs, sizes, strict=True)])
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    assert repeats.covered_mask(pa.array(runs, kind), bounds).tolist() == want.tolist()
    assert repeats.covered_mask(pa.array(runs, kind).slice(2), bounds[2:] - bounds[2]).tolist() == want[bounds[2] :].tolist()


def test_runs_of_all_texts_at_once():
    dice = np.random.RandomState(7)
    count = [5, 1, 30, 12, 1, 40]
    bounds = np.concatenate([[0], np.cumsum(count)])
    mask = dice.rand(bounds[-1]) < 0.3
    mask[[4, 5, 6]] = True
    for text, got in enumerate(anchors.runs_within(mask, bounds, 3)):
        own = mask[bounds[text] : bounds[text + 1]]
        want = {j for i in np.flatnonzero(own).tolist() for j in range(i, i + 3)}
        assert {j for a, b in zip(got[::2], got[1::2], strict=True) for j in range(a, b)} == want
        assert all(b < a for b, a in zip(got[1::2], got[2::2], strict=False))


def test_pretokens_side_by_side():
    """The same ids as one by one, in any company and of any length."""
    encoder = bpe.Encoder(bpe.Vocabulary(bpe.default_path()))
    dice = random.Random(8)
    letters = [c for c in encoder.v.symbol]
    some = sorted({"".join(dice.choice("etaoinshrdlu" if dice.random() < 0.9 else letters) for _ in range(dice.randint(1, 64))) for _ in range(400)})
    assert encoder.together(some) == [encoder.piece(x) for x in some]
    assert encoder.together(["a"]) == [encoder.piece("a")]
    encoder.prepare(["two wörds <|endoftext|> don't".encode(), b"", b"x" * 500])
    assert encoder.ready and all(got == bpe.Encoder(encoder.v).piece(x) for x, got in encoder.ready.items())


def test_words_are_cut_once(monkeypatch):
    """The pre-tokens of a batch's new words are found once, and special tokens are still told apart."""
    encoder, cut = bpe.Encoder(bpe.Vocabulary(bpe.default_path())), []
    monkeypatch.setattr(bpe.Encoder, "parts", lambda self, text, parts=bpe.Encoder.parts: cut.append(text) or parts(self, text))
    texts = ["Plain words, don't they: WÖRDS 12x \x1c\x1f a b".encode(), b"plain words again"]
    encoder.prepare(texts)
    words = {w for x in texts for w in x.split()}
    got = {w: encoder.words[w] for w in words}
    assert sorted(cut) == sorted(w.decode() for w in words)
    slow = bpe.Encoder(encoder.v)
    assert got == {w: slow.word(w) for w in words}
    mixed = [b"x<|endoftext|>y", b"<|endoftext|>", b"plain"]
    encoder.prepare([b" ".join(mixed)])
    assert [encoder.words[w] for w in mixed] == [slow.word(w) for w in mixed]


def test_ids_alone_take_little_memory(spark):
    """A worker's vocabulary is small, caches for ids hold no decoded texts, and the ids are the same, whatever the slices."""
    path = bpe.default_path()
    data = pickle.dumps(bpe.Vocabulary(path))
    tracemalloc.start()
    encoder = bpe.Encoder(pickle.loads(data), decodes=False)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert used < 20 << 20
    both = bpe.Encoder(bpe.Vocabulary(path))
    words = ["don't".encode(), "WÖRDS".encode(), b"x<|endoftext|>y", b"12!?", b"a" * 500]
    assert [encoder.words[w] for w in words] == [both.words[w][0] for w in words]
    docs = spark.createDataFrame([(1, "some Words, " * 100_000), (2, None), (3, ""), (4, "船舶 <|endoftext|> don't"), (5, "end")], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.encoded(docs, path, decoded=False).collect()}
    assert got[1].asDict().keys() == {"doc_id", "n_tokens", "ids"}
    assert {i: (r.n_tokens, r.ids) for i, r in got.items()} == {r.doc_id: (r.n_tokens, r.ids) for r in bpe.encoded(docs, path).collect()}
    assert got[1].n_tokens == len(got[1].ids) == 300_000 and got[2].ids == got[3].ids == []


def test_steps_in_one_array_are_those_of_the_hash_table(monkeypatch):
    dice = random.Random(3)
    text = lambda letters, k: "".join(dice.choice(letters + " ") for _ in range(k))
    model = langid.Model({"aa": [text("abcdé", 900), text("abz", 50)], "bb": [text("bcdx", 700)], "cc": [text("жя", 300)]})
    texts = [text("abcdéxzжяq", dice.randint(0, 300)) for _ in range(200)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes = langid.squeeze(model.codes()[np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")], bounds)
    calls = []
    monkeypatch.setattr(langid.Model, "step", lambda self, *x, step=langid.Model.step: calls.append(1) or step(self, *x))
    got = langid.phrases(model, model.steps(), *codes)
    assert not calls
    model.every = None
    monkeypatch.setattr(langid, "DENSE", 0)
    assert (got == langid.phrases(model, model.steps(), *codes)).all() and calls
