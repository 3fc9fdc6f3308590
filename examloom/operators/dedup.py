"""Duplicate resolution: exact keys, survivor choice, greedy resolution of similar pairs, leader clusters, verification."""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.textsim import indel_ratio, token_set, token_set_ratio
from examloom.operators.similarity import in_blocks, likely_bound, near_pairs, sides
from examloom.storage import discard, stored


def keep_one(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order; the window has a limit of 1, so it is cut before the shuffle."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def groups(df: DataFrame, key: Column, id_: str, size: Column) -> DataFrame:
    """Per key (by its 128-bit hash) the survivor (largest, then smallest id), the group's size and the removed ids."""
    best = F.max_by(id_, F.struct(size, -F.col(id_)))
    agg = df.withColumn("__k", F.md5(key)).groupBy("__k").agg(best.alias("keep_id"), F.count("*").alias("group_size"), F.array_sort(F.collect_list(id_)).alias("all_ids"))
    return agg.select("keep_id", "group_size", F.array_remove("all_ids", F.col("keep_id")).alias("removed_ids"))


def first_by_key(df: DataFrame, original_id: str, question: str, options: str, order: list[Column]) -> DataFrame:
    """One row per original id, or per trimmed lower-case question without one; rows without options go first of all."""
    key = F.coalesce(F.concat(F.lit("id:"), F.col(original_id).cast("string")), F.concat(F.lit("text:"), F.lower(F.trim(question))))
    return keep_one(df.where(F.size(options) > 0), [key], order)


def latest(df: DataFrame, keys: list[str], updated: Column, created: Column, id_: Column, prefer: Column | None = None) -> DataFrame:
    """The latest row of each key; a row for which prefer holds beats any other."""
    order = [F.greatest(updated, created), updated, created, id_]
    return keep_one(df, keys, [x.desc() for x in ([prefer] if prefer is not None else []) + order])


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Greedy resolution of edges (i, j, rank) in rank order: (kept, removed, rank).

    Walking edges by rank, an edge whose ends both live kills its loser: the one
    of smaller weight, else the later one (nodes: id, weight).  Done in rounds:
    an edge that is the best of both its ends depends on no other.  If a node
    wins there, its next edge is decided too, if it is the best of its other end,
    and so on until the node loses or meets an edge that is not: so a node that
    has many copies takes them all in one round.  Then edges of dead nodes go.
    Ranks must be distinct.  Only one flag per round reaches the driver.
    """
    w = nodes.select("id", "weight")
    live = edges.join(w.select(F.col("id").alias("i"), F.col("weight").alias("wi")), "i").join(w.select(F.col("id").alias("j"), F.col("weight").alias("wj")), "j")
    first_wins = (F.col("wi") > F.col("wj")) | ((F.col("wi") == F.col("wj")) & (F.col("i") < F.col("j")))
    live = stored(live.select("i", "j", "rank", F.when(first_wins, F.col("i")).otherwise(F.col("j")).alias("kept"), F.when(first_wins, F.col("j")).otherwise(F.col("i")).alias("removed")), "edges")
    decided = [stored(live.select("kept", "removed", "rank").where("false"), "decided")]
    while not live.isEmpty():
        ends = live.select(F.col("i").alias("v"), "rank").unionByName(live.select(F.col("j").alias("v"), "rank"))
        best = ends.groupBy("v").agg(F.min("rank").alias("m"))
        marked = stored(live.join(best.select(F.col("v").alias("i"), F.col("m").alias("mi")), "i").join(best.select(F.col("v").alias("j"), F.col("m").alias("mj")), "j").select("i", "j", "rank", "kept", "removed", (F.col("rank") == F.col("mi")).alias("of_i"), (F.col("rank") == F.col("mj")).alias("of_j")), "marked")
        # Of each node the first edge that is not the best of its other end, and the first of the others where the node loses.
        side = lambda v, other: marked.select(F.col(v).alias("v"), "rank", F.col(other).alias("free"), (F.col(v) == F.col("removed")).alias("loses"))
        until = side("i", "of_j").unionByName(side("j", "of_i")).groupBy("v").agg(F.min(F.when(~F.col("free"), F.col("rank"))).alias("barred"), F.min(F.when(F.col("free") & F.col("loses"), F.col("rank"))).alias("lost"))
        reach = lambda v: until.select(F.col("v").alias(v), F.col("barred").alias(f"b{v}"), F.col("lost").alias(f"l{v}"))
        walked = lambda v, free: F.col(free) & F.coalesce(F.col("rank") < F.col(f"b{v}"), F.lit(True)) & F.coalesce(F.col("rank") <= F.col(f"l{v}"), F.lit(True))
        # Only edges that are the best of an end can be decided.
        tops = marked.where("of_i OR of_j").join(reach("i"), "i").join(reach("j"), "j")
        done = stored(tops.where(walked("i", "of_j") | walked("j", "of_i")).select("kept", "removed", "rank"), "decided")
        decided.append(done)
        dead = done.select(F.col("removed").alias("v"))
        # A decided edge has a dead end.
        last, live = live, stored(live.join(dead, F.col("i") == F.col("v"), "left_anti").join(dead, F.col("j") == F.col("v"), "left_anti"), "edges")
        discard(last, marked)
    out = stored(functools.reduce(DataFrame.unionByName, decided), "resolved")
    discard(live, *decided)
    return out


#: Bins of characters and of pairs of characters in words, by which texts are told apart before they are compared.
LETTERS, BIGRAMS = 32, 96
TEXT_BLOCK = 1024


def _bins(words: list[str]) -> np.ndarray:
    """How often the characters of the joined words, and the pairs of characters in words, fall into each bin."""
    out = np.zeros(LETTERS + BIGRAMS, dtype=np.int32)
    for w in words:
        for c in w:
            out[ord(c) % LETTERS] += 1
        for c, d in itertools.pairwise(w):
            out[LETTERS + (ord(c) * 31 + ord(d)) % BIGRAMS] += 1
    out[ord(" ") % LETTERS] += max(0, len(words) - 1)
    return out


def _may_reach(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows whose ratio may reach the threshold by their bins and lengths.

    With L characters common in order, n = nx + ny - 2 L characters are in excess.
    Both have at least L in common whatever the order, and each character in
    excess changes three pairs of characters at most.
    """
    least = threshold / 200 * (nx[:, None] + ny[None, :]) - 1e-9
    letters, bigrams = np.zeros(least.shape, dtype=np.int32), np.zeros(least.shape, dtype=np.int32)
    for k in range(LETTERS):
        if x[:, k].any() and y[:, k].any():
            letters += np.minimum(x[:, k][:, None], y[:, k][None, :])
    excess = nx[:, None] + ny[None, :] - 2 * least
    good = letters >= least
    if threshold > 200 / 3:
        for k in range(LETTERS, LETTERS + BIGRAMS):
            if x[:, k].any() and y[:, k].any():
                bigrams += np.minimum(x[:, k][:, None], y[:, k][None, :])
        good &= 2 * bigrams >= x[:, LETTERS:].sum(axis=1)[:, None] + y[:, LETTERS:].sum(axis=1)[None, :] - 3 * excess
    return np.nonzero(good)


def fuzzy_pairs(df: DataFrame, id_: str, text: str, threshold: float, block: int = TEXT_BLOCK, compared=None) -> DataFrame:
    """All pairs i < j whose token-set ratio reaches the threshold (0-100).

    A pair reaches it in one of two ways, each with its own index:

    * By its common words alone, against one side: these are then at least a
      share t / (200 - t) of that side's characters (all of it, if the other side
      has every word).  Of a side's words, the rarest first, so many are taken
      that the rest has less than this; one of these is common.  So few words of
      one side meet all words of the other, through the words.
    * By its texts as a whole: lengths then differ by the factor (200 - t) / t at
      most, so texts meet those of their own and the next class of lengths, in
      blocks; pairs whose characters, or pairs of characters in words, can't
      reach the threshold in any order are dropped before they are compared.

    Both bounds are exact.  compared: an accumulator of the texts compared.  Null
    texts take no part; one without words is similar to nothing (0).
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[id_]

    def split(parts):
        for part in parts:
            words = [sorted(set(t.split())) for t in part["t"]]
            n = np.array([sum(map(len, w)) + max(0, len(w) - 1) for w in words], dtype=np.int64)
            yield pd.DataFrame({"k": part["k"], "t": part["t"], "words": words, "n": n})

    some = df.select(F.col(id_).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    rows = stored(some.mapInPandas(split, f"k {kind}, t string, words array<string>, n long"), "words")
    if threshold <= 0:
        rows_of = rows
    else:
        rows_of = rows.where("n > 0")

    # By common words.
    t = float(threshold)
    words = rows_of.select("k", "n", F.explode("words").alias("w"))
    often = words.groupBy("w").agg(F.count("*").alias("df"))
    order = Window.partitionBy("k").orderBy("df", "w")
    after = F.col("n") + 1 - F.sum(F.length("w") + 1).over(order)  # what is left behind a word, with a blank each
    marked = words.join(often, "w").select("k", "w", (after + F.length("w") + 1).alias("left"), (F.floor(t * F.col("n") / (200 - t) - 1e-9) + 1).alias("need"))
    # Words up to which as much as is needed is left.
    rare = marked.where("left >= need").select(F.col("k").alias("i"), "w")
    met = rare.join(words.select(F.col("k").alias("j"), "w"), "w").where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).distinct()
    left, right = rows.select(F.col("k").alias("i"), F.col("t").alias("a"), F.col("words").alias("x"), F.col("n").alias("nx")), rows.select(F.col("k").alias("j"), F.col("t").alias("c"), F.col("words").alias("y"), F.col("n").alias("ny"))
    both = met.join(left, "i").join(right, "j").withColumn("common", F.array_intersect("x", "y"))
    shared = F.length(F.array_join("common", " "))
    inside = F.size("common") == F.least(F.size("x"), F.size("y"))
    by_words = both.where((shared > 0) & (inside | (200 * shared >= (t - 1e-9) * (shared + F.least("nx", "ny"))))).select("i", "j", token_set_ratio("a", "c").alias("sim"))

    # As a whole, by classes of length.
    step = math.log((200 - t) / t) + 1e-9 if 0 < t < 100 else None
    if t <= 0:
        cell = F.lit(0)
    elif step is None:
        cell = F.col("n").cast("int")
    else:
        cell = F.floor(F.log(F.col("n").cast("double")) / step).cast("int")
    home = rows_of.select("k", "t", "words", "n", cell.alias("cell"), F.lit(False).alias("copy"))
    placed = home if t <= 0 or step is None else home.unionByName(home.withColumns({"cell": F.col("cell") + 1, "copy": F.lit(True)}))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        a, b, same = sides(part)
        none = pd.DataFrame({"i": part["k"].iloc[:0], "j": part["k"].iloc[:0], "sim": []})
        if not len(a) or not len(b):
            return none
        x, y = (np.array([_bins(w) for w in s["words"]]) for s in (a, b))
        p, q = _may_reach(x, y, a["n"].to_numpy(), b["n"].to_numpy(), t)
        ka, kb, ta, tb = a["k"].to_numpy(), b["k"].to_numpy(), a["t"].to_numpy(), b["t"].to_numpy()
        keep = ka[p] < kb[q] if same else ka[p] != kb[q]
        p, q = p[keep], q[keep]
        if compared is not None:
            compared.add(len(p))
        sim = np.array([token_set(ta[i], tb[j]) for i, j in zip(p.tolist(), q.tolist(), strict=True)])
        return pd.DataFrame({"i": np.minimum(ka[p], kb[q]), "j": np.maximum(ka[p], kb[q]), "sim": sim})

    whole = in_blocks(placed, block).groupBy("cell", "x", "y").applyInPandas(compare, f"i {kind}, j {kind}, sim double")
    return by_words.unionByName(whole).where(F.col("sim") >= threshold).dropDuplicates(["i", "j"])


def greedy(pairs: DataFrame, nodes: DataFrame, by_similarity: bool) -> DataFrame:
    """Resolve pairs (i, j, sim): by falling similarity, or in the order of a scan over i and j."""
    order = [F.desc("sim"), "i", "j"] if by_similarity else ["i", "j"]
    ranked = pairs.select("i", "j", "sim", F.struct((-F.col("sim") if by_similarity else F.lit(0.0)).alias("a"), F.col("i").alias("b"), F.col("j").alias("c")).alias("rank"))
    return resolve(ranked.select("i", "j", "rank"), nodes).select("kept", "removed", F.when(F.lit(by_similarity), -F.col("rank.a")).alias("similarity")) if order else ranked


#: Pairs for a row on average that one band of similarities is meant to have, and how much lower each band goes at least.
DEGREE, STEP = 16, 0.05


def greedy_vectors(vectors: DataFrame, key: str, vector: str, weight: str, threshold: float, degree: float = DEGREE) -> DataFrame:
    """greedy() by similarity on all pairs of vectors that reach the threshold: (kept, removed, similarity).

    Pairs are walked by falling similarity, so they are made in bands: those of
    the next, lower band among the rows that still live, as a pair with a dead
    end does nothing.  A band ends where a sample expects a bounded number of
    pairs a row, so what is stored grows with the rows and not with all pairs.
    Each band goes lower by a step at least, which bounds their number.
    """
    live = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.col(weight).cast("long").alias("weight"))
    found, least, used = [], 1.0, []
    while True:
        least = max(threshold, min(least - STEP, likely_bound(live, "id", "v", degree)))
        found.append(greedy(near_pairs(live, "id", "v", least), live.select("id", "weight"), by_similarity=True))
        if least <= threshold:
            break
        live = stored(live.join(found[-1].select(F.col("removed").alias("id")), "id", "left_anti"), "live")
        used.append(live)
    discard(*used)
    return functools.reduce(DataFrame.unionByName, found)


def similar_questions(rows: DataFrame, threshold: float, block: int = TEXT_BLOCK) -> DataFrame:
    """Pairs (a, b), both ways, of rows (k, key, q, o, images) of one key whose questions, and whose options or images, are similar enough; every row with itself."""
    t = float(threshold)
    n = F.length("q")
    some = rows.select("k", "key", "q", "o", "images", n.cast("long").alias("n"))
    step = math.log((200 - t) / t) + 1e-9 if 0 < t < 100 else None
    level = F.lit(0) if t <= 0 else F.col("n").cast("int") if step is None else F.when(F.col("n") == 0, -2).otherwise(F.floor(F.log(F.col("n").cast("double")) / step)).cast("int")
    cell = lambda more: F.concat(level.cast("int") + more, F.lit(":"), F.col("key"))
    home = some.select("*", cell(0).alias("cell"), F.lit(False).alias("copy"))
    placed = home if t <= 0 or step is None else home.unionByName(some.select("*", cell(1).alias("cell"), F.lit(True).alias("copy")))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        a, b, same = sides(part)
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []})
        x, y = (np.array([_bins([c for c in s.split(" ")]) for s in side["q"]]) for side in (a, b))
        p, q = _may_reach(x, y, a["n"].to_numpy(), b["n"].to_numpy(), t)
        ka, kb = a["k"].to_numpy(), b["k"].to_numpy()
        keep = ka[p] < kb[q] if same else ka[p] != kb[q]
        qa, qb, oa, ob = a["q"].to_numpy(), b["q"].to_numpy(), a["o"].to_numpy(), b["o"].to_numpy()
        ia, ib = ([set() if i is None else set(i) for i in side["images"]] for side in (a, b))
        found = [(ka[i], kb[j]) for i, j in zip(p[keep].tolist(), q[keep].tolist(), strict=True) if indel_ratio(qa[i], qb[j]) >= t and (ia[i] & ib[j] or indel_ratio(oa[i], ob[j]) >= t)]
        return pd.DataFrame(found, columns=["a", "b"])

    one = in_blocks(placed, block, many=True).groupBy("cell", "x", "y").applyInPandas(compare, "a long, b long")
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(rows.select(F.col("k").alias("a"), F.col("k").alias("b")))


def leader_clusters(df: DataFrame, threshold: float, block: int = TEXT_BLOCK) -> DataFrame:
    """Leader clustering in input order within each answer key.

    df: pos (distinct), id, answer_key, question_blob, options_blob, image_ids (array), size.
    An exact copy of a cluster's first question and key joins it; else the first
    cluster whose question, and whose options or images, are similar enough; the
    best question (with images, more images, longer) becomes the canonical one.
    Output: canonical_id, sources, method, cluster_size.  Null texts count as empty.

    Equal to the walk from row to row, but in rounds; no task holds a key.  Which
    texts are similar is found once, in blocks with bounds by length and
    characters.  In each round those rows are decided whose outcome no undecided
    row can change:

    * a copy of the first question of a cluster (if it becomes the canonical one,
      once nothing earlier can);
    * a row similar to the canonical question of a cluster, if no earlier
      undecided row can replace that one, nor found or change a cluster that
      comes before it, nor found one with the row's very question;
    * a row without undecided similar rows before it: it joins the first similar
      cluster, if nothing earlier can replace its canonical question, or founds one.

    The first undecided row of a key is always one of these.  Near copies, however
    many, take a round for each change of their canonical question.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    images = F.array_sort(F.array_distinct(F.coalesce(F.col("image_ids"), F.array().cast("array<string>"))))
    key = F.coalesce(F.concat(F.lit("="), F.col("answer_key").cast("string")), F.lit(""))
    rows = df.select(F.col("pos").cast("long").alias("r"), "id", key.alias("key"), text("question_blob").alias("q"), text("options_blob").alias("o"), images.alias("images"), F.coalesce(F.col("size").cast("long"), F.lit(-1).cast("long")).alias("size"))
    rows = rows.withColumn("kind", F.xxhash64("key", "q", "o", "images")).withColumn("copy", F.xxhash64("key", "q"))
    rows = stored(rows.withColumn("score", F.struct((F.size("images") > 0).alias("a"), F.size("images").alias("b"), F.col("size").alias("c"))), "rows")
    kinds = stored(rows.select(F.col("kind").alias("k"), "key", "q", "o", "images").dropDuplicates(["k"]), "kinds")
    near = stored(similar_questions(kinds, threshold, block), "near")
    left = stored(rows.select("r", "key", "kind", "copy", "score"), "left")
    # Canonical questions: of cluster c (named by its first row) the row k with its kind and score, up to the next change.
    heads = stored(left.where("false").select("key", F.col("r").alias("c"), F.col("r").alias("k"), F.col("kind").alias("kkind"), F.col("copy").alias("ccopy"), F.col("score").alias("kscore")), "heads")
    joined: list[DataFrame] = []
    while not left.isEmpty():
        until = F.coalesce(F.lead("k").over(Window.partitionBy("c").orderBy("k")), F.lit((1 << 62)))
        line = heads.withColumn("until", until)
        at = (F.col("k") < F.col("r")) & (F.col("r") <= F.col("until"))
        met = left.join(near, left["kind"] == near["a"]).drop("a").join(line.select("c", "k", F.col("kkind").alias("b"), "kscore", "until"), "b").where(at).select("r", "c", "kscore", "score")
        exact = left.join(line.select("c", "k", F.col("ccopy").alias("copy"), "kscore", "until"), "copy").where(at).select("r", "c", "kscore", "score")
        met, exact = stored(met, "met"), stored(exact, "exact")
        change = met.unionByName(exact).where(F.col("score") > F.col("kscore")).groupBy("c").agg(F.min("r").alias("changed"))
        change = stored(change, "change")
        by_key = change.join(heads.select("c", "key").distinct(), "c").groupBy("key").agg(F.min("c").alias("first_c"), F.min("changed").alias("first_change"))
        best = met.groupBy("r").agg(F.min("c").alias("c"), F.min_by("kscore", "c").alias("kscore"))
        # Undecided rows before a row: similar ones, its own copies with other options, its very copies.
        open_ = left.groupBy("kind").agg(F.min("r").alias("first"))
        before = left.select("kind").distinct().join(near, F.col("kind") == near["a"]).join(open_.select(F.col("kind").alias("b"), "first"), "b").groupBy("kind").agg(F.min("first").alias("nearest"), F.min(F.when(F.col("b") != F.col("kind"), F.col("first"))).alias("other"))
        copies = left.groupBy("copy").agg(F.min("r").alias("copied"), F.min("kind").alias("lo"), F.max("kind").alias("hi"))
        first_open = left.groupBy("key").agg(F.min("r").alias("key_first"))
        told = left.join(before, "kind").join(first_open, "key").join(copies, "copy").join(best, "r", "left").join(exact.groupBy("r").agg(F.min("c").alias("ec"), F.min("kscore").alias("ekscore")), "r", "left").join(change, "c", "left").join(by_key, "key", "left").join(change.select(F.col("c").alias("ec"), F.col("changed").alias("echanged")), "ec", "left")
        calm = F.coalesce(F.col("changed") >= F.col("r"), F.lit(True))
        alone = (F.col("nearest") >= F.col("r")) & (F.col("copied") >= F.col("r"))
        sure = F.col("c").isNotNull() & calm & ((F.col("nearest") >= F.col("r")) | (F.col("key_first") > F.col("c"))) & ((F.col("lo") == F.col("hi")) | (F.col("copied") >= F.col("r"))) & ~F.coalesce((F.col("first_c") < F.col("c")) & (F.col("first_change") < F.col("r")), F.lit(False))
        # A copy joins in any case, but what becomes the canonical question must be known in order.
        goes = F.when(F.col("ec").isNotNull(), F.when((F.col("score") <= F.col("ekscore")) | F.coalesce(F.col("echanged") >= F.col("r"), F.lit(True)), F.col("ec"))).when(sure, F.col("c")).when(alone & calm, F.coalesce("c", "r"))
        made = told.select("r", "key", "kind", "copy", "score", goes.alias("to"), F.when(F.col("ec").isNotNull(), F.col("ekscore")).otherwise(F.col("kscore")).alias("kscore"), F.col("ec").isNull().alias("fuzzy")).where("to IS NOT NULL")
        made = stored(made.withColumn("head", (F.col("to") == F.col("r")) | (F.col("score") > F.col("kscore"))), "made")
        joined.append(made)
        new = made.where("head").join(heads.select("c", F.col("ccopy").alias("fcopy")).distinct(), F.col("to") == F.col("c"), "left").select("key", F.col("to").alias("c"), F.col("r").alias("k"), F.col("kind").alias("kkind"), F.coalesce("fcopy", "copy").alias("ccopy"), F.col("score").alias("kscore"))
        old_left, old_heads = left, heads
        heads = stored(heads.unionByName(new), "heads")
        left = stored(left.join(made.select("r"), "r", "left_anti"), "left")
        discard(old_left, old_heads, met, exact, change)
    kind_of = dict(df.dtypes)["id"]
    if not joined:
        return df.sparkSession.createDataFrame([], f"canonical_id {kind_of}, sources array<{kind_of}>, method string, cluster_size long")
    members = functools.reduce(DataFrame.unionByName, joined).select("r", F.col("to").alias("c"), (F.col("fuzzy") & (F.col("to") != F.col("r"))).alias("fuzzy")).join(rows.select("r", "id"), "r")
    last = heads.groupBy("c").agg(F.max("k").alias("k")).join(rows.select(F.col("r").alias("k"), F.col("id").alias("canonical_id")), "k").select("c", "canonical_id")
    found = members.groupBy("c").agg(F.array_sort(F.collect_set("id")).alias("sources"), F.max("fuzzy").alias("fuzzy")).join(last, "c")
    size = F.size("sources").cast("long")
    out = stored(found.select("canonical_id", "sources", F.when(size > 1, F.when(F.col("fuzzy"), "mixed").otherwise("exact")).alias("method"), size.alias("cluster_size")), "clusters")
    discard(rows, kinds, near, left, heads, *joined)
    return out


def verification_split(pairs: DataFrame, same_answer: Column, similarity: Column, by_embedding: Column, trusted: float = 0.97, same: float = 0.85) -> DataFrame:
    """trusted or verify: equal answers that are similar enough, or embeddings that are very close, need no verdict."""
    return pairs.withColumn("decision", F.when((same_answer & (similarity >= same)) | (by_embedding & (similarity >= trusted)), "trusted").otherwise("verify"))


def recovered(removed: DataFrame, verdicts: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """The kept rows and those removed ones whose verdict is DIFFERENT; without a clear verdict they stay removed."""
    back = removed.join(verdicts.where(F.col("verdict") == "DIFFERENT").select(key), key, "left_semi")
    return kept.unionByName(back.select(*kept.columns))


def verdict_lists(pairs: DataFrame, verdict: Column) -> DataFrame:
    """Pairs (.., sim) with the list they go to and their place in it: recovered if the verdict is DIFFERENT, else removed; each by falling similarity, then by the pairs' other columns.

    The pairs are stored, as a global order reads them more than once; a list is
    a flag until they are in order.
    """
    from examloom.operators.packing import renumbered

    told = stored(pairs.withColumn("__back", F.coalesce(verdict == "DIFFERENT", F.lit(False))), "told")
    others = [c for c in pairs.columns if c != "sim"]
    placed = renumbered(told, [F.col("__back"), F.desc("sim"), *map(F.col, others)], "__n")
    # The list that comes first has as many as go before the other.
    first = told.groupBy("__back").agg(F.count("*").alias("n")).select((~F.col("__back")).alias("__after"), "n")
    before = F.when(F.col("__back"), F.coalesce(F.col("n"), F.lit(0))).otherwise(0)
    out = placed.join(F.broadcast(first), F.col("__back") == F.col("__after"), "left").withColumn("place", F.col("__n") - before)
    return out.withColumn("list", F.when(F.col("__back"), "recovered").otherwise("removed")).select(*pairs.columns, "list", "place")
