"""Chunkers, each a function from a text to chunks, and their registry."""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom import hooks
from examloom.session import small_batches

#: Characters of the chunks that a task gives out at once, unless a single one has more.
HELD = 1 << 20
SCHEMA = "chunk int, text string, start_index int, end_index int, token_count int"
Chunks = Iterator[tuple[int, int, int]]


def whole(df: DataFrame, key: str, text: str) -> DataFrame:
    """One chunk a text; tokens are parts between white space."""
    return df.select(key, F.lit(0).alias("chunk"), F.col(text).alias("text"), F.lit(0).alias("start_index"), F.length(text).alias("end_index"), F.size(F.split(text, r"\s+")).alias("token_count"))


def fast(text: str, chunk_size: int = 4096, delimiters: str = "\n.?") -> Chunks:
    """Chunks of at most chunk_size bytes, cut after the last delimiter that fits."""
    at, n = 0, len(text)
    sizes = [len(c.encode()) for c in text] if not text.isascii() else None
    while at < n:
        if sizes is None:
            to = min(n, at + chunk_size)
        else:
            to, left = at, chunk_size
            while to < n and (sizes[to] <= left or to == at):
                left -= sizes[to]
                to += 1
        if to < n:
            cut = max(text.rfind(d, at, to) for d in delimiters)
            to = cut + 1 if cut >= at else to
        yield at, to, len(text[at:to].split())
        at = to


LEVELS = ("\n\n", "\n", ". ", " ", "")


def recursive(text: str, chunk_size: int = 2048, min_characters: int = 24) -> Chunks:
    """Chunks of at most chunk_size words, split at the coarsest separator that makes parts small enough; tiny parts join the one before."""

    def count(a: int, b: int) -> int:
        return len(text[a:b].split())

    def split(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        if count(a, b) <= chunk_size or level >= len(LEVELS) - 1:
            yield a, b
            return
        sep, parts, p = LEVELS[level], [], a
        while p < b:
            q = text.find(sep, p, b)
            q = b if q < 0 else q + len(sep)
            parts.append((p, q))
            p = q
        start, size = a, 0
        for p, q in parts:
            n = count(p, q)
            if n > chunk_size:
                if start < p:
                    yield start, p
                yield from split(p, q, level + 1)
                start, size = q, 0
            elif size + n > chunk_size:
                yield start, p
                start, size = p, n
            else:
                size += n
        if start < b:
            yield start, b

    done: list[tuple[int, int]] = []
    for a, b in split(0, len(text), 0) if text else ():
        if done and b - a < min_characters and count(done[-1][0], b) <= chunk_size:
            done[-1] = (done[-1][0], b)
        else:
            done.append((a, b))
    for a, b in done:
        yield a, b, count(a, b)


def _cosine(x: list[float], y: list[float]) -> float:
    n = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
    return sum(v * w for v, w in zip(x, y, strict=True)) / n if n else 0.0


def semantic(text: str, threshold: float = 0.8, chunk_size: int = 2048, window: int = 3, skip: int = 0, embedder: str = "hash") -> Chunks:
    """Sentences of one meaning together, by the vectors of a registered embedder.

    A sentence that is less similar than the threshold to the window of sentences
    before it begins a group.  With skip, a group takes in the farthest of the
    skip + 1 groups after it that is similar to it, and all between, as when a
    topic is left for a remark and taken up again.  Groups of more words than
    chunk_size are cut between sentences.
    """
    embed = hooks.EMBEDDERS[embedder]
    cuts = [m.end() for m in re.finditer(r"[.!?]\s+|\n+", text)]
    bounds = [0, *cuts, *([len(text)] if not cuts or cuts[-1] < len(text) else [])]
    spans = [(a, b) for a, b in itertools.pairwise(bounds) if a < b]
    if not spans:
        return
    vectors = [embed(text[a:b]) for a, b in spans]
    begins = [0] + [i for i in range(1, len(spans)) if _cosine(embed(text[spans[max(0, i - window)][0] : spans[i][0]]), vectors[i]) < threshold]
    groups = [[a, b] for a, b in itertools.pairwise([*begins, len(spans)])]
    if skip:
        of = [embed(text[spans[a][0] : spans[b - 1][1]]) for a, b in groups]
        merged, at = [], 0
        while at < len(groups):
            to = max([at, *(j for j in range(at + 1, min(at + 2 + skip, len(groups))) if _cosine(of[at], of[j]) >= threshold)])
            merged.append([groups[at][0], groups[to][1]])
            at = to + 1
        groups = merged
    for first, end in groups:
        start, used = spans[first][0], 0
        for a, b in spans[first:end]:
            n = len(text[a:b].split())
            if used and used + n > chunk_size:
                yield start, a, used
                start, used = a, 0
            used += n
        yield start, spans[end - 1][1], used


def needs_model(*_args, **_kw) -> Chunks:
    raise NotImplementedError("this chunker needs a language or embedding model; register a function of your own")


METHODS: dict[str, Callable[..., Chunks]] = {"fast": fast, "recursive": recursive, "semantic": semantic, "late": needs_model, "neural": needs_model, "slumber": needs_model}


def frames(rows: Iterable[tuple], held: int = HELD) -> Iterator[pd.DataFrame]:
    """Rows of chunks in frames of bounded size."""
    columns = ["k", "chunk", "text", "start_index", "end_index", "token_count"]
    waiting, size = [], 0
    for row in rows:
        # A short chunk counts for what its other columns take.
        waiting.append(row)
        size += len(row[2]) + 100
        if size >= held:
            yield pd.DataFrame(waiting, columns=columns)
            waiting, size = [], 0
    if waiting:
        yield pd.DataFrame(waiting, columns=columns)


def chunk(df: DataFrame, method: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Chunks of every text by the named method."""
    if method == "whole":
        return whole(df, key, text)
    if method not in METHODS:
        raise ValueError(f"unknown chunker {method}")
    cut = METHODS[method]
    if cut is needs_model:
        needs_model()

    small_batches(df.sparkSession)

    def run(parts):
        for part in parts:
            texts = ((k, t) for k, t in zip(part["k"], part["t"], strict=True) if isinstance(t, str))
            yield from frames((k, i, t[a:b], a, b, n) for k, t in texts for i, (a, b, n) in enumerate(cut(t, **options)))

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, {SCHEMA}").withColumnRenamed("k", key)
