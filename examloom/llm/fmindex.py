"""Substring dedup by a compressed FM-index per shard (operator 7).

A shard holds the distinct segments around its anchors (see ``repeats``), as
words.  Its FM-index is a wavelet matrix of packed bits over the Burrows-Wheeler
transform, with the number of times that each segment occurs.  Of the documents, exactly the parts that can repeat, their segments
around anchors that occur again, are streamed through backward search, all
places side by side, which gives the matching statistics of each place up to
the window's length: how many words before it stand elsewhere too.  Where they
reach the window's length, the interval of the search holds the window's equals,
whose first occurrence in the corpus is kept and all others are covered.

Null or empty text, and texts shorter than a window, lose nothing.  Equal
documents keep the one with the smallest id; a null id comes after all others.
Of rows with equal ids the one whose text has the smaller hash comes first, and
of rows with equal ids and texts one is kept and the others lose every window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.llm.anchors import runs_within
from examloom.llm.blocks import blocks, configure
from examloom.llm.repeats import Units, covered_mask, covers, identified, with_runs
from examloom.storage import discard, stored

WINDOW = 20
ANCHOR = 6


class WaveletMatrix:
    """Rank of any symbol in a sequence, from packed bits and counts of each 64 of them."""

    def __init__(self, x: np.ndarray, symbols: int) -> None:
        self.levels = max(1, int(symbols - 1).bit_length())
        self.bits, self.sums, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            b = ((x >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([b, np.zeros(64 - len(b) % 64, dtype=bool)]), bitorder="little").view("<u8")
            self.bits.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(b) - b.sum()))
            x = np.concatenate([x[~b], x[b]])
        self.base = np.zeros(symbols, dtype=np.int64)
        self.base = self.walk(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = i >> 6
            below = self.bits[k].take(word)
            below &= (np.uint64(1) << (i & 63).view(np.uint64)) - np.uint64(1)
            ones = self.sums[k].take(word) + np.bitwise_count(below)
            i = np.where((c >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.walk(c, i) - self.base[c]


class FMIndex:
    """Of a sequence of symbols, in which 0 ends each text; patterns have at most the given depth."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int) -> None:
        n = len(text)
        rank = text.astype(np.int64)
        span = 1
        while True:
            other = np.zeros(n, dtype=np.int64)
            other[: n - span] = rank[span:] + 1
            key = rank * (n + symbols + 2) + other
            order = np.argsort(key)  # places equal up to the depth may stand in any order
            fresh = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
            rank = np.empty(n, dtype=np.int64)
            rank[order] = fresh
            span *= 2
            if span >= depth:
                break
        self.suffixes = order
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.bwt = WaveletMatrix(text[order - 1], symbols)

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with c put before them."""
        both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi]))
        return self.less[c] + both[: len(c)], self.less[c] + both[len(c) :]


def statistics(index: FMIndex, text: np.ndarray, end: np.ndarray, w: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matching statistics, up to w, at the given ends of windows: how many symbols before the end occur elsewhere too, and the interval of those w symbols.

    weight: how often the text around each place occurs; what an interval weighs
    is how often its pattern occurs in all.
    """
    upto = np.concatenate([[0], np.cumsum(weight[index.suffixes])])
    matched = np.full(len(end), w)
    lo, hi = np.zeros(len(end), dtype=np.int64), np.full(len(end), len(text), dtype=np.int64)
    live = np.arange(len(end))
    for k in range(1, w + 1):
        c = text[end[live] - k]
        lo[live], hi[live] = index.extend(c, lo[live], hi[live]) if k > 1 else (index.less[c], index.less[c + 1])
        alone = upto[hi[live]] - upto[lo[live]] < 2  # found at this end only
        matched[live[alone]] = k - 1
        live = live[~alone]
    return matched, lo, hi


def shard(columns: dict[str, list], w: int = WINDOW) -> Iterator[tuple[int, list[int], list[int]]]:
    """Which windows of a shard's segments occur again, and what all occurrences and the first one have covered."""
    parts = [np.frombuffer(x, dtype=np.uint64) for x in columns["content"]]
    size = np.array([len(x) for x in parts])
    base = np.concatenate([[0], np.cumsum(size + 1)])
    flat = np.concatenate(parts)
    known, codes = np.unique(flat, return_inverse=True)
    text = np.zeros(base[-1], dtype=np.int64)
    place = np.arange(len(flat)) + np.repeat(np.arange(len(parts)), size)
    text[place] = codes + 1
    index = FMIndex(text, len(known) + 1, w)

    count = size - w + 1
    owner = np.repeat(np.arange(len(parts)), count)
    offset = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    matched, lo, _ = statistics(index, text, base[owner] + offset + w, w, np.repeat(np.array(columns["n"], dtype=np.int64), size + 1))
    repeated = matched == w
    elsewhere = np.flatnonzero(repeated)
    # Of the segments that hold a window, the one that occurs first has its first occurrence.
    documents = [(x is None, 0 if x is None else x, t) for x, t in zip(columns["id"], columns["th"], strict=True)]
    place = {x: i for i, x in enumerate(sorted({d for d in documents if not d[0]}) + sorted({d for d in documents if d[0]}))}
    of_document = np.array([place[d] for d in documents])
    by = np.lexsort((np.array(columns["s"])[owner] + offset, of_document[owner]))
    turn = np.empty(len(owner), dtype=np.int64)
    turn[by] = np.arange(len(owner))
    first = np.ones(len(owner), dtype=bool)
    if len(elsewhere):
        by = elsewhere[np.argsort(lo[elsewhere], kind="stable")]
        cut = np.flatnonzero(np.concatenate([[True], lo[by[1:]] != lo[by[:-1]]]))
        least = np.minimum.reduceat(turn[by], cut)
        first[by] = turn[by] == np.repeat(least, np.diff(np.append(cut, len(by))))
    at = np.concatenate([[0], np.cumsum(count)])
    later = repeated & ~first
    every, own = runs_within(repeated, at, w), runs_within(later, at, w)
    for i in np.flatnonzero(np.add.reduceat(repeated, at[:-1])).tolist():
        yield i, every[i], own[i]


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per distinct document with a repeat: id, th and what is covered, in words."""
    return covers(docs, Units(True, WINDOW, ANCHOR), shard, key=key, text=text)


def removed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: n_words, n_removed and the kept words joined by one blank."""
    configure(docs.sparkSession)
    some = docs.select(key, text)
    marked, runs_column = with_runs(some, repeats(docs, key, text), key, text)
    # Rows with equal ids and texts, which only their number tells apart: all but one of them come later.
    twice = stored(some.select(*identified(some, key, text)).groupBy("id", "th").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            block.split()
            mask, n, gone, kept = covered_mask(block.batch.column(runs_column), block.ptr), [], [], []
            some = block.per_doc(mask, block.ptr).tolist()
            copies = block.batch.column("copies").to_pylist() if "copies" in block.batch.schema.names else [1] * len(block)
            rows = []
            data = block.data.tobytes()
            for i, (a, b) in enumerate(zip(block.ptr[:-1].tolist(), block.ptr[1:].tolist(), strict=True)):
                for copy in range(copies[i]):
                    out = mask[a:b] if not copy or b - a < WINDOW else np.ones(b - a, dtype=bool)
                    rows.append(i)
                    n.append(b - a)
                    gone.append(some[i] if not copy or b - a < WINDOW else b - a)
                    if b > a and not gone[-1]:
                        kept.append(b" ".join(data[block.off[i] : block.off[i + 1]].split()))
                    else:
                        kept.append(b" ".join([data[s:e] for s, e in zip(block.start[a:b][~out].tolist(), block.end[a:b][~out].tolist(), strict=True)]))
            yield pa.RecordBatch.from_arrays([block.batch.column(key).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode() for x in kept], pa.large_string()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())], names=[key, "n_words", "n_removed", "kept_text", "kept_sha256"])

    schema = f"`{key}` {dict(docs.dtypes)[key]}, n_words long, n_removed long, kept_text string, kept_sha256 string"
    if twice.isEmpty():
        discard(twice)
        return marked.mapInArrow(run, schema)
    same = marked[key].eqNullSafe(twice["id"]) & (F.xxhash64(marked[text]) == twice["th"])
    single = marked.join(twice, same, "left_anti").mapInArrow(run, schema)
    several = marked.join(twice, same).dropDuplicates([key, "th"]).select(key, text, runs_column, "copies").mapInArrow(run, schema)
    return single.unionByName(several)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")
