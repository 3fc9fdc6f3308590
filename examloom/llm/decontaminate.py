"""Benchmark decontamination by greedy string tiling (operator 1).

Words are compared in lower case, without punctuation; in scripts without
blanks each character is a word.  Documents and test items that share a seed
(``SEED`` consecutive words, by rolling hash) are tiled: running Karp-Rabin finds
the matches of still unmarked words, the longest are marked on both sides, and
so on until no match of ``SEED`` words is left.  The share of the item's words
that tiles cover is its coverage; since tiles may stand in any order, reordered
passages are caught too.  A document holds an item if the coverage reaches
``COVERAGE``.  An item with fewer words than a seed is held where all its words
stand consecutively, which makes one tile.

Test items are taken in blocks of about ``BLOCK_WORDS`` words and ``BLOCKS`` of
these in a pass over the documents, so what is broadcast is bounded whatever
the benchmark's size.  Documents are never shuffled.  Places of equal seeds are
expanded for at most about ``HITS`` pairs at once.  A document and an item with
more of them (both repeat themselves) are tiled without their pairs: a longest
match is found by the hashes of all windows of a length, in memory of both texts'
size, with the same tiles.

Null or empty texts, on either side, hold nothing and are held by nothing.
Equal items and rows are each reported, null ids as null.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from examloom.llm.blocks import Block, Rolling, blocks, configure, spread

SEED = 5
COVERAGE = 0.5
BLOCK_WORDS, BLOCKS = 1_000_000, 4
HITS = 500_000

#: All of ASCII but digits and lower-case letters parts words.
PARTS = np.ones(256, dtype=bool)
PARTS[0x80:] = False
PARTS[0x30:0x3A] = False
PARTS[0x61:0x7B] = False


class Items:
    """One block of test items: their words and an index of their seeds; short items by their whole word sequence."""

    def __init__(self, ids: list, texts: list[str]) -> None:
        block = Block(pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())}), "t", lower=True, blank=PARTS, unspaced=True)
        self.ids = ids
        words = self.words = block.word_hashes()
        self.ptr = block.ptr
        rolling, doc = Rolling(words), block.doc_of_words()
        grams = rolling.windows(SEED)
        at = np.flatnonzero(self.ptr[1:][doc] - np.arange(len(doc)) >= SEED)
        order = at[np.argsort(grams[at], kind="stable")]
        self.seeds, self.place, self.item = grams[order], order - self.ptr[:-1][doc[order]], doc[order]
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[(self.seeds >> np.uint64(44)).astype(np.int64)] = True
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in range(1, SEED):
            some = np.flatnonzero(block.count == n)
            if len(some):
                whole = rolling.ranges(self.ptr[some], self.ptr[some] + n)
                by = np.argsort(whole, kind="stable")
                self.short[n] = whole[by], some[by]

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of grams that are seeds too, and for each the first of these and their number."""
        some = np.flatnonzero(self.sieve[(grams >> np.uint64(44)).astype(np.int64)])
        lo = np.searchsorted(self.seeds, grams[some], side="left")
        n = np.searchsorted(self.seeds, grams[some], side="right") - lo
        return some[n > 0], lo[n > 0], n[n > 0]


def tiles(p: np.ndarray, q: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from all places (p, q) at which seeds are equal: (p, q, length), longest first.

    Each round runs over the seeds whose words are unmarked on both sides, joins
    those that follow each other into matches and marks the longest of these.
    """
    out: list[tuple[int, int, int]] = []
    marked_p: set[int] = set()
    marked_q = np.zeros(size + 1, dtype=bool)
    while len(p):
        order = np.lexsort((p, p - q))
        p, q = p[order], q[order]
        fresh = np.ones(len(p), dtype=bool)
        fresh[1:] = (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)
        first = np.flatnonzero(fresh)
        length = np.diff(np.append(first, len(p))) + SEED - 1
        for i in first[length == length.max()].tolist():
            a, b, n = int(p[i]), int(q[i]), int(length.max())
            if marked_q[b : b + n].any() or not marked_p.isdisjoint(range(a, a + n)):
                continue
            marked_q[b : b + n] = True
            marked_p.update(range(a, a + n))
            out.append((a, b, n))
        busy = np.concatenate([[0], np.cumsum(marked_q)])
        taken = np.array(sorted(marked_p))
        free = (busy[q + SEED] == busy[q]) & (np.searchsorted(taken, p) == np.searchsorted(taken, p + SEED))
        p, q = p[free], q[free]
    return out


def long_tiles(doc: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """The tiles of two sequences of word hashes, as from all places of equal seeds, one after another and without those places."""
    out: list[tuple[int, int, int]] = []
    sides = [(Rolling(x), np.zeros(len(x) + 1, dtype=np.int64), np.zeros(len(x), dtype=bool)) for x in (doc, item)]

    def free(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Starts and hashes of the unmarked windows of a length that both sides have."""
        got = []
        for rolling, busy, marked in sides:
            at = np.flatnonzero(busy[n:] == busy[: len(busy) - n])
            got.append((at, rolling.windows(n)[at]))
        (p, hp), (q, hq) = got
        p_in, q_in = np.isin(hp, hq), np.isin(hq, hp)
        return [(p[p_in], hp[p_in]), (q[q_in], hq[q_in])]

    longest = min(len(doc), len(item))
    while longest >= SEED:
        low, high = SEED - 1, longest
        while low < high:
            n = (low + high + 1) // 2
            low, high = (n, high) if len(free(n)[0][0]) else (low, n - 1)
        longest = low
        if longest < SEED:
            break
        while True:
            (p, hp), (q, hq) = free(longest)
            if not len(p):
                break
            # Of each window the first place here and the last one there; of these the smallest difference, then the first.
            known, first = np.unique(hp, return_index=True)
            last = np.zeros(len(known), dtype=np.int64)
            np.maximum.at(last, np.searchsorted(known, hq), q)
            a = p[first]
            best = np.lexsort((a, a - last))[0]
            at = int(a[best]), int(last[best])
            out.append((*at, longest))
            for (_, busy, marked), x in zip(sides, at, strict=True):
                marked[x : x + longest] = True
                np.cumsum(marked, out=busy[1:])
    return out


def _tiled(row: np.ndarray, p: np.ndarray, k: np.ndarray, items: Items, least: float) -> Iterator[tuple[int, int, float, int, int]]:
    """Tilings of all pairs of a row and an item in the places p of seeds k."""
    item, q = items.item[k], items.place[k]
    order = np.lexsort((item, row))
    row, item, p, q = row[order], item[order], p[order], q[order]
    cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]), [True]]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        i = int(item[a])
        size = int(items.ptr[i + 1] - items.ptr[i])
        if len(np.unique(q[a:b])) * SEED < least * size:
            continue  # its seeds, all apart, would not cover it
        found = tiles(p[a:b], q[a:b], size)
        n = sum(x[2] for x in found)
        yield int(row[a]), i, n / size, len(found), n


def matches(block: Block, items: Items, least: float = 0.0) -> list[tuple[int, int, float, int, int]]:
    """(row, item, coverage, tiles, words in tiles) of pairs that share a seed and may reach the least coverage."""
    words = block.word_hashes()
    rolling = Rolling(words)
    doc = block.doc_of_words()
    left = block.ptr[1:][doc] - np.arange(len(doc))
    out = []
    for n, (whole, which) in items.short.items():
        at = np.flatnonzero(left >= n)
        grams = rolling.windows(n)[at]
        lo, hi = np.searchsorted(whole, grams, side="left"), np.searchsorted(whole, grams, side="right")
        run, k = spread(hi - lo)
        pairs = {(int(r), int(i)) for r, i in zip(doc[at[run]], which[lo[run] + k], strict=True)}
        out += [(r, i, 1.0, 1, n) for r, i in sorted(pairs)]
    at = np.flatnonzero(left >= SEED)
    some, lo, n = items.hits(rolling.windows(SEED)[at])
    if not len(some):
        return out
    p, row = at[some], doc[at[some]]
    # Rows together while their pairs of places are few; a row with more goes by itself, item by item.
    by_row = np.bincount(row, weights=n, minlength=len(block))
    group = np.floor(np.cumsum(by_row) / HITS).astype(np.int64)
    for g in np.unique(group[row]).tolist():
        mine = np.flatnonzero(group[row] == g)
        if n[mine].sum() <= 2 * HITS:
            run, k = spread(n[mine])
            out += _tiled(row[mine][run], p[mine][run], lo[mine][run] + k, items, least)
            continue
        seeds = np.unique(np.concatenate([np.arange(a, a + b) for a, b in {*zip(lo[mine].tolist(), n[mine].tolist(), strict=True)}]))
        for i in np.unique(items.item[seeds]).tolist():
            own = seeds[items.item[seeds] == i]
            a, b = np.searchsorted(own, lo[mine]), np.searchsorted(own, lo[mine] + n[mine])
            if (b - a).sum() > HITS:
                for r in np.unique(row[mine]).tolist():
                    text, size = words[block.ptr[r] : block.ptr[r + 1]], int(items.ptr[i + 1] - items.ptr[i])
                    found = long_tiles(text, items.words[items.ptr[i] : items.ptr[i + 1]])
                    covered = sum(x[2] for x in found)
                    if found and covered >= least * size:
                        out.append((r, i, covered / size, len(found), covered))
                continue
            run, k = spread(b - a)
            out += _tiled(row[mine][run], p[mine][run], own[a[run] + k], items, least)
    return out


def item_blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of bounded size, one at a time."""
    rows = benchmark.select(F.col(key).alias("id"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = 1 + int(size) // (5 * BLOCK_WORDS)
    for i in range(n):
        got = rows.where(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == i).orderBy("id", "t").collect()
        if got:
            yield Items([r.id for r in got], [r.t for r in got])


def _passes(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark's blocks, broadcast, for each pass over the documents."""
    context = benchmark.sparkSession.sparkContext
    yield from itertools.batched((context.broadcast(x) for x in item_blocks(benchmark)), BLOCKS)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The documents that hold a test item: key, item_id, coverage, n_tiles, n_words in tiles; one row per pair."""
    spark = docs.sparkSession
    configure(spark)
    kind = next(f.dataType for f in benchmark.schema if f.name == "item_id")
    schema = f"`{key}` {dict(docs.dtypes)[key]}, item_id {kind.simpleString()}, coverage double, n_tiles int, n_words int"
    arrow = to_arrow_type(kind)

    def mapped(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, text, lower=True, blank=PARTS, unspaced=True):
                for items in shared:
                    got = [x for x in matches(block, items.value, coverage) if x[2] >= coverage]
                    if got:
                        row, item, share, n, words = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([block.batch.column(key).take(pa.array(row)), pa.array([items.value.ids[i] for i in item], arrow), pa.array(share, pa.float64()), pa.array(n, pa.int32()), pa.array(words, pa.int32())], names=[key, "item_id", "coverage", "n_tiles", "n_words"])

        return run

    parts = [docs.select(key, text).mapInArrow(mapped(shared), schema) for shared in _passes(benchmark)]
    return functools.reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows of documents that hold no test item, with their own columns only."""
    configure(docs.sparkSession)

    def mapped(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks(batches, text, lower=True, blank=PARTS, unspaced=True):
                clean = np.ones(len(block), dtype=bool)
                for items in shared:
                    clean[[x[0] for x in matches(block, items.value, coverage) if x[2] >= coverage]] = False
                yield block.batch.filter(pa.array(clean))

        return run

    for shared in _passes(benchmark):
        docs = docs.mapInArrow(mapped(shared), docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
