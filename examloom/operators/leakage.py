"""Test items that leak into documents: every document against every item, by a lossless choice of candidates."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from examloom.functions.text import leak_text, significant_tokens

BLOCK_WORDS = 1_000_000


class Items:
    """One block of items (id, normalised text, weighty words), indexed for both ways to leak.

    Every weighty word lists its items with its number there, so one sum over a
    document's words tells of all items how many of their words it has.  A text
    of three words or more that stands in a document has its inner words there
    as whole words, so it is looked for where the rarest of these is; shorter
    texts have no such word and are looked for in every document.
    """

    def __init__(self, rows: list[tuple]) -> None:
        self.ids = [r[0] for r in rows]
        self.texts = [r[1] for r in rows]
        self.enough = np.array([0.8 * len(r[2]) if len(r[2]) >= 3 else np.inf for r in rows])
        lists: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, r in enumerate(rows):
            for w, n in Counter(r[2]).items():
                lists[w].append((i, n))
        self.words = {w: np.array(x).T for w, x in lists.items()}
        self.by_word: dict[str, list[int]] = defaultdict(list)
        self.short: list[int] = []
        used = Counter(w for t in self.texts for w in set(t.split(" ")))
        for i, text in enumerate(self.texts):
            if len(text) >= 8:
                inner = text.split(" ")[1:-1]
                if inner:
                    self.by_word[min(inner, key=lambda w: (used[w], w))].append(i)
                else:
                    self.short.append(i)

    def leaks(self, q: str) -> list[int]:
        """The items that leak into a normalised document, as answer_leaks() has it."""
        known = set(q.split(" "))
        some = {i for w in known & self.by_word.keys() for i in self.by_word[w]}.union(self.short)
        found = {i for i in some if self.texts[i] in q}
        hits = [self.words[w] for w in known & self.words.keys()]
        if hits:
            item, n = np.concatenate(hits, axis=1)
            found.update(np.flatnonzero(np.bincount(item, n, len(self.ids)) >= self.enough).tolist())
        return sorted(found)


def item_blocks(items: DataFrame, key: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks of bounded size; texts without letters and digits leak nowhere."""
    rows, n = [], 0
    for r in items.select(F.col(key).alias("k"), leak_text(text).alias("a"), significant_tokens(text).alias("w")).where("a <> ''").toLocalIterator():
        rows.append((r.k, r.a, r.w))
        n += r.a.count(" ") + 1
        if n >= block_words:
            yield Items(rows)
            rows, n = [], 0
    if rows:
        yield Items(rows)


def leaking_pairs(docs: DataFrame, items: DataFrame, key: str, item_key: str, text: str, item_text: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All pairs (item_key, key) for which answer_leaks(text, item_text) holds; documents are not shuffled, each block of items is one pass."""
    kind, item_kind = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    kinds = to_arrow_type(items.schema[item_key].dataType), to_arrow_type(docs.schema[key].dataType)
    some = docs.select(F.col(key).alias("k"), leak_text(text).alias("q")).where("q <> ''")

    def mapped(shared):
        def run(batches):
            block = shared.value
            for b in batches:
                found = [(block.ids[i], k) for k, q in zip(b.column("k").to_pylist(), b.column("q").to_pylist(), strict=True) for i in block.leaks(q)]
                yield pa.RecordBatch.from_pydict({"i": pa.array([x[0] for x in found], kinds[0]), "k": pa.array([x[1] for x in found], kinds[1])})

        return run

    out = docs.sparkSession.createDataFrame([], f"i {item_kind}, k {kind}")
    for block in item_blocks(items, item_key, item_text, block_words):
        out = out.unionByName(some.mapInArrow(mapped(docs.sparkSession.sparkContext.broadcast(block)), f"i {item_kind}, k {kind}"))
    return out.select(F.col("i").alias(item_key), F.col("k").alias(key))
