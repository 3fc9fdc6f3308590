"""Quality rules by repetition coverage (operator 8).

Rolling hashes of several n-gram lengths, taken in numpy over a block of
documents at a time, find the words that lie inside n-grams occurring twice or
more in their document, and the lines that repeat an earlier line.  The rules
measure which share of a document's characters those words and lines hold.
No shuffle: every document is judged by itself.

Null or empty text: all counts are 0 and the row is rejected (fewer than
``MIN_WORDS`` words).  Repeated rows are judged one by one; other columns,
whatever their names, pass through untouched in :func:`annotate`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from examloom.llm.blocks import Block, Rolling, blocks, configure, covered, range_hashes

MIN_WORDS = 20
WINDOW = 8
MAX_WINDOW_PERCENT = 30
#: Largest share of word characters inside repeated n-grams, by n-gram length.
MAX_NGRAM_SHARE = {5: 0.40, 8: 0.30, 10: 0.30}
#: Largest share of word characters in lines equal to an earlier line.
MAX_LINE_SHARE = 0.30

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    + ", ".join(f"share_{n} double" for n in MAX_NGRAM_SHARE)
    + ", line_share double, base_failed boolean, kept boolean"
)

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def repeated(keys: np.ndarray, later_only: bool = False) -> np.ndarray:
    """Places of the keys that occur twice or more (or of all but their first occurrence)."""
    order = np.argsort(keys, kind="stable" if later_only else None)
    same = keys[order[1:]] == keys[order[:-1]]
    flag = np.zeros(len(keys), dtype=bool)
    flag[order[1:][same]] = True
    if not later_only:
        flag[order[:-1][same]] = True
    return np.flatnonzero(flag)


def measure(block: Block) -> dict[str, np.ndarray]:
    """All the measures of a block's documents."""
    words = block.word_hashes()
    data, off, ptr = block.data, block.off, block.ptr
    n_words = block.count
    letters = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=letters[1:])
    chars = letters[block.end] - letters[block.start]
    out = {"n_words": n_words, "word_chars": block.per_doc(chars, ptr), "n_symbols": block.per_doc(_SYMBOL[data], off)}
    doc = block.doc_of_words()
    salt = (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)

    # Lines: cut after each \n and at each document's edges, kept if they hold a word.
    cut = np.union1d(np.flatnonzero(data == 0x0A) + 1, off)
    begin, stop = cut[:-1], cut[1:].copy()
    if len(begin):
        stop[data[stop - 1] == 0x0A] -= 1
    first = np.searchsorted(block.start, begin)
    after = np.searchsorted(block.start, stop)
    begin, stop, first, after = (x[after > first] for x in (begin, stop, first, after))
    owner = np.searchsorted(off, begin, side="right") - 1
    key = range_hashes(data, begin, stop) ^ ((owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    dup = repeated(key, later_only=True)
    out["n_dup_lines"] = np.bincount(owner[dup], minlength=len(block))
    so_far = np.concatenate([[0], np.cumsum(chars)])
    total = np.maximum(out["word_chars"], 1)
    out["line_share"] = np.bincount(owner[dup], weights=(so_far[after] - so_far[first])[dup], minlength=len(block)) / total

    grams = Rolling(words)
    left = ptr[1:][doc] - np.arange(len(doc))
    for n in sorted({*MAX_NGRAM_SHARE, WINDOW}):
        at = np.flatnonzero(left >= n)
        inside = covered(at[repeated(grams.windows(n)[at] ^ salt[at])], n, len(doc))
        if n == WINDOW:
            out["n_repeat_words"] = block.per_doc(inside, ptr)
        if n in MAX_NGRAM_SHARE:
            out[f"share_{n}"] = block.per_doc(np.where(inside, chars, 0), ptr) / total
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_WINDOW_PERCENT * n_words)
    bad = out["line_share"] > MAX_LINE_SHARE
    for n, most in MAX_NGRAM_SHARE.items():
        bad |= out[f"share_{n}"] > most
    out["kept"] = ~(out["base_failed"] | bad)
    return out


def _measured(keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for block in blocks(batches, text):
            got = measure(block)
            yield pa.RecordBatch.from_arrays([*(block.batch.column(c) for c in keep), *(pa.array(got[n]) for n in names)], names=[*keep, *names])

    return run


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and the measures of every row's text."""
    configure(docs.sparkSession)
    some = docs.select(key, text)
    return some.mapInArrow(_measured([key], text), f"`{key}` {dict(docs.dtypes)[key]}, {SCHEMA}")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that every rule accepts, with their own columns only."""
    configure(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            yield block.batch.filter(pa.array(measure(block)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "line_share", *(f"share_{n}" for n in MAX_NGRAM_SHARE))
