"""Language identification by cross-parsing entropy (operator 9).

For each language a suffix automaton of labelled text is built.  A text is
parsed greedily into the longest phrases that occur in that text.  A letter that
does not occur there is a phrase of its own, and counts twice, as it has to be
spelled out besides.  The language that needs fewest phrases for the normalised
text wins.  Texts are lower-cased, everything but
letters becomes one blank.  Every text is parsed whole, from its first symbol to
its last: those of a batch side by side in numpy, and what is left of the few
longest of them one after the other.  Steps side by side are looked up in one
array by state and symbol, or in a hash table where the sample's alphabet is too
large for that.  No shuffle of texts.

The labelled text is a bounded sample: at most ``SAMPLE_DOCS`` documents and
``SAMPLE_CHARS`` symbols a language, of each document at most ``DOC_CHARS``,
drawn by a hash of the id over all learning rows.  With many languages the
symbols a language shrink so that all automata stay within ``TOTAL_CHARS``.  All
letters of the sample are told apart.

Null text, or text without a letter: ``und`` with score 0.  Ties go to the
language whose name sorts first.  With no labelled row all texts get ``und``.
Rows are judged one by one, whatever their id.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examloom.llm.automaton import SuffixAutomaton
from examloom.llm.blocks import configure

SAMPLE_DOCS = 300
SAMPLE_CHARS = 40_000
DOC_CHARS = 4_000
TOTAL_CHARS = 400_000
#: Texts parsed side by side: at most, and at least.
LANES, FEW = 8_192, 24
#: Steps of all states in one array, if it has at most so many entries of four bytes; a step's cost stands above its state.
DENSE, _COST = 1 << 25, 29
UNDECIDED = "und"

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _letters() -> np.ndarray:
    return np.packbits(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), dtype=bool))


class Model:
    """The languages' automata: their steps in one hash table, those from the roots in an array."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.langs = sorted(texts)
        self.letters = _letters()
        letter = np.unpackbits(self.letters).astype(bool)
        most = min(SAMPLE_CHARS, TOTAL_CHARS // max(1, len(self.langs)))
        normal = {}
        for lang in self.langs:
            points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts[lang]]
            normal[lang] = [np.where(letter[p], p, 0x20) for p in points]
        every = np.unique(np.concatenate([np.zeros(0, dtype="<u4"), *(p for ps in normal.values() for p in ps)]))
        # Codes: 0 is a letter that the sample has not, 1 the blank, then come the sample's letters.
        self.known = every[every != 0x20].astype(np.uint32)
        self.width = len(self.known) + 2
        code = self.codes()
        keys, to, size = [], [], 0
        self.base = np.zeros(len(self.langs), dtype=np.int64)
        self.first = np.zeros((len(self.langs), self.width), dtype=np.int64)
        for i, lang in enumerate(self.langs):
            words, left = [], most
            for p in normal[lang]:
                w = squeeze(code[p], np.array([0, len(p)]))[0][:left]
                left -= len(w)
                if len(w):
                    words.append(w.tolist())
            automaton = SuffixAutomaton(words)
            self.base[i], self.first[i] = size, size
            for s, step in enumerate(automaton.next):
                if s:
                    keys += [(size + s) * self.width + c for c in step]
                    to += [size + x for x in step.values()]
            for c, x in automaton.next[0].items():
                self.first[i, c] = size + x
            size += len(automaton.next)
        self.size, self.every = size, None
        self.keys, self.to = self._table(np.array(keys, dtype=np.int64), np.array(to, dtype=np.int32))

    def _slot(self, key: np.ndarray, bits: int) -> np.ndarray:
        return ((key.astype(np.uint64) * _SPREAD) >> np.uint64(64 - bits)).astype(np.int64)

    def _table(self, keys: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Open addressing, a quarter full at most; -1 marks an empty slot."""
        self.bits = max(4, int(4 * len(keys)).bit_length())
        table, value = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int32)
        slot = self._slot(keys, self.bits)
        while len(keys):
            _, one = np.unique(slot, return_index=True)
            free = one[table[slot[one]] < 0]
            table[slot[free]], value[slot[free]] = keys[free], to[free]
            rest = np.ones(len(keys), dtype=bool)
            rest[free] = False
            keys, to, slot = keys[rest], to[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)
        return table, value

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of states by language (rows) and text: the next ones, and what a phrase that begins costs: 1, or 2 for a letter never seen."""
        key = (state * self.width + code).ravel()
        slot = self._slot(key, self.bits)
        at = self.keys[slot]
        out = np.where(at == key, self.to[slot], -1)
        more = np.flatnonzero((at != key) & (at >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) & (len(self.keys) - 1)
            at = self.keys[slot[more]]
            good = at == key[more]
            out[more[good]] = self.to[slot[more[good]]]
            more = more[~good & (at >= 0)]
        out = out.reshape(state.shape)
        fresh = out < 0
        out = np.where(fresh, self.first[:, code], out)
        return out, fresh.astype(np.int64) + (out == self.base[:, None])

    def dense(self) -> np.ndarray | None:
        """By state and code the next state, times width, and what a phrase that begins costs; None if that is too much.  Made where it is used."""
        if self.every is None and self.size * self.width <= DENSE:
            fresh = self.first * self.width | (1 + (self.first == self.base[:, None])) << _COST
            every = np.repeat(fresh.astype(np.int32), np.diff(self.base, append=self.size), axis=0).ravel()
            used = self.keys >= 0
            every[self.keys[used]] = self.to[used] * np.int32(self.width)
            self.every = every
        return self.every

    def steps(self) -> list[dict[int, int]]:
        """The hash table's steps as dictionaries by language."""
        used = np.flatnonzero(self.keys >= 0)
        lang = np.searchsorted(self.base, self.keys[used] // self.width, side="right") - 1
        return [dict(zip(self.keys[x].tolist(), self.to[x].tolist(), strict=True)) for x in (used[lang == i] for i in range(len(self.langs)))]

    def codes(self) -> np.ndarray:
        """Code of each code point."""
        out = np.where(np.unpackbits(self.letters).astype(bool), 0, 1).astype(np.int32)
        out[self.known] = np.arange(2, 2 + len(self.known))
        return out


def squeeze(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes with runs of blanks made one, and their new bounds."""
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
    keep[bounds[:-1][bounds[:-1] < len(codes)]] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], place[bounds]


def _tail(model: Model, lang: int, steps: dict[int, int], state: int, codes: np.ndarray) -> int:
    """The cost of the phrases that begin in the rest of a text."""
    get, width, first, n, root = steps.get, model.width, model.first[lang].tolist(), 0, int(model.base[lang])
    for at in range(0, len(codes), 1 << 16):
        for c in codes[at : at + (1 << 16)].tolist():
            x = get(state * width + c)
            if x is None:
                x = first[c]
                n += 1 + (x == root)
            state = x
    return n


def phrases(model: Model, steps: list[dict[int, int]], codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Phrases of each text (rows) in each language (columns), letters never seen counted twice."""
    sizes, every = np.diff(bounds), model.dense()
    out = np.zeros((len(sizes), len(model.langs)), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")  # long texts first: those still at work stand in front
    for at in range(0, len(order), LANES):
        some = order[at : at + LANES]
        start, size = bounds[:-1][some], sizes[some]
        state = np.repeat(model.base[:, None], len(some), axis=1)
        n = np.zeros(state.shape, dtype=np.int64)
        together = int(size[FEW]) if len(some) > FEW else 0
        above = np.searchsorted(-size, -np.arange(together), side="left").tolist()  # sizes above i
        if every is not None:
            state = (state * model.width).astype(np.int32)
        for i, live in enumerate(above):
            code = codes[start[:live] + i]
            if every is not None:
                got = every[state[:, :live] + code]
                n[:, :live] += got >> _COST
                np.bitwise_and(got, (1 << _COST) - 1, out=state[:, :live])
                continue
            state[:, :live], cost = model.step(state[:, :live], code)
            n[:, :live] += cost
        if every is not None:
            state //= model.width
        for k in np.flatnonzero(size > together).tolist():
            for lang in range(len(model.langs)):
                n[lang, k] += _tail(model, lang, steps[lang], int(state[lang, k]), codes[start[k] + together : start[k] + size[k]])
        out[some] = n.T
    return out


def _mapped(key: str, text: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        steps = model.steps()
        code, letter = model.codes(), np.unpackbits(model.letters).astype(bool)
        names = np.array([*model.langs, UNDECIDED], dtype=object)
        for batch in batches:
            texts = [(x or "").lower() for x in batch.column(text).to_pylist()]
            points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            has = np.diff(np.concatenate([[0], np.cumsum(letter[points])])[bounds]) > 0
            score = np.zeros(len(texts))
            pick = np.full(len(texts), len(model.langs))
            if model.langs and has.any():
                n = phrases(model, steps, *squeeze(code[points], bounds))
                best = n.argmin(axis=1)
                pick = np.where(has, best, pick)
                if len(model.langs) > 1:
                    two = np.partition(n, 1, axis=1)[:, :2]
                    score = np.where(has, 1 - two[:, 0] / np.maximum(two[:, 1], 1), 0.0)
                else:
                    score = has.astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(names[pick].tolist(), pa.string()), pa.array(score)], names=[key, "lang_pred", "score"])

    return run


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The model of a bounded sample of the labelled rows."""
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull())
    n = rows.groupBy("l").agg(F.count("*").alias("n"))
    # A share of each language's rows that holds more than the sample wanted, then the first of these by hash.
    dice = rows.join(F.broadcast(n), "l").withColumn("h", F.xxhash64(F.lit(7), "k")).where(F.pmod("h", F.lit(1 << 20)) * F.col("n") < F.lit(3 * SAMPLE_DOCS << 20))
    few = dice.select("l", "h", "k", F.substring("t", 1, DOC_CHARS).alias("t")).withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "k")))
    texts: dict[str, list[str]] = {}
    for r in few.where(F.col("r") <= SAMPLE_DOCS).orderBy("l", "r").collect():
        texts.setdefault(r.l, []).append(r.t)
    return Model(texts)


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the language and a score: by how much the second best needs more phrases."""
    configure(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(key, text).mapInArrow(_mapped(key, text, shared), f"`{key}` {dict(docs.dtypes)[key]}, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = fit(docs.where(~held_out))
    return predicted(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
