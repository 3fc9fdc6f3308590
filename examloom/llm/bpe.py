"""BPE encoding and decoding by per-prefix dynamic programming (operator 5).

For each prefix of a pre-token there is one possible last token of its BPE
encoding.  A suffix automaton over the vocabulary yields the tokens that end
each prefix; a candidate is the one wanted if it may follow the last token of
the prefix before it, which a test on the two tokens' merge trees decides.
Back-pointers then give the exact ids, without running merges on the text.

The vocabulary is loaded from the tokenizer file at a path given as parameter.
Normalisation and pre-tokenisation are the tokenizer's own.  Words repeat, so
each Python worker keeps bounded caches of encoded words; the new ones of a block
go through the same steps side by side.  No shuffle.

Null or empty text gives no ids and empty decoded text.  Special tokens inside
a text become their ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from examloom.llm.automaton import SuffixAutomaton
from examloom.llm.blocks import KEPT, Recent, configure, slices

#: Bytes of a cache's younger half; the older half holds as many.
CACHED_WORDS = 80 << 20
CACHED_PIECES = 40 << 20
CACHED_PAIRS = 32 << 20
#: Where only ids are asked for, as in a pipeline whose earlier stages fill the executors' memory, caches have one part in so many of that room.
ROOM_PART = 3
#: Pre-tokens of at most so many symbols are encoded side by side, so many of a block's new ones at a time.
SIDE_BY_SIDE, TOGETHER = 64, 20_000
_INF = 1 << 60
#: Fixed value: the pre-tokenizer for which printable ASCII can be split by the pattern below instead.
_KNOWN = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_PLAIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall


class Vocabulary:
    """What encoding needs of a tokenizers BPE file with an end-of-word suffix; small, bounded by the vocabulary."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        spec = json.loads(text)
        model = spec["model"]
        self.digest = hashlib.sha1(text.encode()).hexdigest()
        self.rules = json.dumps(spec | {"added_tokens": [], "post_processor": None, "decoder": None, "model": model | {"vocab": {}, "merges": [], "unk_token": None}})
        suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        single = {c for t in ids for c in (t[: -len(suffix)] if suffix and t.endswith(suffix) else t)}
        self.symbol = {c: i for i, c in enumerate(sorted(single))}
        self.ends = len(self.symbol) if suffix else 0  # a symbol at a word's end is another one
        # By token: its text, the two tokens that its merge joins and that merge's rank; -1 for tokens without one.
        self.token = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for t, i in [*ids.items(), *self.special.items()]:
            self.token[i] = t
        self.left, self.right, self.rank = (array("i", [-1]) * len(self.token) for _ in range(3))
        self.merges: dict[int, int] = {}
        for i, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            t = ids[a + b]
            self.left[t], self.right[t], self.rank[t] = ids[a], ids[b], i
            self.merges[ids[a] << 32 | ids[b]] = i
        words = {}
        for t, i in ids.items():
            if t in self.special:
                continue
            end = bool(suffix) and t.endswith(suffix)
            w = [self.symbol[c] for c in (t[: -len(suffix)] if end else t)]
            if end:
                w[-1] += self.ends
            if self.rank[i] >= 0 or len(w) == 1:
                words[i] = tuple(w)
        # Only tokens that their own text encodes to can occur.
        whole: set[int] = set()
        for i in sorted(words, key=self.rank.__getitem__):
            if self.rank[i] < 0 or (self.left[i] in whole and self.right[i] in whole and self.fits(self.left[i], self.right[i], joined=self.rank[i])):
                whole.add(i)
        words = {i: w for i, w in words.items() if i in whole}
        automaton = SuffixAutomaton(list(words.values()))
        at: dict[int, list[tuple[int, int]]] = {}
        for i, w in words.items():
            at.setdefault(automaton.state(w), []).append((len(w), i))
        order = np.argsort(automaton.length, kind="stable").tolist()
        up = [0] * len(order)  # the next state with tokens on the way of suffix links
        for s in order[1:]:
            p = automaton.link[s]
            up[s] = p if p in at else up[p]
        # Transitions by state and symbol, in order; of each state also the nearest one with tokens, itself included.
        steps = sorted((s << 10 | c, t) for s, d in enumerate(automaton.next) for c, t in d.items())
        self.keys, self.to = array("q", [k for k, _ in steps]), array("i", [t for _, t in steps])
        self.link, self.length, self.up = array("i", automaton.link), array("i", automaton.length), array("i", up)
        self.near = array("i", [s if s in at else u for s, u in enumerate(up)])
        # The tokens of each state one after the other, longest first.
        tokens = [sorted(at.get(s, ()), reverse=True) for s in range(len(up))]
        self.first = array("i", np.cumsum([0, *map(len, tokens)]).tolist())
        self.sizes, self.tokens = (array("i", [y[k] for x in tokens for y in x]) for k in range(2))

    def _spine(self, t: int, side: array) -> list[tuple[int, int]]:
        """The tokens at one edge of t's merge tree from the single symbol up, each with the rank of the merge that ends it."""
        path = [(t, _INF)]
        while (rank := self.rank[t]) >= 0:
            t = side[t]
            path.append((t, rank))
        return path[::-1]

    def fits(self, u: int, t: int, joined: int = _INF) -> bool:
        """Whether no merge over the border of u and t comes before the merges that make them; joined: the rank of their own merge, if that is to be."""
        left, right, i, j = self._spine(u, self.right), self._spine(t, self.left), 0, 0
        while True:
            (x, p), (y, q) = left[i], right[j]
            r = self.merges.get(x << 32 | y, _INF)
            if p == q == _INF:
                return r == joined
            if r < _INF and r < p and r <= q:
                return False
            if p <= q:
                i += 1
            else:
                j += 1


class Encoder:
    """Encodes words, with caches; one per Python worker. decodes: words give their ids and decoded text, else their ids alone."""

    def __init__(self, v: Vocabulary, decodes: bool = True) -> None:
        from tokenizers import Tokenizer

        self.v, self.decodes = v, decodes
        library = Tokenizer.from_str(v.rules)
        self.normalise, self.pretokenise = library.normalizer, library.pre_tokenizer
        self.split = re.compile("(" + "|".join(map(re.escape, v.special)) + ")") if v.special else None
        self.plain = json.loads(v.rules)["pre_tokenizer"] == _KNOWN
        # Views of the vocabulary's arrays, for many words at a time.
        self.keys, self.to = np.frombuffer(v.keys, dtype=np.int64), np.frombuffer(v.to, dtype=np.int32)
        self.links, self.lengths, self.ups, self.nearest, self.first, self.sizes, self.tokens = (np.frombuffer(x, dtype=np.int32) for x in (v.link, v.length, v.up, v.near, v.first, v.sizes, v.tokens))
        self.codes = np.full(max(map(ord, v.symbol)) + 1, -1)
        self.codes[[ord(c) for c in v.symbol]] = list(v.symbol.values())
        self.marks = [x.encode() for x in v.special]
        self.cut: dict[bytes, list[str]] = {}  # of the block at hand: its new words' pre-tokens (no special tokens inside), and what these give
        self.ready: dict[str, bytes] = {}
        part = 1 if decodes else ROOM_PART
        self.pairs = Recent(CACHED_PAIRS // part, lambda k: v.fits(k >> 32, k & 0xFFFFFFFF))
        self.pieces = Recent(CACHED_PIECES // part, self.piece, lambda k, got: 4 * len(k) + len(got))
        if decodes:
            self.words = Recent(CACHED_WORDS, self.word, lambda k, got: 100 + len(k) + len(got[0]) + len(got[1]))
        else:
            self.words = Recent(CACHED_WORDS // part, self.ids, lambda k, got: len(k) + len(got))

    def piece(self, text: str) -> bytes:
        """Ids of one pre-token, as bytes."""
        if (known := self.ready.get(text)) is not None:
            return known
        w = list(map(self.v.symbol.__getitem__, text))
        w[-1] += self.v.ends
        v, fits = self.v, self.pairs
        keys, to, link, length, near, up, first, sizes, tokens = v.keys, v.to, v.link, v.length, v.near, v.up, v.first, v.sizes, v.tokens
        last, back = [-1] * (len(w) + 1), [0] * (len(w) + 1)
        s = n = i = 0
        for c in w:
            i += 1
            while (k := bisect_left(keys, s << 10 | c)) == len(keys) or keys[k] != s << 10 | c:
                s = link[s]
                n = length[s]
            s = to[k]
            n += 1
            t = near[s]
            while t:
                for q in range(first[t], first[t + 1]):
                    size, token = sizes[q], tokens[q]
                    if size <= n and (size == i or (u := last[i - size]) >= 0 and fits[u << 32 | token]):
                        last[i], back[i] = token, i - size
                        t = 0
                        break
                else:
                    t = up[t]
        out, i = [], len(w)
        while i:
            out.append(last[i])
            i = back[i]
        out.reverse()
        return array("I", out).tobytes()

    def together(self, pieces: list[str]) -> list[bytes]:
        """What ``piece`` gives for each, by the same steps on all side by side."""
        pieces_by = sorted(range(len(pieces)), key=lambda k: -len(pieces[k]))
        size = np.array([len(pieces[k]) for k in pieces_by])
        begin = np.cumsum(size) - size
        flat = self.codes[np.frombuffer("".join([pieces[k] for k in pieces_by]).encode("utf-32-le"), dtype="<u4")]
        flat[begin + size - 1] += self.v.ends
        n_all, longest = len(size), int(size[0])
        last, back = np.full((longest + 1, n_all), -1, dtype=np.int32), np.zeros((longest + 1, n_all), dtype=np.int8)
        s, n = np.zeros(n_all, dtype=np.int64), np.zeros(n_all, dtype=np.int64)
        for i in range(1, longest + 1):
            m = int(np.searchsorted(-size, -i, side="right"))  # those with a symbol here
            c, todo = flat[begin[:m] + i - 1], np.arange(m)
            while len(todo):
                key = s[todo] << 10 | c[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                s[todo[hit]] = self.to[at[hit]]
                todo = todo[~hit]
                s[todo] = self.links[s[todo]]
                n[todo] = self.lengths[s[todo]]
            n[:m] += 1
            todo, t = np.arange(m), self.nearest[s[:m]]
            q = self.first[t]
            while len(todo):
                token, wide = self.tokens[q], self.sizes[q]
                good = wide <= n[todo]
                u = last[np.maximum(i - wide, 0), todo]
                ask = np.flatnonzero(good & (wide != i))
                good[ask] = u[ask] >= 0
                ask = ask[good[ask]]
                if len(ask):
                    kinds, of = np.unique(u[ask].astype(np.int64) << 32 | token[ask], return_inverse=True)
                    good[ask] = np.array([self.pairs[k] for k in kinds.tolist()])[of]
                last[i, todo[good]], back[i, todo[good]] = token[good], i - wide[good]
                todo, t, q = todo[~good], t[~good], q[~good] + 1
                over = q == self.first[t + 1]
                t[over] = self.ups[t[over]]
                q[over] = self.first[t[over]]
                todo, t, q = (x[t > 0] for x in (todo, t, q))
        rows, at, ids, of = np.arange(n_all), size.copy(), [], []
        while len(rows):
            ids.append(last[at[rows], rows])
            of.append(rows)
            at[rows] = back[at[rows], rows]
            rows = rows[at[rows] > 0]
        of = np.concatenate(of)[::-1]
        data = np.concatenate(ids)[::-1][np.argsort(of, kind="stable")].astype("<u4").tobytes()
        end = np.cumsum(np.bincount(of, minlength=n_all)) * 4
        out = [b""] * len(pieces)
        for k, a, b in zip(pieces_by, [0, *end[:-1].tolist()], end.tolist(), strict=True):
            out[k] = data[a:b]
        return out

    def prepare(self, texts: list[bytes]) -> None:
        """Encode the new pre-tokens of a block's words side by side; they are kept until the next block."""
        self.cut, self.ready = {}, {}
        words, known, older = set().union(*(x.split() for x in texts)), self.words, self.words.old
        fresh: set[str] = set()
        split = self.split if any(m in x for m in self.marks for x in texts) else None
        for raw in words:
            if raw not in known and raw not in older:
                text = raw.decode()
                if split and split.search(text):
                    for part in split.split(text)[::2]:
                        fresh.update(self.parts(part) if part else ())
                else:
                    self.cut[raw] = parts = self.parts(text)
                    fresh.update(parts)
        wanted = [x for x in fresh if 0 < len(x) <= SIDE_BY_SIDE and x not in self.pieces and x not in self.pieces.old]
        wanted.sort(key=len)
        for k in range(0, len(wanted), TOGETHER):
            some = wanted[k : k + TOGETHER]
            self.ready.update(zip(some, self.together(some), strict=True))

    def parts(self, text: str) -> list[str]:
        """The pre-tokens of a text without special tokens."""
        if self.plain and text.isascii() and text.isprintable() and " " not in text:
            return [text.lower()] if text.isalpha() else _PLAIN_PARTS(text.lower())
        return [x for x, _ in self.pretokenise.pre_tokenize_str(self.normalise.normalize_str(text))]

    def ids(self, raw: bytes) -> bytes:
        """The bytes of the ids of one word without white space of ASCII."""
        if (parts := self.cut.get(raw)) is not None:
            return self.pieces[parts[0]] if len(parts) == 1 else b"".join([self.pieces[x] for x in parts])
        ids, text = [], raw.decode()
        for k, part in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                ids.append(self.v.special[part].to_bytes(4, "little"))
            elif part:
                ids += [self.pieces[x] for x in self.parts(part)]
        return b"".join(ids)

    def word(self, raw: bytes) -> tuple[bytes, bytes]:
        """The same and the bytes of the word's decoded text."""
        got = self.ids(raw)
        return got, " ".join(map(self.v.token.__getitem__, memoryview(got).cast("I"))).encode()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
KEPT.append(_ENCODERS)


def _words(v: Vocabulary, decodes: bool = True) -> Recent:
    key = v.digest, decodes
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(v, decodes)
        _ENCODERS[key].words.encoder = _ENCODERS[key]
    return _ENCODERS[key].words


def encode(text: bytes, words: Recent) -> tuple[bytes, bytes]:
    """The text's ids as little-endian 32-bit integers, and its decoded text in UTF-8."""
    got = [words[w] for w in text.split()]
    ids = b"".join([x[0] for x in got])
    parts = [x[1] for x in got]
    if b"" in parts:
        parts = [x for x in parts if x]
    return ids, b" ".join(parts)


def _mapped(key: str, text: str, shared, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(shared.value, kind != "ids")
        for batch in slices(batches, text):
            texts = [x or b"" for x in batch.column(text).cast(pa.large_binary()).to_pylist()]
            words.encoder.prepare(texts)
            if kind == "ids":
                ids = [b"".join([words[w] for w in x.split()]) for x in texts]
            else:
                ids, decoded = zip(*[encode(x, words) for x in texts], strict=True)
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            out = {key: batch.column(key), "n_tokens": pa.array(n)}
            if kind == "digests":
                out |= {name: pa.array([hashlib.sha256(x).hexdigest() for x in data], pa.string()) for name, data in (("ids_sha256", ids), ("decoded_sha256", decoded))}
            else:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))
            if kind == "texts":
                out["decoded"] = pa.array([x.decode() for x in decoded], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return run


#: What a row gets besides its key and n_tokens.
_TAILS = {"ids": "ids array<int>", "texts": "ids array<int>, decoded string", "digests": "ids_sha256 string, decoded_sha256 string"}


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digest: bool = False, decoded: bool = True) -> DataFrame:
    """For each row its ids and, with decoded, its decoded text; or with digest the SHA-256 digests of both."""
    spark = docs.sparkSession
    configure(spark)
    shared = spark.sparkContext.broadcast(Vocabulary(path))
    kind = "digests" if digest else "texts" if decoded else "ids"
    return docs.select(key, text).mapInArrow(_mapped(key, text, shared, kind), f"`{key}` {dict(docs.dtypes)[key]}, n_tokens long, {_TAILS[kind]}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path(), digest=True)
