"""Token counts by a map-side two-tier lookup (operator 10).

Tier one is a compact table of the lengths, in tokens, of frequent pre-tokens,
broadcast to all workers (at most ``FREQUENT`` entries of at most
``FREQUENT_BYTES`` bytes).  Tier two is a cache of bounded bytes in each worker,
which the model itself fills for the rest.  No pre-token is shuffled: the table
comes from a sample of about ``SAMPLED`` texts of all rows, counted in one task.
The table decides speed only, never a count: each of its lengths is the model's.

Why pre-tokens may be counted alone: in such a model a blank opens a piece and
never stands inside one after another character, and no piece holds a line
feed.  ``Lengths`` checks this of its model and else whole texts are counted.

Null or empty text has no tokens.  Texts with the model's own blank mark inside
are counted whole.  Every row is counted by itself, repeated ones and ones
without id too; an empty table gives an empty result.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from examloom.llm.blocks import KEPT, Recent, configure

FREQUENT = 65_536
FREQUENT_BYTES = 48
#: Rows of the sample that the table of frequent pre-tokens comes from.
SAMPLED = 10_000
COUNTED = 300_000
#: Bytes of each of the two halves of a worker's cache.
CACHED = 32 << 20
LIMIT = 4096

_MARK = "▁"
_MARK_BYTES = _MARK.encode()


def pretokens(text: bytes) -> list[bytes]:
    """The pieces of a text between which nothing merges: blanks but one and the characters after them; each line feed opens one."""
    parts = text.replace(b"\n", b" \n").split(b" ")
    if b"" not in parts:
        return parts
    out, blanks = [], 0
    for x in parts:
        if not x:
            blanks += 1
        elif blanks and x[0] == 10:
            out += (b" " * (blanks - 1), x)
            blanks = 0
        else:
            out.append(b" " * blanks + x)
            blanks = 0
    if blanks:
        out.append(b" " * (blanks - 1))
    return out


class Lengths(Recent):
    """Tier two: lengths of pre-tokens by the model itself, in a cache of bounded bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        super().__init__(CACHED, self.count, lambda k, _: len(k))
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces)
        self.splits = plain and self.model.encode("a  b\n c") == [*self.model.encode("a"), *self.model.encode(" b"), *self.model.encode("\n")[1:], *self.model.encode("c")]

    def count(self, text: bytes) -> int:
        """Tokens of one pre-token."""
        n = len(self.model.encode(text.decode(), num_threads=1))
        return n - 1 if text[:1] == b"\n" else n or 1


_TIER_TWO: dict[bytes, Lengths] = {}
KEPT.append(_TIER_TWO)


def tokens(text: bytes, frequent: dict[bytes, int], rest: Lengths) -> int:
    if not text:
        return 0
    if not rest.splits or _MARK_BYTES in text:
        return len(rest.model.encode(text.decode(), num_threads=1))
    get = frequent.get
    return sum([get(x) or rest[x] for x in pretokens(text)])


def _counted(text: str, most: int):
    """One task's frequent pre-tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: collections.Counter[bytes] = collections.Counter()
        for batch in batches:
            for value in batch.column(text).cast(pa.large_binary()):
                seen.update(x for x in pretokens(value.as_py() or b"") if len(x) <= FREQUENT_BYTES)
                if len(seen) > COUNTED:
                    seen = collections.Counter(dict(seen.most_common(COUNTED // 2)))
        top = [k for k, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most] if k]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.binary())], names=["pretoken"])

    return run


def frequent_pretokens(docs: DataFrame, text: str = "text", most: int = FREQUENT, rows: int = SAMPLED) -> list[bytes]:
    """The most frequent short pre-tokens of a sample of about so many rows, drawn from all rows alike."""
    configure(docs.sparkSession)
    n = docs.count()
    some = docs.select(text)
    if n > rows:
        some = some.sample(rows / n, seed=11)
    return [bytes(r.pretoken) for r in some.repartition(1).mapInArrow(_counted(text, most), "pretoken binary").collect()]


def counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row its bytes, its tokens and whether they exceed the limit."""
    spark = docs.sparkSession
    configure(spark)
    with open(path, "rb") as f:
        model = f.read()
    tier_two = Lengths(model)
    table = {k: tier_two.count(k) for k in frequent_pretokens(docs, text)}
    shared = spark.sparkContext.broadcast((model, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent = shared.value
        if model not in _TIER_TWO:
            _TIER_TWO[model] = Lengths(model)
        rest = _TIER_TWO[model]
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(text).cast(pa.large_binary())]
            n = [tokens(x, frequent, rest) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, n_bytes long, n_tokens long, over_limit boolean")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
