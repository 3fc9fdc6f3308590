"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 11).

A fingerprint has a bit set where more than half of the hashes of its text's
shingles (repeats included) have it.  Two fingerprints that differ in at most
``RADIUS`` bits have a variant in common which differs from either in at most
half of them.  So every fingerprint emits all variants within half the radius,
variants are shuffled, and fingerprints that meet at one are a colliding pair,
which is verified.

A fingerprint has 2,081 such variants.  They are dealt by their first bits: per
possible start of a variant one row is shuffled, the start and the fingerprint
(37 rows where starts have 8 bits), and the task that has a start's rows makes
its variants from them.  That is the same shuffle on variants with a fiftieth
of the rows.  The length of starts follows from the number of distinct
fingerprints, so that a start has about ``VARIANTS`` variants.

Skew: copies are one fingerprint, by pre-aggregation.  Where fingerprints lie
close together, a start may have more than ``MOST`` variants; those starts are
made longer, on their own, until none has.  A whole variant has at most 2,081
fingerprints, so this ends.  At a variant each fingerprint is paired with the
smallest one only, not all with all: those at one variant are all linked, so no
component is lost.

Null or empty text, or one without words: fingerprint zero, linked like any
other.  Fewer words than a shingle: the whole sequence is one.  Each row has its
own fingerprint, also where ids are repeated or null; a component's name is the
smallest id in it (null if it has none).  An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from examloom.llm.blocks import blocks, configure
from examloom.llm.components import components
from examloom.storage import discard, stored

WIDTH, SEED, BITS = 4, 42, 64
RADIUS = 4
#: Variants made at once: of a start on average, and at most.
VARIANTS, MOST = 2_000_000, 6_000_000
#: Bits by which starts with too many variants grow.
DEEPER = 6


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Of a text in lower case."""
    return int(_majority([_hashes(text, width)])[0])


def _hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of the shingles of a text's words, joined by one blank."""
    words = b" ".join(text.split())
    if not words:
        return np.zeros(0, dtype=np.uint64)
    blank = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 0x20)
    if len(blank) + 1 < width:
        return np.array([xxhash.xxh64_intdigest(words, SEED)], dtype=np.uint64)
    start, end = [0, *(blank + 1).tolist()], [*blank.tolist(), len(words)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(words[a:b], SEED) for a, b in zip(start, end[width - 1 :], strict=False)), np.uint64, len(end) - width + 1)


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """For each list of hashes the bits that more than half of them have."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for i, h in enumerate(hashes):
        if len(h):
            ones = np.zeros(BITS, dtype=np.int64)
            for at in range(0, len(h), 1 << 16):
                ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", lower=True):
            data = block.data.tobytes()
            fps = _majority([_hashes(data[a:b], width) for a, b in zip(block.off[:-1].tolist(), block.off[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([block.batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    configure(docs.sparkSession)
    return docs.select(docs[key].alias("id"), docs[text].alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[key]}, fp long")


@functools.cache
def flips(bits: int, most: int) -> np.ndarray:
    """All ways to flip at most so many of the lowest bits, the fewest flips first."""
    return np.array([sum(1 << b for b in some) for k in range(min(most, bits) + 1) for some in itertools.combinations(range(bits), k)], dtype=np.uint64)


def start_bits(distinct: int, reach: int, variants: int) -> int:
    """The length of starts at which each has about so many variants."""
    ball = sum(math.comb(BITS, k) for k in range(reach + 1))
    return min(BITS, max(0, math.ceil(math.log2(max(1, distinct * ball / variants)))))


def _starts(bits: int, known: int, reach: int):
    """Rows (start, fp): starts of so many bits of the fingerprints' variants, whose first known bits are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = [flips(bits - known, k) for k in range(reach + 1)]
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            start = batch.column("start").to_numpy().view(np.uint64)
            own = _shifted(fp, BITS - bits)
            # What is left of the radius after the flips among the bits known.
            left = reach - np.bitwise_count(_shifted(fp, BITS - known) ^ start).astype(np.int64)
            first = (start << np.uint64(bits - known)) | (own & np.uint64((1 << (bits - known)) - 1))
            for k in range(reach + 1):
                some = np.flatnonzero(left == k)
                for at in range(0, len(some), 1 << 10):
                    part = some[at : at + (1 << 10)]
                    yield pa.RecordBatch.from_arrays([pa.array((first[part][:, None] ^ more[k]).ravel().view(np.int64)), pa.array(np.repeat(fp[part], len(more[k])).view(np.int64))], names=["start", "fp"])

    return run


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    return x >> np.uint64(by) if by < BITS else np.zeros_like(x)


def _weight(bits: int, reach: int) -> Column:
    """How many variants with its start a row makes."""
    rest = BITS - bits
    used = F.bit_count(F.shiftrightunsigned("fp", rest).bitwiseXOR(F.col("start"))) if bits else F.lit(0)
    out = F.lit(1)
    for e in range(reach):
        out = F.when(used == e, F.lit(sum(math.comb(rest, k) for k in range(reach - e + 1)))).otherwise(out)
    return out.cast("long")


def meetings(start: int, fps: np.ndarray, bits: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (smallest, other) of the distinct fingerprints that share a variant with the start."""
    reach, rest = radius // 2, BITS - bits
    fps = np.sort(fps)
    used = np.bitwise_count(_shifted(fps, rest) ^ np.uint64(start))
    low = fps & np.uint64((1 << rest) - 1)
    variant, owner = [], []
    for e in range(reach + 1):
        some = np.flatnonzero(used == e)
        change = flips(rest, reach - e)
        variant.append((low[some][:, None] ^ change).ravel())
        owner.append(np.repeat(some.astype(np.int32), len(change)))
    variant, owner = np.concatenate(variant), np.concatenate(owner)
    # Most variants occur once; a table of last places by a hash tells those that may occur again.
    slots = max(10, int(2 * len(variant)).bit_length())
    slot = ((variant * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - slots)).astype(np.int64)
    last = np.zeros(1 << slots, dtype=np.int32)
    last[slot] = np.arange(len(slot), dtype=np.int32)
    again = np.zeros(1 << slots, dtype=bool)
    again[slot[last[slot] != np.arange(len(slot), dtype=np.int32)]] = True
    some = np.flatnonzero(again[slot])
    some = some[np.lexsort((owner[some], variant[some]))]
    variant, owner = variant[some], owner[some].astype(np.int64)
    fresh = np.ones(len(variant), dtype=bool)
    fresh[1:] = variant[1:] != variant[:-1]
    least = owner[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(owner) else owner
    pairs = np.unique((least * len(fps) + owner)[least != owner])
    a, b = fps[pairs // len(fps)], fps[pairs % len(fps)]
    near = np.bitwise_count(a ^ b) <= radius
    return a[near], b[near]


def _met(bits: int, radius: int):
    """The meetings at each start, rows sorted by start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(start: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            a, b = meetings(start, np.concatenate(parts).view(np.uint64), bits, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        now, parts = None, []
        for batch in batches:
            start, fp = batch.column("start").to_numpy(), batch.column("fp").to_numpy()
            cut = [0, *(np.flatnonzero(start[1:] != start[:-1]) + 1).tolist(), len(start)] if len(start) else []
            for x, y in itertools.pairwise(cut):
                if parts and start[x] != now:
                    yield told(now & ((1 << BITS) - 1), parts)
                    parts = []
                now = int(start[x])
                parts.append(fp[x:y].copy())
        if parts:
            yield told(now & ((1 << BITS) - 1), parts)

    return run


def links(fps: DataFrame, radius: int = RADIUS, variants: int = VARIANTS, most: int = MOST) -> DataFrame:
    """Verified pairs (a, b) of distinct fingerprints fp, enough to connect all that are within the even radius of each other."""
    spark, reach = fps.sparkSession, radius // 2
    bits = start_bits(fps.count(), reach, variants)
    rows = fps.select(F.lit(0).cast("long").alias("start"), "fp").mapInArrow(_starts(bits, 0, reach), "start long, fp long")
    found, used = None, []
    while True:
        heavy = stored(rows.groupBy("start").agg(F.sum(_weight(bits, reach)).alias("w")).where(F.col("w") > most).select("start"), "starts")
        used.append(heavy)
        last = bits == BITS or heavy.isEmpty()
        light = rows if last else rows.join(heavy, "start", "left_anti")
        tasks = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        got = stored(light.repartition(tasks, "start").sortWithinPartitions("start").mapInArrow(_met(bits, radius), "a long, b long").distinct(), "links")
        used.append(got)
        found = got if found is None else found.unionByName(got)
        if last:
            out = stored(found.distinct(), "links")
            discard(*used)
            return out
        deeper = min(BITS, bits + DEEPER)
        rows = rows.join(heavy, "start", "left_semi").select("start", "fp").mapInArrow(_starts(deeper, bits, reach), "start long, fp long")
        bits = deeper


def near_classes(docs: DataFrame, radius: int = RADIUS, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, fp and component, the smallest id reachable over fingerprints that differ in at most so many bits."""
    if radius % 2:
        raise ValueError("the radius must be even")
    rows = stored(fingerprints(docs, width, key, text), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    linked = links(classes.select("fp"), radius)
    parts = components(linked.select("a", "b")).withColumnRenamed("node", "fp")
    placed = classes.join(parts, "fp", "left").withColumn("part", F.coalesce("component", "fp")).drop("component")
    names = placed.groupBy("part").agg(F.min("least").alias("component"))
    named = placed.join(names, "part").select("fp", "component")
    out = stored(rows.join(named, "fp").select("id", "fp", "component"), "components")
    discard(rows, classes, linked)
    return out


def op11_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    got = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
