"""MinHash near-duplicates with HyperMinHash sketches (operator 6).

A document is the set of its distinct word shingles.  Each set's hashes fall
into ``BUCKETS`` buckets; per bucket the smallest hash is stored as its count
of leading zeros and the next ``MANTISSA`` bits, two bytes in all.  Bands of
``ROWS`` registers propose candidates; a Jaccard estimate from the registers,
corrected for chance collisions, drops those that are clearly too far; the rest
are confirmed on the full sets.  Links and classes are thus exact but for
candidates that no band proposes: for a pair right at the threshold s the
chance is (1 - s**ROWS)**BANDS, 5e-11 at 0.85 and 5e-8 at 0.8.

Skew: equal sets are first merged into one class, by pre-aggregation.  Within a
bucket each class is compared with one leader only, its most typical member;
classes that are connected so need no further comparison.  Classes of one
leader that are still apart are then compared where their common items with the
leader, or rare items besides (a prefix filter, with what each has after the item
and what both have of the leader's), allow for enough similarity; all are exact
bounds.  So a group of m near copies costs about m comparisons,
not their square, and no candidate is dropped.  Both waves of pairs are dropped
by the registers' estimate first and then confirmed on the full sets.

Empty buckets of small sets borrow the register of the next full one, so all
bands are usable; small sets also carry their size class in the band's key.

Null or empty text: no shingles, linked with nothing.  Fewer words than a
shingle: the whole sequence is one.  Ids are integers below 2**62.  Rows with
equal ids count as one document, linked with all that any of its texts is
similar to.  A row without
id is a document that links others; its class is the smallest id of its group,
null if none of them has one.  Sets are compared by 54 bits of a hash of each
shingle, and counted as equal by their size and two sums of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from examloom.llm.blocks import Block, Rolling, blocks, configure, mix
from examloom.llm.components import components
from examloom.storage import discard, stored

BUCKETS, MANTISSA = 128, 10
ROWS, BANDS = 4, 32
#: At most so many items of a leader's followers, each had by OFTEN of them or more, come late in the prefix filter's order.
HOT, OFTEN = 16, 32
#: Standard deviations below the threshold at which an estimate is clearly too low.
SIGMAS = 6
#: Sets of more shingles than this are not told apart by size in the bands.
SIZED = 256
#: Classes of rows without id only are named by numbers from here on; ids are smaller.
NAMELESS = 1 << 62
_TAIL = 37  # bits of a hash below its bucket's


def shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block, sorted by row and hash: rows, hashes and where each row begins."""
    words = block.word_hashes()
    rolling, doc = Rolling(words), block.doc_of_words()
    grams = rolling.windows(width)
    at = np.flatnonzero(block.ptr[1:][doc] - np.arange(len(doc)) >= width)
    short = np.flatnonzero((block.count > 0) & (block.count < width))
    row = np.concatenate([doc[at], short])
    h = np.concatenate([grams[at], rolling.ranges(block.ptr[:-1][short], block.ptr[1:][short])])
    bits = np.uint64(max(len(block) - 1, 0).bit_length())
    key = np.unique((row.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits)) if bits else np.unique(h)
    row = (key >> (np.uint64(64) - bits)).astype(np.int64) if bits else np.zeros(len(key), dtype=np.int64)
    h = key << bits if bits else key
    return row, h, np.searchsorted(row, np.arange(len(block) + 1))


def sketch(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Registers of n rows: 0 if empty, else leading zeros + 1 and mantissa."""
    top = h >> np.uint64(64 - 7 - _TAIL)
    slot = row * BUCKETS + (top >> np.uint64(_TAIL)).astype(np.int64)
    first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, dtype=bool)
    low = (top[first] & np.uint64((1 << _TAIL) - 1)).astype(np.int64)  # the smallest of its bucket, as hashes are sorted
    zeros = _TAIL - np.frexp(low.astype(np.float64))[1].astype(np.int64)
    mantissa = ((low << (zeros + 1)) & ((1 << _TAIL) - 1)) >> (_TAIL - MANTISSA)
    out = np.zeros(n * BUCKETS, dtype=np.uint16)
    out[slot[first]] = ((zeros + 1) << MANTISSA) | mantissa
    return out.reshape(n, BUCKETS)


def band_keys(registers: np.ndarray, sizes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bands, and the rows they are of."""
    n = len(registers)
    full = np.concatenate([registers, registers], axis=1) != 0
    place = np.where(full, np.arange(2 * BUCKETS), 4 * BUCKETS)
    nearest = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :BUCKETS]
    away = nearest - np.arange(BUCKETS)
    value = registers[np.arange(n)[:, None], nearest % BUCKETS].astype(np.uint64) | (away.astype(np.uint64) << np.uint64(16))
    key = np.tile(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (n, 1))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + value.reshape(n, BANDS, ROWS)[:, :, r])
    most = int(math.log(SIZED) / -math.log(share))
    level = np.minimum((np.log(sizes) / -math.log(share) + 1e-9).astype(np.int64), most)
    rows = np.arange(n)
    twice = level < most
    level, rows = np.concatenate([level, level[twice] + 1]), np.concatenate([rows, rows[twice]])
    keys = mix(key[rows] ^ (level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))[:, None])
    return keys.ravel().view(np.int64), np.repeat(rows, BANDS)


def _chance(a: np.ndarray, b: np.ndarray) -> float:
    """Expected share of registers that are equal by chance, for two sets of the given sizes per bucket."""
    # Minima of k uniform hashes lie in [x, x + d) with chance about k d exp(-k x); sum over the cells of all registers.
    zeros = np.arange(_TAIL + 1)[:, None]
    low = 2.0 ** -(zeros + 1.0) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    wide = 2.0 ** -(zeros + 1.0) / (1 << MANTISSA)
    p = a * wide * np.exp(-a * low)
    q = b * wide * np.exp(-b * low)
    return float((p * q).sum())


def estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and the number of buckets they rest on."""
    used = ((x | y) != 0).sum(axis=1)
    same = ((x == y) & (x != 0)).sum(axis=1)
    # Chance collisions depend on the sizes slowly: taken at powers of two.
    level = lambda n: np.round(np.log2(np.maximum(n / BUCKETS, 1 / BUCKETS))).astype(int)
    pairs = np.stack([level(nx), level(ny)], axis=1)
    kinds, of = np.unique(pairs, axis=0, return_inverse=True)
    chance = np.array([_chance(2.0**a, 2.0**b) for a, b in kinds])[of.ravel()] if len(kinds) else np.zeros(0)
    return np.clip((same - used * chance) / np.maximum(used * (1 - chance), 1e-9), 0, 1), used


def sketches(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """id, th (the text's hash), n (set size), two hashes of the set, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", lower=True):
            row, h, bounds = shingles(block, width)
            # Sets are compared by hashes cut to 54 bits, which is what a block of many rows has.
            h &= ~np.uint64((1 << 10) - 1)
            one, two = mix(h), mix(h ^ np.uint64(0xA5A5A5A55A5A5A5A))
            sums = [np.diff(np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])[bounds]).view(np.int64) for x in (one, two)]
            regs = sketch(row, h, len(block))
            yield pa.RecordBatch.from_arrays([*(block.batch.column(c) for c in ("id", "th")), pa.array(np.diff(bounds)), *map(pa.array, sums), pa.array([x.tobytes() for x in regs], pa.binary())], names=["id", "th", "n", "s1", "s2", "regs"])

    return docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).mapInArrow(run, "id long, th long, n long, s1 long, s2 long, regs binary")


def _banded(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
                keys, rows = band_keys(regs, batch.column("n").to_numpy(), share)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(batch.column("rep").to_numpy()[rows])], names=["band", "rep"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", lower=True):
            row, h, bounds = shingles(block, width)
            h &= ~np.uint64((1 << 10) - 1)
            regs = sketch(row, h, len(block))
            yield pa.RecordBatch.from_arrays([block.batch.column("rep"), pa.array([x.tobytes() for x in regs], pa.binary()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))], names=["id", "regs", "items"])

    return run


def _likely(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS) for c in ("ra", "rb"))
                j, used = estimate(x, y, batch.column("na").to_numpy(), batch.column("nb").to_numpy())
                good = j >= share - SIGMAS * np.sqrt(share * (1 - share) / np.maximum(used, 1))
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def near_classes(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, n (size of its set) and component, the smallest id reachable over links of at least the similarity."""
    configure(docs.sparkSession)
    share = percent / 100
    rows = stored(sketches(docs, width, key, text), "sketches")
    one = ["n", "s1", "s2"]
    # A class is named by its smallest id, or by a number above all ids if it has none.
    name = F.coalesce("r.id", F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(*one), 2)).alias("rep")
    grouped = rows.where("n > 0").groupBy(*one).agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "th")).alias("r"), F.first("regs").alias("regs"))
    reps = stored(grouped.select(*one, name, F.col("r.id").alias("rid"), F.col("r.th").alias("rth"), "regs"), "classes")
    # Smaller sets than this link with equal ones only.
    wide = reps.where(F.col("n") >= math.floor(share / (1 - share) + 1e-9))
    bands = wide.select("rep", "n", "regs").mapInArrow(_banded(share), "band long, rep long")
    size = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    sized = stored(bands.join(size, "band"), "bands")
    # The leader of a bucket is its most typical class, the one with most company over all its buckets.
    typical = sized.groupBy("rep").agg(F.sum("size").alias("company"))
    known = stored(sized.join(typical, "rep"), "bands")
    lead = known.groupBy("band").agg((-F.max(F.struct("company", (-F.col("rep")).alias("r")))["r"]).alias("leader"))
    shared = known.select("band", "rep").join(lead, "band")
    members = shared.select("rep").distinct()
    wanted = reps.join(members, "rep", "left_semi").select("rep", "rid", "rth")
    found = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    found = found.join(wanted, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("rep", "text")
    sets = stored(found.mapInArrow(_sets(width), "id long, regs binary, items array<long>"), "sets")
    twice = sets.groupBy("id").count().where("count > 1")
    if not twice.isEmpty():  # rows with id and text equal
        sets, every = stored(sets.dropDuplicates(["id"]), "sets"), sets
        discard(every)
    facts = reps.join(members, "rep", "left_semi").select(F.col("rep"), "n", "regs")

    def compared(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) on their full sets: sizes na, nb and common items i; and a's registers."""
        x = pairs.join(sets.select(F.col("id").alias("a"), F.col("items").alias("xa"), F.col("regs").alias("ra")), "a").join(sets.select(F.col("id").alias("b"), F.col("items").alias("xb")), "b")
        both = F.size(F.array_intersect("xa", "xb"))
        return x.select("a", "b", "ra", "xa", "xb", F.size("xa").alias("na"), F.size("xb").alias("nb"), both.alias("i"))

    similar = 100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))

    def links(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that are similar enough: by size, by estimate, then on the sets."""
        x = pairs.join(facts.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a")
        x = x.join(facts.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
        return confirmed(likely(x))

    def likely(x: DataFrame) -> DataFrame:
        """Those of the pairs (a, b, na, nb, ra, rb) that sizes and estimates allow."""
        return x.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "na", "nb", "ra", "rb").mapInArrow(_likely(share), "a long, b long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return compared(pairs).where(similar).select("a", "b").distinct()

    # First wave: every class with the leaders of its buckets.
    pairs = stored(shared.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    discard(sized)
    linked = stored(links(pairs), "links")
    part = components(linked)
    # Classes of one leader that are still in different components: they can only be similar if they share an item that
    # the leader lacks, or if what both have in common with the leader is enough by itself.
    placed = pairs.join(part.withColumnRenamed("node", "a"), "a", "left").withColumn("c", F.coalesce("component", "a")).drop("component")
    mixed = placed.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("b")
    # How much they have in common with the leader, and what they have besides, of which as many items as the prefix
    # filter needs (two sets that are similar enough share one of these).
    left = placed.join(mixed, "b", "left_semi")
    prefix = F.col("na") - F.ceil(F.lit(percent) * F.col("na") / 100) + 1
    extra = F.array_except("xa", "xb")
    met = compared(left.select("a", "b")).select("a", "b", "ra", "na", "nb", "i", F.slice(F.array_sort(extra), F.lit(1), (prefix + HOT).cast("int")).alias("extra"), prefix.cast("int").alias("p"))
    apart = stored(met.join(left, ["a", "b"]), "apart")
    # The prefix filter takes any order of items that is the same for all: here what the leader lacks comes first, but
    # for the few items that most others have, and what the leader has comes last.
    items = apart.select("b", F.explode("extra").alias("item"), "a", "c", "p")
    often = items.groupBy("b", "item").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    hot = often.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy(F.desc("n"), "item"))).where(F.col("r") <= HOT).select("b", "item", F.lit(1).alias("hot"))
    items = items.join(hot, ["b", "item"], "left").withColumn("r", F.row_number().over(Window.partitionBy("b", "a").orderBy(F.coalesce("hot", F.lit(0)), "item"))).where("r <= p").select("b", "item", "a", "c", "r")
    several = items.groupBy("b", "item").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("b", "item")
    # The registers join what is left only.
    items = stored(items.join(several, ["b", "item"], "left_semi").join(apart.select("b", "a", "na", "i", "ra"), ["b", "a"]), "items")
    other_item = items.select("b", "item", F.col("a").alias("y"), F.col("c").alias("cy"), F.col("na").alias("ny"), F.col("i").alias("iy"), F.col("r").alias("py"), F.col("ra").alias("ry"))
    # The first item of both prefixes that two sets share tells how many more they can: what each has besides the leader's
    # after it, and what both have of the leader's.  Later shared items of a pair may miss the bound, its first does not.
    most = 1 + F.least(F.col("na") - F.col("i") - F.col("r"), F.col("ny") - F.col("iy") - F.col("py")) + F.least("i", "iy")
    reach = 100 * most >= percent * (F.col("na") + F.col("ny") - most)
    sides = [F.col("a"), F.col("y").alias("b"), F.col("na"), F.col("ny").alias("nb"), F.col("ra"), F.col("ry").alias("rb")]
    by_item = items.join(other_item, ["b", "item"]).where((F.col("c") < F.col("cy")) & reach).select(*sides)
    plain = apart.where("na - i < p").drop("extra", "p")
    far = plain.where(~similar).select("b", F.col("a").alias("y"), F.col("c").alias("cy"), F.col("na").alias("ny"), F.col("i").alias("iy"), F.col("ra").alias("ry"))
    most = F.least("i", "iy")
    by_leader = plain.join(far, "b").where((F.col("c") != F.col("cy")) & (100 * most >= percent * (F.col("na") + F.col("ny") - most))).select(*sides)
    second = stored(likely(by_item.unionByName(by_leader)).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "pairs")
    more = stored(confirmed(second), "links")
    if more.isEmpty():
        whole = part
    else:
        whole = components(linked.unionByName(more))
    classes = reps.join(whole.withColumnRenamed("node", "rep"), "rep", "left").select(*one, F.coalesce("component", "rep").alias("component"))
    found = rows.select("id", *one).join(classes, one, "left").withColumn("component", F.coalesce("component", "id"))
    out = stored(found.select("id", "n", F.when(F.col("component") < NAMELESS, F.col("component")).alias("component")), "components")
    discard(rows, reps, known, sets, pairs, linked, apart, items, second, more)
    return out


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of similar texts, with its own columns only: the one of the smallest id (null last), then of the text with the smaller hash.

    Rows are told apart by id and text: one id may stand for several texts, which
    are taken each by itself, and of rows equal in both one stays.  A row without
    shingles is similar to nothing and stays.
    """
    configure(docs.sparkSession)
    th = F.xxhash64(docs[text])
    row = F.shiftrightunsigned(F.xxhash64(docs[key], th), 2)
    rows = stored(docs.select(row.alias("row"), docs[key].alias("id"), th.alias("th")).groupBy("row", "id", "th").agg(F.count("*").alias("copies")), "rows")
    # Empty texts go by the row; all others by their class.
    found = near_classes(docs.select(row.alias("row"), docs[text].alias("text")), width, percent, "row", "text")
    classes = found.where("n > 0").select(F.col("id").alias("row"), "component").distinct()
    best = rows.join(classes, "row").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "th", "row", "copies")).alias("r")).select("r.row", "r.copies")
    kept = best.select("row", F.when(F.col("copies") > 1, True).alias("several")).unionByName(found.where("n = 0").select(F.col("id").alias("row")).distinct().withColumn("several", F.lit(False)))
    kept = stored(kept.select(F.col("row").alias("kept_row"), F.coalesce("several", F.lit(False)).alias("several")), "kept")
    discard(rows)
    if kept.where("several").isEmpty():
        return docs.join(kept, row == F.col("kept_row"), "left_semi")
    once = docs.join(kept.where("NOT several"), row == F.col("kept_row"), "left_semi")
    one = docs.join(kept.where("several"), row == F.col("kept_row")).dropDuplicates(["kept_row"]).select(*(docs[c] for c in docs.columns))
    return once.unionByName(one)


def op6_minhash_neardup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = near_classes(docs, width=3, percent=85)
    return got.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
