"""The frame shared by the operators that find long repeats in the corpus.

1. Every document gives the segments around its anchors (map side only).
2. Anchors are counted, pre-aggregated before the shuffle; a window whose anchor
   occurs once cannot occur twice, so those segments are done with.
3. Of each distinct segment of the other anchors one representative is read from
   its document and sent, by anchor, to a shard, with the number of its
   occurrences.  The operator's index over the shard tells which windows occur
   again.
4. What is covered goes back to the documents.

Skew: an anchor with more than ``HOT`` distinct segments (the edge of a passage
that very many documents share) is split.  Its windows are classed by where the
anchor stands in them; the windows of a class that are in one segment make a part,
whose key is what all windows of the class have in common around the anchor, up
to nearly a whole window.  Equal windows have equal keys, and parts whose key
occurs once are done with.  Keys that still have too many are split again, until
a class is a single place and its key the window itself.  A split starts from the
distinct segments, not from all that occur, and from their contents, which are
read with those to index: documents move once, however many rounds there are.  A
segment makes at most ``SPLIT`` rows a round, not a row for each of its windows, no
group in a shard exceeds ``HOT`` segments, and a shard is indexed in portions of
about ``PORTION`` of them.  What the parts' index tells is handed to the segments
they were cut from.  The joins on hot keys are plain equi joins of two
shuffled sides, which adaptive execution splits.

A document is a row: rows are told apart by id and a hash of their text, so null
and repeated ids need no care.  Rows with both equal count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.llm.anchors import segments
from examloom.llm.blocks import BATCH_ROWS, Block, blocks, configure, mix, range_hashes, spread
from examloom.storage import discard, stored

#: Distinct segments of a key beyond which they are split, and into how many parts at a time.
HOT, SPLIT = 1_000, 4
#: Representatives indexed together, and by one task on average.
PORTION, SHARD = 8_000, 24_000

Index = Callable[[dict[str, list]], Iterator[tuple[int, list[int], list[int]]]]


class Units:
    """How texts are cut: into bytes or into words."""

    def __init__(self, words: bool, w: int, m: int) -> None:
        self.words, self.w, self.m = words, w, m
        self.size = 8 if words else 1  # bytes of a unit

    def values(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The units of a block (words by their hashes) and where each text begins."""
        if not self.words:
            return block.data, block.off
        return block.word_hashes(), block.ptr


def _segments(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            got = segments(*units.values(block), units.w, units.m)
            text = pa.array(got["text"])
            yield pa.RecordBatch.from_arrays([pa.array(got["h"]), pa.array(got["f"]), *(block.batch.column(k).take(text) for k in ("id", "th")), *(pa.array(got[k].astype(np.int32)) for k in ("start", "anchor", "end"))], names=["h", "f", "id", "th", "s", "a", "e"])

    return run


def _parts(units: Units, n: int):
    """Segments cut by where in a window the anchor stands, into n classes of places: what the windows of a class have in common is the key of their part."""
    span = units.w - units.m + 1
    edge = -(-np.arange(n + 1) * span // n)  # class p has the places edge[p] to edge[p + 1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                some = batch.slice(lo, BATCH_ROWS)
                contents = some.column("content").to_pylist()
                data, length = np.frombuffer(b"".join(contents), dtype=np.uint8), np.array([len(x) for x in contents]) // units.size
                base, s, a, at = np.cumsum(length) - length, *(some.column(k).to_numpy().astype(np.int64) for k in ("s", "a", "at"))
                e = s + length
                low, high = ((x * n) // span for x in (a - e + units.w, a - s))
                which, step = spread(high - low + 1)
                c, a, first = low[which] + step, a[which], s[which]
                s, e = np.maximum(first, a - edge[c + 1] + 1), np.minimum(e[which], a - edge[c] + units.w)
                places = lambda x: (base[which] + x - first) * units.size  # noqa: B023, E731
                hashes = lambda x, y: range_hashes(data, places(x), places(y))  # noqa: B023, E731
                h = mix(hashes(a - edge[c], a - edge[c + 1] + 1 + units.w) ^ (c + (n << 16)).astype(np.uint64))
                f = hashes(s, e) ^ ((a - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                row, made = pa.array(which), {"h": pa.array(h.view(np.int64)), "f": pa.array(f.view(np.int64))}
                made |= {k: pa.array(x.astype(np.int32)) for k, x in (("s", s), ("a", a), ("at", at[which] + s - first))}
                made["content"] = pa.array([data[x:y].tobytes() for x, y in zip(places(s).tolist(), places(e).tolist(), strict=True)], pa.binary())
                names = ["h", "f", "oh", "of", "n", "id", "th", "s", "a", "at", "content"]
                yield pa.RecordBatch.from_arrays([made[k] if k in made else some.column(k).take(row) for k in names], names=names)

    return run


def _contents(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            values, bounds = units.values(block)
            for i, (b, wanted) in enumerate(zip(bounds[:-1].tolist(), block.batch.column("wanted").to_pylist(), strict=True)):
                for at in range(0, len(wanted), BATCH_ROWS):
                    some = wanted[at : at + BATCH_ROWS]
                    row = pa.array([i] * len(some))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([x[k] for x in some], pa.int64()) for k in "hfnk"), *(block.batch.column(k).take(row) for k in ("id", "th")), *(pa.array([x[k] for x in some], pa.int32()) for k in "sa"), pa.array([values[b + x["s"] : b + x["e"]].tobytes() for x in some], pa.binary())],
                        names=["h", "f", "n", "k", "id", "th", "s", "a", "content"],
                    )

    return run


def _indexed(index: Index):
    """Runs the index over a shard sorted by h, portion by portion; an anchor's segments stay together."""

    def told(columns: dict[str, list]) -> pa.RecordBatch:
        which, cover, first = [], [], []
        for i, c, f in index(columns):
            which.append(i)
            cover.append(c)
            first.append(f)
        take = lambda k, t: pa.array([columns[k][i] for i in which], t)
        return pa.RecordBatch.from_arrays([take("h", pa.int64()), take("f", pa.int64()), pa.array(cover, pa.list_(pa.int32())), pa.array(first, pa.list_(pa.int32())), pa.array([columns["id"][i] for i in which], columns["kind"]), take("th", pa.int64()), take("a", pa.int32())], names=["h", "f", "cover", "first_cover", "rid", "rth", "ra"])

    def portion(table: pa.Table) -> pa.RecordBatch:
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        # Rows with id and text equal each send their segments.
        once = list({(h, f): i for i, (h, f) in enumerate(zip(columns["h"], columns["f"], strict=True))}.values())
        if len(once) < table.num_rows:
            columns = {c: [x[i] for i in once] for c, x in columns.items()}
        return told(columns | {"kind": table.schema.field("id").type})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            n += batch.num_rows
            if n >= PORTION:
                table = pa.Table.from_batches(waiting)
                h = table.column("h").to_numpy()
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1 if h[0] != h[-1] else 0
                if cut:
                    yield portion(table.slice(0, cut))
                    waiting, n = table.slice(cut).to_batches(), len(h) - cut
        if n:
            yield portion(pa.Table.from_batches(waiting))

    return run


def identified(docs: DataFrame, key: str, text: str) -> list:
    """The columns that tell rows apart: id and a hash of the text."""
    return [docs[key].alias("id"), F.xxhash64(docs[text]).alias("th")]


def covers(docs: DataFrame, units: Units, index: Index, settle: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per distinct document with repeats: id, th and runs, the list of (s, cover) of its segments; cover is a flat list relative to s.

    settle: an anchor with one distinct segment, which occurs twice or more, is
    not indexed but covered as a whole (wherever that is the index's only answer).

    index(columns of a portion) yields, by their place in the columns, the
    representatives with repeats: what all occurrences have covered, and what the
    first of them has.  First is the smallest id (null last), then the smallest
    hash of the text, then the place.
    """
    spark = docs.sparkSession
    configure(spark)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(*identified(docs, key, text), docs[text].alias("text"))
    schema = f"h long, f long, id {kind}, th long, s int, a int, e int"
    found = rows.mapInArrow(_segments(units), schema)
    anchors = stored(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "anchors")
    again = stored(found.join(anchors, "h").select(found.columns), "again")
    discard(anchors)
    used = [again]

    def kept(df: DataFrame, name: str) -> DataFrame:
        used.append(stored(df, name))
        return used[-1]

    def representatives(df: DataFrame, times, last: str) -> tuple[DataFrame, DataFrame]:
        """The distinct segments, with k, how many of them their key has; and the keys with theirs."""
        first = F.min(F.struct(F.col("id").isNull().alias("z"), "id", "th", "a", "s", last)).alias("r")
        reps = kept(df.groupBy("h", "f").agg(times.alias("n"), first), "reps")
        # A key that occurs once has no window that occurs again.
        groups = kept(reps.groupBy("h").agg(F.count("*").alias("k"), F.sum("n").alias("c")).where("c > 1").select("h", "k"), "groups")
        return reps.join(groups, "h"), groups

    def wholes(reps: DataFrame, length) -> DataFrame:
        whole = F.array(F.lit(0), length.cast("int"))
        return reps.where("k = 1").select("h", "f", whole.alias("cover"), whole.alias("first_cover"), F.col("r.id").alias("rid"), F.col("r.th").alias("rth"), F.col("r.a").alias("ra"))

    reps, groups = representatives(again, F.count("*"), "e")
    least = 1 if settle else 0
    indexed = (F.col("k") <= HOT) & (F.col("k") > least)
    # The documents are read once, for the segments to index and for those to split.
    wanted = reps.where(F.col("k") > least).groupBy("r.id", "r.th").agg(F.collect_list(F.struct("h", "f", "n", "k", F.col("r.s").alias("s"), F.col("r.a").alias("a"), F.col("r.e").alias("e"))).alias("wanted"))
    named = wanted.withColumnsRenamed({"id": "wid", "th": "wth"})
    there = rows.join(named, rows["id"].eqNullSafe(named["wid"]) & (rows["th"] == named["wth"])).select("id", "th", "text", "wanted")
    contents = kept(there.mapInArrow(_contents(units), f"h long, f long, n long, k long, id {kind}, th long, s int, a int, content binary"), "contents")
    columns = ["h", "f", "n", "id", "th", "s", "a", "content"]
    strings, settled, many, n = contents.where(indexed).select(columns), wholes(reps, F.col("r.e") - F.col("r.s")), [groups], 1
    now, parts = contents.where(F.col("k") > HOT).dropDuplicates(["h", "f"]).select(F.col("h").alias("oh"), F.col("f").alias("of"), "n", "id", "th", "s", "a", F.lit(0).alias("at"), "content"), None
    while not (hot := many[-1].where(F.col("k") > HOT).select("h")).isEmpty():
        if parts is not None:
            now = now.join(hot, "h")
        n = min(n * SPLIT, units.w - units.m + 1)
        now = kept(now.mapInArrow(_parts(units, n), f"h long, f long, oh long, of long, n long, id {kind}, th long, s int, a int, at int, content binary"), "parts")
        some, groups = representatives(now, F.sum("n"), "content")
        parts = now if parts is None else parts.unionByName(now)
        strings = strings.unionByName(some.where(indexed).select("h", "f", "n", *(F.col(f"r.{c}").alias(c) for c in columns[3:])))
        settled = settled.unionByName(wholes(some, F.length("r.content") / units.size))
        many.append(groups)
    count = sum(g.where(indexed).agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0] for g in many)
    shards = max(2 * spark.sparkContext.defaultParallelism, count // SHARD)
    told = shown = stored(strings.repartition(shards, "h").sortWithinPartitions("h").mapInArrow(_indexed(index), f"h long, f long, cover array<int>, first_cover array<int>, rid {kind}, rth long, ra int"), "told")
    if settle:
        told = told.unionByName(settled)
    if parts is not None:
        # A part's answer is one of each segment it was cut from.
        moved = [F.transform(c, lambda x: x + F.col("at")).alias(c) for c in ("cover", "first_cover")]
        told = told.unionByName(parts.select("h", "f", "oh", "of", "at").join(told, ["h", "f"]).select(F.col("oh").alias("h"), F.col("of").alias("f"), *moved, "rid", "rth", "ra"))
    own = F.when(F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth")) & (F.col("a") == F.col("ra")), F.col("first_cover")).otherwise(F.col("cover"))
    marks = again.join(told, ["h", "f"]).select("id", "th", "s", own.alias("cover")).where(F.size("cover") > 0)
    # Rows with id and text equal have their segments once.
    runs = stored(marks.groupBy("id", "th").agg(F.collect_set(F.struct("s", "cover")).alias("runs")), "runs")
    discard(*used, shown)
    return runs


def with_runs(docs: DataFrame, runs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """docs and one more column of the runs, null where nothing is covered, whose name none of docs' columns has."""
    name = "runs"
    while name in docs.columns:
        name += "_"
    named = runs.select(F.col("id").alias(f"{name}_id"), F.col("th").alias(f"{name}_th"), F.col("runs").alias(name))
    same = docs[key].eqNullSafe(named[f"{name}_id"]) & (F.xxhash64(docs[text]) == named[f"{name}_th"])
    return docs.join(named, same, "left").select(*(docs[c] for c in docs.columns), named[name]), name


def covered_mask(runs: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Which units of texts, laid end to end with the given bounds, are covered by their runs."""
    flat = runs.flatten()
    owner = pc.list_parent_indices(runs).to_numpy(zero_copy_only=False)
    cover = pc.struct_field(flat, "cover")
    run = pc.list_parent_indices(cover).to_numpy(zero_copy_only=False)[::2]
    edge = cover.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2)
    base, limit = (bounds[owner] + pc.struct_field(flat, "s").to_numpy(zero_copy_only=False))[run], bounds[owner + 1][run]
    step = np.zeros(int(bounds[-1]) + 1, dtype=np.int32)
    for sign, x in ((1, edge[:, 0]), (-1, edge[:, 1])):
        step += sign * np.bincount(np.minimum(base + x, limit), minlength=len(step)).astype(np.int32)
    return np.cumsum(step[:-1]) > 0
