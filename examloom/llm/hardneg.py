"""Hard negatives by a Voronoi-partitioned distributed kNN join (operator 12).

A vector's integer components are ``floor(SCALE * x)``; scores are inner
products.  Norms are augmented: with M the largest norm, a row x becomes
(x, sqrt(M*M - x.x)) and an anchor q becomes (q, 0), so that the largest inner
products are the smallest distances, d*d = q.q + M*M - 2*q.x.

1. ``PIVOTS`` rows at most, the first by a hash, part the space into cells.
2. Anchors go to the cell of their nearest pivot.  Each knows a score that its
   answers have at least, from the first ``SAMPLE`` rows by the hash; hence a
   distance beyond which no row serves it.  Of a cell are known the largest and
   smallest of these, and the radius of its anchors around the pivot.
3. By the triangle inequality a row can only serve a cell if its distance to the
   pivot is within these bounds.  Neighbouring cells are packed into groups of
   about ``GROUP`` anchors; a row is sent once to each group with a cell that it
   may serve.
4. A group's anchors, in blocks, meet its rows, in chunks of about ``CHUNK``; the
   join of a block and a chunk is an exact matrix product.  The best of each
   chunk are merged.

This runs twice: for the positives, which have a lower bound only, and for the
negatives, whose scores lie between shares of their positive's score.  Bounds
decide on speed only; all rows that could count are compared exactly.

Skew: cells with more anchors than a block are several blocks, groups with more
rows than a chunk several chunks, each a task's work of its own; so equal
vectors or labels, however many, make no large group.

Rows with a null label, a null vector, or any null or non-finite component take
no part.  Rows equal in id, label and vector count as one; others are different
rows also where they share an id.  A null id is no anchor and comes after all
others on ties.  Vectors of unequal length are filled up with zeros.  Scores must
fit a long; where they may exceed 2**53 products are made in integers.  Anchors
without positives or negatives give no row, nor does an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from examloom.llm.blocks import configure
from examloom.storage import discard, stored

SCALE = 256
PIVOTS, SAMPLE, GROUP, CHUNK = 1024, 2048, 512, 8192
POSITIVES, NEGATIVES = 5, 3
#: Percent of its positive's score that a negative has at least and at most.
LEAST, MOST = 50, 95
#: Sums of products below this are exact in floating point.
EXACT = 1 << 53
NONE = -(1 << 62)


def matrix(rows: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as the rows of a matrix, filled up with zeros."""
    size = np.diff(rows.offsets.to_numpy())
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(rows), width), dtype=np.int64)
    out[np.repeat(np.arange(len(rows)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class Space:
    """The augmented space: its pivots, the sampled rows (the first of which they are), the largest squared norm, and how products are made."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, keys: list, pivots: int, top: float, exact: bool) -> None:
        self.sample, self.labels, self.keys, self.top, self.exact = sample, labels, keys, top, exact
        self.pivots = sample[:pivots]
        self.extra = np.sqrt(np.maximum(top - self._norms(self.pivots), 0))
        #: Distances are in floating point; bounds leave room for its errors.
        self.slack = 1e-6 * (1 + np.sqrt(top))

    @staticmethod
    def _norms(x: np.ndarray) -> np.ndarray:
        y = x.astype(np.float64)
        return np.einsum("ij,ij->i", y, y)

    def scores(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        if self.exact:
            return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
        return x @ y.T

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        extra = np.sqrt(np.maximum(self.top - self._norms(x), 0))
        return np.sqrt(np.maximum(2 * self.top - 2 * (x.astype(np.float64) @ self.pivots.T + extra[:, None] * self.extra), 0))

    def of_anchors(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distances at which anchors have the given scores."""
        return np.sqrt(np.maximum(self._norms(x).reshape(-1, *[1] * (score.ndim - 1)) + self.top - 2.0 * score, 0))


def groups_of(pivots: np.ndarray, anchors: np.ndarray, most: int) -> np.ndarray:
    """The group of each cell: neighbouring cells with about so many anchors together; -1 without anchors."""
    out = np.full(len(pivots), -1, dtype=np.int64)
    waiting, n = [np.flatnonzero(anchors > 0)], 0
    while waiting:
        cells = waiting.pop()
        if not len(cells):
            continue
        if anchors[cells].sum() <= most or len(cells) == 1:
            out[cells] = n
            n += 1
            continue
        # Along the line between two cells that are far apart, cut where half of the anchors are.
        x = pivots[cells].astype(np.float64)
        a = int(((x - x[0]) ** 2).sum(axis=1).argmax())
        b = int(((x - x[a]) ** 2).sum(axis=1).argmax())
        order = np.argsort(x @ (x[b] - x[a]), kind="stable")
        half = int(np.searchsorted(np.cumsum(anchors[cells[order]]), anchors[cells].sum() / 2)) + 1
        half = min(half, len(cells) - 1)
        waiting += [cells[order[:half]], cells[order[half:]]]
    return out


def band(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest score of the negatives of positives."""
    return -((-LEAST * positive) // 100), MOST * positive // 100


def _best(score: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The k-th best allowed score of each row, NONE where fewer are allowed."""
    s = np.where(allowed, score, NONE)
    return np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(s), NONE)


def _ranked(row: np.ndarray, k: int) -> np.ndarray:
    """Which of the places, sorted by row, are among the first k of their row."""
    if not len(row):
        return np.zeros(0, dtype=bool)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    return np.arange(len(row)) - np.flatnonzero(first)[np.cumsum(first) - 1] < k


class Positives:
    """The first rows of an anchor's own label."""

    k, fields = POSITIVES, "low long"

    @staticmethod
    def bounds(space: Space, x: np.ndarray, label: np.ndarray, key: list, _) -> list[np.ndarray]:
        """low: the score that the last positive has at least."""
        mine = {k: i for i, k in enumerate(space.keys)}
        other = np.ones((len(x), len(space.keys)), dtype=bool)
        for i, k in enumerate(key):
            if k in mine:
                other[i, mine[k]] = False
        return [_best(space.scores(x, space.sample), other & (label[:, None] == space.labels), POSITIVES)]

    @staticmethod
    def reach(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Scores that serve an anchor: at least, at most."""
        low = anchors.column("low").to_numpy()
        return low, np.full(len(low), -NONE)

    @staticmethod
    def found(score: np.ndarray, anchors: pa.Table, label: np.ndarray, other: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(turn, anchors, rows): place ranks rows by id."""
        ok = (anchors.column("label").to_numpy()[:, None] == label) & other & (score >= anchors.column("low").to_numpy()[:, None])
        p, q = np.nonzero(ok)
        by = np.lexsort((place[q], -score[p, q], p))
        keep = by[_ranked(p[by], POSITIVES)]
        yield 0, p[keep], q[keep]


class Negatives:
    """For each positive of an anchor the first rows of another label whose score is within its band."""

    k, fields = NEGATIVES, "low array<long>, high array<long>"

    @staticmethod
    def bounds(space: Space, x: np.ndarray, label: np.ndarray, key: list, positives: np.ndarray) -> list[np.ndarray]:
        """low, high: the scores of each positive's negatives; no low is below the last that is sure to be among them."""
        low, high = band(positives)
        score, other = space.scores(x, space.sample), label[:, None] != space.labels
        for t in range(positives.shape[1]):
            sure = _best(score, other & (score >= low[:, t : t + 1]) & (score <= high[:, t : t + 1]), NEGATIVES)
            low[:, t] = np.maximum(low[:, t], sure)
        empty = positives < 0
        low[empty], high[empty] = -NONE, NONE
        return [low, high]

    @staticmethod
    def reach(anchors: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        low, high = (matrix(anchors.column(c).combine_chunks(), POSITIVES) for c in ("low", "high"))
        return low.min(axis=1), high.max(axis=1)

    @staticmethod
    def found(score: np.ndarray, anchors: pa.Table, label: np.ndarray, other: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        low, high = (matrix(anchors.column(c).combine_chunks(), POSITIVES) for c in ("low", "high"))
        ok = (anchors.column("label").to_numpy()[:, None] != label) & (score >= low.min(axis=1)[:, None]) & (score <= high.max(axis=1)[:, None])
        p, q = np.nonzero(ok)
        s = score[p, q]
        by = np.lexsort((place[q], -s, p))
        p, q, s = p[by], q[by], s[by]
        for t in range(POSITIVES):
            some = np.flatnonzero((s >= low[p, t]) & (s <= high[p, t]))
            keep = some[_ranked(p[some], NEGATIVES)]
            yield t, p[keep], q[keep]


def rows_of(vectors: DataFrame, key: str, vector: str, label: str, change: Callable | None = None) -> DataFrame:
    """id, label, v (integer components), rk (a hash of the vector) of the rows that take part."""
    x = F.col("x")
    good = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    some = vectors.select(vectors[key].alias("id"), vectors[label].cast("long").alias("label"), vectors[vector].cast("array<double>").alias("x"))
    some = some.where(F.coalesce(good, F.lit(False))).select("id", "label", F.transform(x, lambda c: F.floor(SCALE * c).cast("long")).alias("v"))
    if change is not None:
        some = some.withColumn("label", change(F.col("id"), F.col("label")))
    return some.withColumn("rk", F.xxhash64("v"))


def _space(rows: DataFrame, pivots: int, sample: int) -> tuple[Space, int] | None:
    """The space and the vectors' width; nothing but sums and at most so many rows reach the driver."""
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n, top, width, anchors = rows.agg(F.count("*"), F.max(squares), F.max(F.size("v")), F.count_if("anchor")).first()
    if not n or not anchors:
        return None
    drawn = rows.select("id", "label", "rk", "v", F.xxhash64("rk", "id").alias("turn")).orderBy("turn", "rk", "label").limit(max(sample, pivots)).collect()
    first = list({r.rk: r for r in drawn}.values())
    x = np.zeros((len(first), width), dtype=np.int64)
    for i, r in enumerate(first):
        x[i, : len(r.v)] = r.v
    return Space(x, np.array([r.label for r in first]), [(r.id, r.label, r.rk) for r in first], min(pivots, 1 + int(n**0.5)), float(top), top < EXACT), width


def _keys(batch: pa.RecordBatch | pa.Table) -> list:
    return list(zip(*(batch.column(c).to_pylist() for c in ("id", "label", "rk")), strict=True))


def _bounded(shared, width: int, kind):
    """Anchors with their cell, their distance to its pivot, their bounds, and the distances within which rows serve them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), width)
            near = space.of_anchors(x, x.astype(np.float64) @ space.pivots.T.astype(np.float64))
            cell = near.argmin(axis=1)
            positives = matrix(batch.column("scores"), POSITIVES) if "scores" in batch.schema.names else None
            got = kind.bounds(space, x, batch.column("label").to_numpy(), _keys(batch), positives)
            columns = [pa.array(b) if b.ndim == 1 else pa.array(b.tolist(), pa.list_(pa.int64())) for b in got]
            table = pa.RecordBatch.from_arrays([batch.column(c) for c in ("id", "label", "rk", "v")] + columns, names=["id", "label", "rk", "v", *(f.split()[0] for f in kind.fields.split(", "))])
            low, high = kind.reach(pa.Table.from_batches([table]))
            far = np.where(low <= NONE, np.inf, space.of_anchors(x, np.maximum(low, NONE).astype(np.float64)))
            near_by = np.where(high >= -NONE, 0.0, space.of_anchors(x, np.minimum(high, -NONE).astype(np.float64)))
            for name, values in (("cell", cell.astype(np.int32)), ("radius", near[np.arange(len(x)), cell]), ("far", far), ("close", near_by)):
                table = table.append_column(name, pa.array(values))
            yield table

    return run


def _sent(shared, width: int, cells: np.ndarray, radius: np.ndarray, far: np.ndarray, close: np.ndarray, group: np.ndarray):
    """Rows with the groups they may serve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            d = space.of_rows(matrix(batch.column("v"), width))[:, cells]
            serves = (d - radius - space.slack <= far) & (d + radius + space.slack >= close)
            p, q = np.nonzero(serves)
            pairs = np.unique(p * (group.max() + 1) + group[q])
            p, g = pairs // (group.max() + 1), pairs % (group.max() + 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(p)) for c in ("id", "label", "rk", "v")), pa.array(g.astype(np.int32))], names=["id", "label", "rk", "v", "g"])

    return run


def _joined(shared, width: int, kind, id_type: pa.DataType):
    """The exact join of a block of anchors and a chunk of rows."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["anchor_id", "anchor_label", "anchor_rk", "turn", "id", "rk", "score"]
        types = [id_type, pa.int64(), pa.int64(), pa.int32(), id_type, pa.int64(), pa.int64()]
        out = []
        if left.num_rows and right.num_rows:
            # Rows equal in all count as one; they are in one chunk.
            once = list({k: i for i, k in enumerate(_keys(right))}.values())
            right = right.take(pa.array(once)).combine_chunks()
            left = left.combine_chunks()
            keys = _keys(right)
            order = sorted(range(len(keys)), key=lambda i: (keys[i][0] is None, keys[i][0] or 0, keys[i][2], keys[i][1]))
            place = np.empty(len(keys), dtype=np.int64)
            place[order] = np.arange(len(keys))
            at = {k: i for i, k in enumerate(keys)}
            other = np.ones((left.num_rows, len(keys)), dtype=bool)
            for i, k in enumerate(_keys(left)):
                if k in at:
                    other[i, at[k]] = False
            score = shared.value.scores(matrix(left.column("v").chunk(0), width), matrix(right.column("v").chunk(0), width))
            for turn, p, q in kind.found(score, left, right.column("label").to_numpy(), other, place):
                p_, q_ = pa.array(p), pa.array(q)
                out.append(pa.Table.from_arrays([*(left.column(c).take(p_) for c in ("id", "label", "rk")), pa.array(np.full(len(p), turn, dtype=np.int32)), right.column("id").take(q_), right.column("rk").take(q_), pa.array(score[p, q])], names=names))
        return pa.concat_tables(out) if out else pa.Table.from_arrays([pa.array([], t) for t in types], names=names)

    return run


def knn(rows: DataFrame, anchors: DataFrame, shared, width: int, kind, group: int = GROUP, chunk: int = CHUNK, counted: list | None = None) -> DataFrame:
    """The first rows of each anchor and turn: anchor_id, anchor_label, anchor_rk, turn, id, rk, score, rank.

    counted: gets the number of rows sent to groups, and of groups.
    """
    spark = rows.sparkSession
    id_type = dict(rows.dtypes)["id"]
    schema = f"id {id_type}, label long, rk long, v array<long>, {kind.fields}, cell int, radius double, far double, close double"
    placed = stored(anchors.mapInArrow(_bounded(shared, width, kind), schema), "anchors")
    # At most as many rows as pivots.
    cells = sorted(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius"), F.max("far").alias("far"), F.min("close").alias("close")).collect())
    space = shared.value
    size = np.zeros(len(space.pivots), dtype=np.int64)
    size[[r.cell for r in cells]] = [r.n for r in cells]
    groups = groups_of(space.pivots, size, group)
    own = np.array([groups[r.cell] for r in cells], dtype=np.int64)
    sent = rows.mapInArrow(_sent(shared, width, np.array([r.cell for r in cells], dtype=np.int64), np.array([r.radius for r in cells]), np.array([r.far for r in cells]), np.array([r.close for r in cells]), own), f"id {id_type}, label long, rk long, v array<long>, g int")
    met = dict(sent.groupBy("g").count().collect())
    blocks = np.ones(max(groups.max(), 0) + 1, dtype=np.int64)
    for g in range(len(blocks)):
        blocks[g] = max(1, -(-int(size[groups == g].sum()) // group))
    chunks = np.array([max(1, -(-met.get(g, 0) // chunk)) for g in range(len(blocks))], dtype=np.int64)
    if counted is not None:
        counted += [sum(met.values()), len(blocks)]
    # A line for each group, at most as many as pivots.
    plan = spark.createDataFrame([(g, int(b), int(c)) for g, (b, c) in enumerate(zip(blocks, chunks, strict=True))], "g int, blocks long, chunks long")
    to_group = spark.createDataFrame([(int(r.cell), int(groups[r.cell])) for r in cells], "cell int, g int")
    left = placed.join(F.broadcast(to_group), "cell").join(F.broadcast(plan), "g").withColumn("block", F.pmod(F.xxhash64("rk", "id"), F.col("blocks"))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    right = sent.join(F.broadcast(plan), "g").withColumn("chunk", F.pmod(F.xxhash64("rk", "id", "label"), F.col("chunks"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    unit = ["g", "block", "chunk"]
    left = left.select(*unit, "id", "label", "rk", "v", *(f.split()[0] for f in kind.fields.split(", ")))
    right = right.select(*unit, "id", "label", "rk", "v")
    arrow = to_arrow_type(rows.schema["id"].dataType)
    got = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(_joined(shared, width, kind, arrow), f"anchor_id {id_type}, anchor_label long, anchor_rk long, turn int, id {id_type}, rk long, score long")
    order = Window.partitionBy("anchor_id", "anchor_label", "anchor_rk", "turn").orderBy(F.desc("score"), F.asc_nulls_last("id"), "rk")
    out = stored(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kind.k), "neighbours")
    discard(placed)
    return out


def hard_negatives(vectors: DataFrame, every: int = 50, key: str = "vec_id", vector: str = "embedding", label: str = "label", change: Callable | None = None, pivots: int = PIVOTS, sample: int = SAMPLE, group: int = GROUP, chunk: int = CHUNK, counted: list | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose id is divisible by every.

    change(id, label) gives the label that counts, if it is another.
    """
    spark = vectors.sparkSession
    configure(spark)
    schema = "anchor_id {0}, positive_id {0}, rank int, negative_id {0}, positive_score long, negative_score long".format(dict(vectors.dtypes)[key])
    rows = rows_of(vectors, key, vector, label, change).withColumn("anchor", F.coalesce(F.col("id") % every == 0, F.lit(False)))
    found = _space(rows, pivots, sample)
    if found is None:
        return spark.createDataFrame([], schema)
    space, width = found
    shared = spark.sparkContext.broadcast(space)
    rows, anchors = rows.drop("anchor"), rows.where("anchor").drop("anchor").dropDuplicates(["id", "label", "rk"])
    positives = knn(rows, anchors, shared, width, Positives, group, chunk, counted)
    # At most POSITIVES for each anchor, in order.
    anchor = ["anchor_id", "anchor_label", "anchor_rk"]
    listed = positives.groupBy(*anchor).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id"))).alias("p"))
    padded = F.slice(F.concat(F.col("p.score"), F.array_repeat(F.lit(NONE).cast("long"), POSITIVES)), 1, POSITIVES)
    told = listed.select(F.col("anchor_id").alias("id"), F.col("anchor_label").alias("label"), F.col("anchor_rk").alias("rk"), padded.alias("scores"))
    with_scores = anchors.join(told, ["id", "label", "rk"]).where(F.exists("scores", lambda s: s >= 0))
    negatives = knn(rows, with_scores, shared, width, Negatives, group, chunk, counted)
    named = positives.select(*anchor, (F.col("rank") - 1).alias("turn"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, [*anchor, "turn"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    changed = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), change=changed)
