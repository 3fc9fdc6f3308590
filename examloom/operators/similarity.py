"""Exact similarity joins on vectors, in blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.session import small_batches
from examloom.storage import stored

BLOCK = 2048
#: Cells of one product.
SLICE = 4_000_000
#: Numbers of one slice in the join of near pairs, and rows that a task gives out at once.
PART, ROWS = 500_000, 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def max_sim(query: Column, doc: Column) -> Column:
    """Sum over the query's vectors of the best dot product among the document's."""
    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: dot(q, d)))), F.lit(0.0), lambda s, x: s + x)


def _unit(rows: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in rows])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


#: Cells of the metric partition at most, and rows of the sample that they are chosen from.
CELLS, SAMPLE = 4096, 4096
#: Copies of a row in other cells at most, on average: what is moved then grows no faster than the rows.
COPIES = 4


class Cells:
    """Unit vectors parted by their nearest pivot, and how far over a cell's border a similar vector can be.

    A vector y of cell c is nearer to c's pivot than to any other, so y.n <= 0
    for the normal n = (h - c) / |h - c| of the border with the cell h of x.  The
    angle between x and y is at least the one between x and that border, whose
    sine is x.n.  So x meets all similar vectors of c if it is copied there
    whenever x.n is at most the sine of the threshold's angle.
    """

    def __init__(self, pivots: np.ndarray, threshold: float) -> None:
        self.pivots = pivots
        # From a right angle on, anything may be similar across any border.
        self.reach = float(np.sqrt(1 - threshold**2)) + 1e-9 if threshold > 0 else np.inf
        self.apart = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2), 1e-30)) if len(pivots) <= 512 else None

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home of each row; and (row, cell) of its copies, which go to cells before its home only, so that a pair meets once."""
        s = x @ self.pivots.T
        home = s.argmax(axis=1)
        own = s[np.arange(len(x)), home][:, None]
        if self.apart is not None:
            wide = self.apart[home]
        else:
            wide = np.sqrt(np.maximum(2 - 2 * (self.pivots[home] @ self.pivots.T), 1e-30))
        near = own - s <= self.reach * wide
        near &= np.arange(len(self.pivots))[None, :] < home[:, None]
        row, cell = np.nonzero(near)
        return home, row, cell


def _cells(rows: DataFrame, n: int, threshold: float, cells: int) -> Cells:
    """The number of cells that costs least on a sample, which decides on speed only; one, if any more would need too many copies."""
    drawn = rows.orderBy(F.xxhash64("k")).limit(min(SAMPLE, max(64, n))).collect()
    x = np.unique(_unit(pd.Series([r.v for r in drawn])), axis=0) if drawn else np.zeros((1, 1))
    x = x[np.random.default_rng(0).permutation(len(x))]
    best, cost = None, np.inf
    m = min(cells, len(x), max(1, int(np.ceil(2 * np.sqrt(n)))))
    while True:
        got = Cells(x[:m], threshold)
        home, row, cell = got.place(x)
        own, more = np.bincount(home, minlength=m) * (n / len(x)), np.bincount(cell, minlength=m) * (n / len(x))
        # Products, and rows that are moved at what some dozens of products cost.
        now = float((own * (own / 2 + more)).sum() + 64 * (n + more.sum()))
        if now < cost and (m == 1 or more.sum() <= COPIES * n):
            best, cost = got, now
        if m == 1:
            return best
        m = max(1, m // 4)


def likely_bound(vectors: DataFrame, key: str, vector: str, degree: float) -> float:
    """The similarity that a row reaches with so many others on average, by a sample; -1 if there are no more rows."""
    n = vectors.count()
    if n - 1 <= degree:
        return -1.0
    drawn = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).orderBy(F.xxhash64(key)).select(F.col(vector).alias("v")).limit(SAMPLE // 2).collect()
    if len(drawn) < 2:
        return -1.0
    x = _unit(pd.Series([r.v for r in drawn]))
    s = (x @ x.T)[np.triu_indices(len(x), 1)]
    return float(-np.sort(-s)[min(len(s) - 1, max(0, round(len(s) * degree / (n - 1)) - 1))])


def in_blocks(placed: DataFrame, block: int, many: bool = False) -> DataFrame:
    """Rows (k, ..., cell, copy) dealt to products of two blocks of a cell: grouped by cell, x and y, each has all that sides() needs.

    Rows at home in a cell meet each other and the copies there; copies don't
    meet.  Every such pair of rows is in one product.  many: there may be as many
    cells as rows, so their sizes are joined instead of broadcast.
    """
    columns = placed.columns
    sizes = placed.groupBy("cell").agg(F.count_if(~F.col("copy")).alias("own"), F.count_if("copy").alias("more")).where("own > 0")
    plan = sizes.select("cell", F.ceil(F.col("own") / block).cast("int").alias("blocks"), F.ceil(F.col("more") / block).cast("int").alias("others"))
    # A line for each cell, whose number is bounded by a parameter or by the logarithm of the texts' lengths.
    if not many:
        plan = F.broadcast(placed.sparkSession.createDataFrame([tuple(r) for r in plan.collect()], "cell int, blocks int, others int"))
    dealt = placed.join(plan, "cell")
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64("k"), F.when(F.col("copy"), F.col("others")).otherwise(F.col("blocks"))).cast("int"))
    # A row at home is in the products of its block with all blocks, once for each; a copy in those of its block with all blocks of rows at home.
    blocks = F.sequence(F.lit(0), F.col("blocks") - 1)
    own = F.transform(blocks, lambda o: F.struct(F.least("b", o).alias("x"), F.greatest("b", o).alias("y")))
    across = F.when(F.col("others") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("others"), F.lit(1)) - 1), lambda o: F.struct(F.col("b").alias("x"), (-1 - o).alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    products = F.when(F.col("copy"), F.transform(blocks, lambda o: F.struct(o.alias("x"), (-1 - F.col("b")).alias("y")))).otherwise(F.concat(own, across))
    return dealt.select(*columns, "b", F.explode(products).alias("p")).select(*columns, "b", "p.x", "p.y")


def sides(part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The two sides of a product, and whether they are the same rows."""
    x, y = part["x"].iloc[0], part["y"].iloc[0]
    return part[~part["copy"] & (part["b"] == x)], part[part["copy"]] if y < 0 else part[part["b"] == y], x == y


def placements(found: Cells, keys: np.ndarray, vectors: pd.Series, beside: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Rows (k, e if given, v, cell, copy) at home and copied; as a vector may have a copy in every cell, in frames of bounded size."""
    step = max(1, PART // len(found.pivots))
    for a in range(0, len(keys), step):
        v = vectors.iloc[a : a + step].to_numpy()
        home, row, cell = found.place(_unit(v))
        at, cell, copy = np.concatenate([np.arange(len(v)), row]), np.concatenate([home, cell]), np.repeat([False, True], [len(v), len(row)])
        for b in range(0, len(at), ROWS):
            some = slice(b, b + ROWS)
            more = {} if beside is None else {"e": beside[a + at[some]]}
            yield pd.DataFrame({"k": keys[a + at[some]], **more, "v": list(v[at[some]]), "cell": cell[some], "copy": copy[some]})


def products(ka: np.ndarray, x: np.ndarray, kb: np.ndarray, y: np.ndarray, same: bool, threshold: float, ea: np.ndarray | None = None, eb: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Similar pairs (i, j, sim; ei, ej if given) of two blocks; as all of them may be similar, in frames of bounded size."""
    step = max(1, PART // len(kb))
    for at in range(0, len(ka), step):
        s = x[at : at + step] @ y.T
        p, q = np.nonzero(s >= threshold - 1e-12)
        i, j, s = ka[at + p], kb[q], s[p, q]
        keep = i < j if same else i != j
        if keep.any():
            p, q, i, j, s = p[keep], q[keep], i[keep], j[keep], s[keep]
            more = {} if ea is None else {"ei": np.where(i < j, ea[at + p], eb[q]), "ej": np.where(i < j, eb[q], ea[at + p])}
            yield pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "sim": s, **more})


def _packed(placed: DataFrame, block: int) -> DataFrame:
    """Blocks of the rows at home and of the copies of each cell, stored: a row (cell, copy, b, k, e, v) each, v being the vectors' bytes."""
    kinds = dict(placed.dtypes)
    sizes = placed.groupBy("cell").agg(F.count_if(~F.col("copy")).alias("own"), F.count_if("copy").alias("more")).where("own > 0")
    # A line for each cell, whose number is bounded by a parameter.
    plan = sizes.select("cell", F.ceil(F.col("own") / block).cast("int").alias("blocks"), F.ceil(F.col("more") / block).cast("int").alias("others")).collect()
    plan = F.broadcast(placed.sparkSession.createDataFrame([tuple(r) for r in plan], "cell int, blocks int, others int"))
    dealt = placed.join(plan, "cell").withColumn("b", F.pmod(F.xxhash64("k"), F.when(F.col("copy"), F.col("others")).otherwise(F.col("blocks"))).cast("int"))

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        one = part.iloc[0]
        return pd.DataFrame({"cell": [one["cell"]], "copy": [one["copy"]], "b": [one["b"]], "k": [part["k"].to_list()], "e": [part["e"].to_list()], "v": [np.array(part["v"].to_list()).tobytes()]})

    return stored(dealt.drop("blocks", "others").groupBy("cell", "copy", "b").applyInPandas(pack, f"cell int, copy boolean, b int, k array<{kinds['k']}>, e array<string>, v binary"), "blocks")


def near_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, top_k: int | None = None, block: int = BLOCK, cells: int = CELLS, compared=None, beside: str | None = None) -> DataFrame:
    """All pairs i < j with cosine of at least the threshold: (i, j, sim).

    Vectors are parted into cells around pivots; one near a border, as the
    threshold has it, is copied across it (see Cells), so a cell meets all pairs
    that can be similar and no others.  A cell's rows are blocks of bounded size,
    packed into a row each and stored once.  Every pair of blocks of a cell is a
    product, read from there by a join that moves partitions of blocks against
    each other: nothing is shuffled for a product, so what lies on disk grows
    with the vectors, though the products grow with their square.  top_k keeps
    each row's best neighbours only (a limit that is the feature, off by
    default).  compared: an accumulator of the products made.  beside: a column
    that the pairs take along, as (i, j, sim, ei, ej).

    Null vectors take no part; a zero vector is similar to nothing (0).  Rows
    with equal keys are not paired with each other.
    """
    spark, kinds = vectors.sparkSession, dict(vectors.dtypes)
    small_batches(spark)
    kind, wide = kinds[key], "float" if kinds[vector] == "array<float>" else "double"
    other = F.col(beside).cast("string") if beside else F.lit(None).cast("string")
    rows = vectors.select(F.col(key).alias("k"), other.alias("e"), F.col(vector).cast(f"array<{wide}>").alias("v")).where(F.col("v").isNotNull() & F.col("k").isNotNull())
    found = _cells(rows, rows.count(), threshold, cells)
    shared = spark.sparkContext.broadcast(found)

    def place(parts):
        for part in parts:
            yield from placements(shared.value, part["k"].to_numpy(), part["v"], part["e"].to_numpy())

    blocks = _packed(rows.mapInPandas(place, f"k {kind}, e string, v array<{wide}>, cell int, copy boolean"), block)
    left = blocks.where(~F.col("copy")).select("cell", F.col("b").alias("x"), F.col("k").alias("ka"), F.col("e").alias("ea"), F.col("v").alias("va"))
    right = blocks.select(F.col("cell").alias("at"), F.col("copy"), F.col("b").alias("y"), F.col("k").alias("kb"), F.col("e").alias("eb"), F.col("v").alias("vb"))
    # Rows at home meet each other and the copies; copies don't meet.
    met = left.join(right.hint("shuffle_replicate_nl"), (F.col("cell") == F.col("at")) & (F.col("copy") | (F.col("x") <= F.col("y")))).withColumn("same", ~F.col("copy") & (F.col("x") == F.col("y")))

    def matrix(v: bytes, n: int) -> np.ndarray:
        x = np.frombuffer(v, dtype="<f4" if wide == "float" else "<f8").reshape(n, -1).astype(np.float64)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(length == 0, 1, length)

    def multiply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for part in parts:
            for ka, ea, va, kb, eb, vb, same in part.itertuples(index=False, name=None):
                ka, kb = np.asarray(ka), np.asarray(kb)
                if compared is not None:
                    compared.add(len(ka) * (len(ka) - 1) // 2 if same else len(ka) * len(kb))
                for got in products(ka, matrix(va, len(ka)), kb, matrix(vb, len(kb)), same, threshold, *((np.asarray(ea, dtype=object), np.asarray(eb, dtype=object)) if beside else ())):
                    held.append(got)
                    n += len(got)
                    if n >= PART // 8:
                        yield pd.concat(held)
                        held, n = [], 0
        if held:
            yield pd.concat(held)

    more = ", ei string, ej string" if beside else ""
    pairs = met.select("ka", "ea", "va", "kb", "eb", "vb", "same").mapInPandas(multiply, f"i {kind}, j {kind}, sim double{more}").where(F.col("sim") >= threshold)
    if beside:
        pairs = pairs.withColumns({e: F.col(e).cast(kinds[beside]) for e in ("ei", "ej")})
    if top_k is None:
        return pairs
    both = pairs.select(F.col("i").alias("o"), "i", "j", "sim").unionByName(pairs.select(F.col("j").alias("o"), "i", "j", "sim"))
    best = both.withColumn("r", F.row_number().over(Window.partitionBy("o").orderBy(F.desc("sim"), "i", "j"))).where(F.col("r") <= top_k)
    return best.where(F.col("o") == F.col("i")).select("i", "j", "sim")


#: Most numbers in the vectors of one pass's queries: 80 MB as doubles.
QUERY_NUMBERS = 10_000_000


def firsts(s: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row and what they belong to; of equal ones those that stand first."""
    order = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(s, order, axis=1), np.take_along_axis(c, order, axis=1)


def nearest(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, query_vector: str, vector: str, k: int) -> DataFrame:
    """The k best of the corpus for each query by cosine: (query_key, key, score, rank); ties by key.

    The queries are a stated set that fits a broadcast (its size is checked);
    each task keeps its own k best before anything is shuffled.
    """
    some = queries.select(F.col(query_key).alias("q"), F.col(query_vector).alias("v"))
    numbers = some.agg(F.sum(F.size("v"))).first()[0] or 0
    if numbers > QUERY_NUMBERS:
        raise ValueError("too many queries for one pass; call with blocks of queries")
    got = some.collect()
    ids, x = [r.q for r in got], _unit(pd.Series([r.v for r in got])) if got else np.zeros((0, 1))
    shared = corpus.sparkSession.sparkContext.broadcast((ids, x))
    qkind, kind = dict(queries.dtypes)[query_key], dict(corpus.dtypes)[key]

    small_batches(corpus.sparkSession)

    def run(parts):
        ids, x = shared.value
        if not len(ids):
            return
        step, best, top = max(1, PART // len(ids)), None, None
        for part in parts:
            part = part[part["v"].notna()]
            for a in range(0, len(part), step):
                some = part.iloc[a : a + step].sort_values("c", kind="stable")
                s, c = firsts(x @ _unit(some["v"]).T, np.broadcast_to(some["c"].to_numpy(), (len(ids), len(some))), k)
                if best is not None:
                    s, c = np.hstack([best, s]), np.hstack([top, c])
                    by_key = np.argsort(c, axis=1, kind="stable")
                    s, c = firsts(np.take_along_axis(s, by_key, axis=1), np.take_along_axis(c, by_key, axis=1), k)
                best, top = s, c
        for a in range(0, len(ids) if best is not None else 0, ROWS):
            to = slice(a, a + ROWS)
            yield pd.DataFrame({"q": np.repeat(ids[to], top.shape[1]), "c": top[to].ravel(), "s": best[to].ravel()})

    best = corpus.select(F.col(key).alias("c"), F.col(vector).alias("v")).mapInPandas(run, f"q {qkind}, c {kind}, s double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("s", 12)), "c"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("c").alias(key), F.col("s").alias("score"), "rank")


def nearest_late(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, query_late: str, late: str, k: int, block: int = BLOCK) -> DataFrame:
    """The k best of the whole corpus for each query by late interaction: (query_key, key, score, rank); ties by key.

    Queries are taken in blocks, each one pass over the corpus; products are made
    of slices of bounded size, and each task keeps its own k best.
    """
    qkind, kind = dict(queries.dtypes)[query_key], dict(corpus.dtypes)[key]
    some = corpus.select(F.col(key).alias("c"), F.col(late).alias("v")).where(F.size("v") > 0)
    schema = f"q {qkind}, c {kind}, s double"

    def matrix(rows) -> tuple[np.ndarray, np.ndarray]:
        """All vectors of some rows, and where each row's begin."""
        return np.array([x for v in rows for x in v], dtype=np.float64), np.cumsum([0, *map(len, rows)][:-1])

    def mapped(shared):
        def run(parts):
            ids, x, first = shared.value
            for part in parts:
                part = part.sort_values("c", kind="stable")
                keys, rows = part["c"].to_numpy(), part["v"].to_list()
                width = max(map(len, rows), default=1)
                step = max(1, SLICE // (len(x) * width))
                best, top = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=keys.dtype)
                for a in range(0, len(rows), step):
                    y, start = matrix(rows[a : a + step])
                    s = np.round(np.add.reduceat(np.maximum.reduceat(x @ y.T, start, axis=1), first, axis=0), 6)
                    # Keys rise from slice to slice, so a stable sort settles ties by key.
                    s, c = np.hstack([best, s]), np.hstack([top, np.broadcast_to(keys[a : a + step], s.shape)])
                    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    best, top = np.take_along_axis(s, order, axis=1), np.take_along_axis(c, order, axis=1)
                yield pd.DataFrame({"q": np.repeat(ids, best.shape[1]), "c": top.ravel(), "s": best.ravel()})

        return run

    def blocks():
        rows = []
        for r in queries.select(F.col(query_key).alias("q"), F.col(query_late).alias("v")).where(F.size("v") > 0).toLocalIterator():
            rows.append(r)
            if len(rows) == block:
                yield rows
                rows = []
        if rows:
            yield rows

    best = corpus.sparkSession.createDataFrame([], schema)
    for rows in blocks():
        shared = corpus.sparkSession.sparkContext.broadcast(([r.q for r in rows], *matrix([r.v for r in rows])))
        best = best.unionByName(some.mapInPandas(mapped(shared), schema))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c"))).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("c").alias(key), F.col("s").alias("score"), "rank")
