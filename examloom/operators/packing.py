"""Batches: by count, by budget; deterministic samples; caps over ordered groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.text import fnv1a
from examloom.storage import discard, stored


def next_bins(cost: np.ndarray, budget: int) -> np.ndarray:
    """Where the next bin begins, for one that begins at each place; len(cost) if no other does.

    That is the first row with which the budget is exceeded; but a bin without
    costs so far takes any row.
    """
    before = np.concatenate([[0], np.cumsum(cost, dtype=np.int64)])
    return np.minimum(_exceeded(before, before[:-1], budget), len(cost))


def _exceeded(before: np.ndarray, base: np.ndarray, budget: int) -> np.ndarray:
    """For bins with the given sums before them: the first place with more than that before it, from which on the budget is exceeded."""
    return np.maximum(np.searchsorted(before, base + budget, side="right") - 1, np.searchsorted(before, base, side="right"))


def _last(after: np.ndarray) -> np.ndarray:
    """The last bin of the part, for one that begins at each place: pointers followed by doubling."""
    hop = np.where(after < len(after), after, np.arange(len(after)))
    while (hop[hop] != hop).any():
        hop = hop[hop]
    return hop


def pack(df: DataFrame, key: str, pos: str, cost: str, budget: int, strict: bool = False, tasks: int | None = None) -> DataFrame:
    """Sequential bins within each key, by position: a new one begins when the next row would exceed the budget.

    A single row above the budget has a bin of its own (with rows of no cost
    before it), or with strict is an error.  Null costs count as 0; negative ones
    are an error.  Rows of equal position are in order of their cost.

    Where a bin begins depends on all bins before it, yet no task holds a key:

    1. Rows are range-partitioned by key and position.  A part is what one
       partition has of a key; sums before it follow from the parts' totals.
    2. A bin that is the last of its part, whichever row the part's first bin
       begins at, ends in the first later part with which the budget is exceeded.
       There it points to the last bin of that part.
    3. These pointers are followed from the key's first bin by doubling: a key in
       n parts takes log2(n) rounds.
    4. Each part then knows its first bin, and numbers its rows; the bins of the
       parts before are added.
    """
    spark = df.sparkSession
    value = F.coalesce(F.col(cost).cast("long"), F.lit(0).cast("long"))
    bad = df.where((value < 0) | (F.lit(strict) & (value > budget))).select(value.alias("c")).first()
    if bad is not None:
        raise ValueError(f"a row of {bad.c} exceeds the budget of {budget}" if bad.c > 0 else f"a row has the cost {bad.c}")
    by = [F.col(key), F.col(pos), value, F.col("__u")]
    dealt = df.withColumn("__u", F.monotonically_increasing_id()).repartitionByRange(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), *by)
    placed = stored(dealt.sortWithinPartitions(*by).withColumn("__u", F.monotonically_increasing_id()), "packed")
    rows = placed.select(F.col(key).alias("k"), F.shiftright("__u", 33).cast("int").alias("part"), F.col("__u").alias("u"), value.alias("c"))
    # A line for each part; a key is named by the number of its first row.
    sums = rows.groupBy("k", "part").agg(F.min("u").alias("first"), F.count("*").alias("n"), F.sum("c").alias("total"), F.max_by("c", "u").alias("tail"))
    line, whole = Window.partitionBy("k").orderBy("part"), Window.partitionBy("k")
    parts = stored(sums.select(F.col("k").alias("pk"), F.col("part").alias("pp"), F.min("first").over(whole).alias("kid"), F.row_number().over(line).alias("turn"), F.count("*").over(whole).alias("parts"), (F.sum("n").over(line) - F.col("n")).alias("row0"), (F.sum("total").over(line) - F.col("total")).alias("sum0"), "total", "tail"), "parts")
    rows = stored(rows.join(parts, F.col("k").eqNullSafe(F.col("pk")) & (F.col("part") == F.col("pp"))).select("kid", "part", "u", "c", "row0", "sum0", "turn", "parts"), "rows")
    used = [placed, parts, rows]

    def sums_of(part: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        part = part.sort_values("u")
        c = part["c"].to_numpy()
        return part, c, np.concatenate([[0], np.cumsum(c, dtype=np.int64)])

    def last_bins(part: pd.DataFrame) -> pd.DataFrame:
        """The bins that may be the last of the part, each with the sum before it; whether it is that of the key's first bin."""
        part, c, before = sums_of(part)
        at = _last(next_bins(c, budget))
        found = np.unique(at)
        turn, row0, sum0 = (part[x].iloc[0] for x in ("turn", "row0", "sum0"))
        return pd.DataFrame({"kid": part["kid"].iloc[0], "turn": turn, "row": row0 + found, "base": sum0 + before[found], "first": (turn == 1) & (found == at[0])})

    def entered(part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """Where bins from before the part end in it, and the last bin of the part that follows."""
        if not len(part) or not len(asked):
            return pd.DataFrame({"kid": [], "row": [], "part": [], "entry": [], "next": []})
        part, c, before = sums_of(part)
        at = _exceeded(before, asked["base"].to_numpy() - part["sum0"].iloc[0], budget)
        return pd.DataFrame({"kid": asked["kid"], "row": asked["row"], "part": asked["part"], "entry": at, "next": part["row0"].iloc[0] + _last(next_bins(c, budget))[at]})

    entries = parts.where("turn = 1").select("kid", F.col("pp").alias("part"), F.lit(0).cast("long").alias("entry"))
    several = parts.where("parts > 1")
    most = several.agg(F.max("parts")).first()[0]
    if most:
        ends = stored(rows.where("parts > 1").groupBy("kid", "part").applyInPandas(last_bins, "kid long, turn int, row long, base long, first boolean"), "ends")
        upto = F.col("sum0") + F.col("total")
        lines = several.groupBy("kid").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("pp").alias("part"), upto.alias("upto"), (upto - F.col("tail")).alias("held")))).alias("line"))
        # The part's last row exceeds the budget of a bin that holds something before it.
        goal = F.get(F.filter("line", lambda x: (x["turn"] > F.col("turn")) & (x["upto"] > F.col("base") + budget) & (x["held"] > F.col("base"))), F.lit(0))
        asked = ends.join(lines, "kid").select("kid", "row", "base", goal["part"].alias("part")).where("part IS NOT NULL")
        hops = stored(rows.where("parts > 1").groupBy("kid", "part").cogroup(asked.groupBy("kid", "part")).applyInPandas(entered, "kid long, row long, part int, entry long, next long"), "hops")
        reached, jump = stored(ends.where("first").select("kid", "row"), "reached"), hops.select("kid", "row", "next")
        used += [ends, hops, reached]
        while most > 1:
            more = reached.join(jump, ["kid", "row"]).select("kid", F.col("next").alias("row"))
            reached, most = stored(reached.unionByName(more).distinct(), "reached"), -(-most // 2)
            used.append(reached)
            if most > 1:
                jump = stored(jump.join(jump.select("kid", F.col("row").alias("next"), F.col("next").alias("far")), ["kid", "next"]).select("kid", "row", F.col("far").alias("next")), "jumps")
                used.append(jump)
        entries = entries.unionByName(hops.join(reached, ["kid", "row"]).select("kid", "part", "entry"))

    def numbered(part: pd.DataFrame, where: pd.DataFrame) -> pd.DataFrame:
        part, c, _ = sums_of(part)
        begun = np.zeros(len(c), dtype=np.int64)
        at, after = int(where["entry"].iloc[0]) if len(where) else len(c), next_bins(c, budget)
        while at < len(c):
            begun[at] = 1
            at = int(after[at])
        return pd.DataFrame({"u": part["u"], "kid": part["kid"], "part": part["part"], "n": np.cumsum(begun)})

    told = stored(rows.groupBy("kid", "part").cogroup(entries.groupBy("kid", "part")).applyInPandas(numbered, "u long, kid long, part int, n long"), "numbered")
    counts = told.groupBy("kid", "part").agg(F.max("n").alias("bins"))
    counts = counts.select("kid", "part", (F.sum("bins").over(Window.partitionBy("kid").orderBy("part")) - F.col("bins")).alias("bins"))
    number = told.join(counts, ["kid", "part"]).select(F.col("u").alias("__u"), (F.col("bins") + F.col("n") - 1).cast("int").alias("bin"))
    out = stored(placed.join(number, "__u").select(*df.columns, "bin"), "bins")
    discard(*used, told)
    return out


def batches(df: DataFrame, order: list[Column], size: int, keys: list[str] | None = None) -> DataFrame:
    """Numbered batches of a fixed size, in order within the keys."""
    w = Window.partitionBy(*(keys or [])).orderBy(*order)
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size))


def seeded_sample(df: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    """n rows drawn by a hash of the seed and the id: the same on every run, in any order of the rows."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_).cast("string"))), id_).limit(n)


#: Leading bits of a value that one pass of a selection looks at.
RADIX = 12


def lowest(df: DataFrame, group: str, value: str, bits: int, ties: list[str], n: DataFrame) -> DataFrame:
    """The rows of each group with the smallest values, as many as n (group, n) has for it; equal values in order of the ties.

    A radix selection: each pass counts, by group, the rows whose value begins
    like the cut found so far, by their next bits; the sums tell where the cut
    lies among these.  When all bits are known one filter takes what is below the
    cut, and only rows with exactly its value are ranked.  No group is sorted;
    counts are aggregated before they are shuffled.
    """
    rows = df.where(F.col(group).isNotNull())
    cut = n.select(F.col(group).alias("__g"), F.lit(0).cast("long").alias("cut"), F.col("n").cast("long").alias("need"))
    known = 0
    while known < bits:
        step = min(RADIX, bits - known)
        rest = bits - known - step
        here = rows.join(cut, F.col(group) == F.col("__g")).where(F.shiftright(value, bits - known) == F.col("cut")) if known else rows.join(cut, F.col(group) == F.col("__g"))
        counts = here.groupBy("__g", "cut", "need", F.shiftright(value, rest).alias("next")).agg(F.count("*").alias("c"))
        # At most 2 ** RADIX lines a group.
        upto = F.sum("c").over(Window.partitionBy("__g").orderBy("next"))
        all_ = F.sum("c").over(Window.partitionBy("__g"))
        counts = counts.withColumn("upto", upto).withColumn("need", F.least("need", all_))
        last = counts.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("c") < F.col("need")))
        cut = stored(last.select("__g", F.col("next").alias("cut"), (F.col("need") - F.col("upto") + F.col("c")).alias("need")), "cut")
        known += step
    told = rows.join(cut, F.col(group) == F.col("__g"))
    at = told.where(F.col(value) == F.col("cut")).withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*ties))).where("__r <= need")
    return told.where(F.col(value) < F.col("cut")).select(*df.columns).unionByName(at.select(*df.columns))


def percent_sample(df: DataFrame, dataset: str, id_: str, percent: float) -> DataFrame:
    """The share of each dataset's ids with the smallest hashes; at least one; repeated ids all stay."""
    if percent <= 0 or percent >= 100:
        return df
    ids = df.select(dataset, id_).distinct().withColumn("__h", fnv1a(F.concat(F.col(dataset), F.lit("::"), F.col(id_).cast("string"))))
    n = df.groupBy(dataset).agg(F.greatest(F.lit(1), F.ceil(F.count("*") * percent / 100)).alias("n"))
    chosen = lowest(ids, dataset, "__h", 32, [id_], n)
    return df.join(chosen.select(dataset, id_), [dataset, id_], "left_semi")


def capped(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first rows over all groups in order until the limit is spent."""
    return df.orderBy(*order).limit(limit)


def per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def suffixed_ids(df: DataFrame, base: str, order: list[Column], name: str = "unique_id") -> DataFrame:
    """base, and from the second occurrence on base-dup2, base-dup3 ..."""
    r = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    return df.withColumn("__r", r).withColumn(name, F.when(F.col("__r") == 1, F.col(base).cast("string")).otherwise(F.concat(F.col(base).cast("string"), F.lit("-dup"), F.col("__r").cast("string")))).drop("__r")


def renumbered(df: DataFrame, order: list[Column], name: str = "new_id") -> DataFrame:
    """Positions from 1 in order.  One global order is what is asked for: rows are range-partitioned, counted by partition and numbered inside."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    inside = spread.withColumn("__r", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    before = inside.groupBy("__part").agg(F.count("*").alias("n")).select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return inside.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__r")).drop("__part", "__r", "__before")


def cumulative_stages(df: DataFrame, order: str, before: str, removed: str) -> DataFrame:
    """Rows left after each stage, from the first stage's input."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("after", F.first(before).over(w) - F.sum(removed).over(w))
