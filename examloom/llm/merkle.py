"""Merkle manifest of a dataset, with a proof for every row by coordinate lookup (operator 13).

A row's leaf is a hash of its fields.  The leaves of a source, by id, are a tree
of runs of ``FAN`` nodes; the sources' subroots, in order, are another tree,
whose root stands for the whole table.  H is SHA-256 of its inputs, concatenated,
in lower-case hexadecimal digits.

The nodes of each level are a table, by run: (g, level, run, digests).  A leaf's
siblings have coordinates that follow from its index and its group's size alone:
its own run at level 0, and at level k the run with its index shifted by the runs
below.  All leaves of a run need the same ones above it; so the runs explode
these coordinates, once for all of their leaves, join the table of nodes, and
put what they find in order.  A leaf folds its own run's siblings and these.

Ranks within a source, whatever its size, come from a range partitioning: a
row's place in its partition plus the number of its source's rows in the
partitions before.  Nodes at the top are wanted by very many runs; they are
copied, and the runs dealt to the copies, so that no copy is joined with more
than about ``WANTED`` of them.  No level is taken to the driver, only how many
nodes the largest group has, and the root.

Null fields have the value ``-``.  A null source comes before all others, a null
id before all others of its source; rows with equal ids are in order of their
leaves, and equal rows are leaves of their own.  An empty table gives no rows.
Other columns take no part, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.storage import discard, stored

FAN, SHIFT = 16, 4
#: Runs dealt to one copy of a node.
WANTED = 4096
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def h(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """A value with its length before it, in bytes of UTF-8."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return h(*map(field, values))


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """df with idx, each row's rank from 0 in its group by the order, and size, the group's number of rows."""
    # Equal rows are told apart by where they were read, so that no partition has more than its share of them.
    dealt = df.withColumn("__at", F.monotonically_increasing_id())
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [group, *order, "__at"]
    sorted_ = stored(dealt.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    counts = sorted_.groupBy(group, part.alias("__part")).agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    # At most a row for each partition that a group has rows in.
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).withColumn("size", F.sum("n").over(Window.partitionBy(group)))
    offsets = stored(offsets.select(F.col(group).alias("__g"), F.col("__part").alias("__p"), "offset", "size"), "offsets")
    out = sorted_.join(offsets, (F.col(group) == F.col("__g")) & (part == F.col("__p")))
    out = stored(out.select(*df.columns, (F.col("__at") + F.col("offset")).alias("idx"), "size"), "ranked")
    discard(sorted_, offsets)
    return out


def levels(size: Column) -> Column:
    """How many levels of runs a group of so many nodes has."""
    return F.when(size <= 1, 0).otherwise(F.ceil(F.length(F.bin(size - 1)) / SHIFT)).cast("int")


def tree(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes (g, idx, size, digest): the runs (g, level, run, digests), stored by level, and the roots (g, root), stored."""
    roots = nodes.where("size = 1").select("g", F.col("digest").alias("root"))
    most = nodes.agg(F.max("size")).first()[0] or 0
    now, runs, level = nodes.where("size > 1").select("g", "idx", "size", "digest"), [], 0
    while most > 1:
        run = F.shiftright("idx", SHIFT).alias("run")
        grouped = now.groupBy("g", run).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("d"), F.first("size").alias("size"))
        runs.append(stored(grouped.select("g", F.lit(level).alias("level"), "run", F.col("d.digest").alias("digests"), F.ceil(F.col("size") / FAN).alias("above")), "runs"))
        above = runs[-1].select("g", F.col("run").alias("idx"), F.col("above").alias("size"), F.sha2(F.array_join("digests", ""), 256).alias("digest"))
        roots = roots.unionByName(above.where("size = 1").select("g", F.col("digest").alias("root")))
        now, most, level = above.where("size > 1"), -(-most // FAN), level + 1
    if not runs:
        empty = nodes.where("false").select("g", F.lit(0).alias("level"), F.col("idx").alias("run"), F.array("digest").alias("digests"), F.col("size").alias("above"))
        runs = [stored(empty, "runs")]
    table = runs[0]
    for x in runs[1:]:
        table = table.unionByName(x)
    table.parts = runs
    return table, stored(roots, "roots")


def siblings(digests: Column, position: Column) -> Column:
    """What stands before and after a position of a run."""
    position = position.cast("int")
    return F.struct(F.array_join(F.slice(digests, 1, position), "").alias("pre"), F.array_join(F.slice(digests, position + 2, FAN), "").alias("post"))


def paths(wanted: DataFrame, runs: DataFrame, first: int) -> DataFrame:
    """For wanted (g, idx, size), nodes at level first with their group's size at level 0: (g, idx, path), the siblings from that level on, in order."""
    level = F.explode(F.sequence(F.lit(first), levels(F.col("size")) - 1)).alias("level")
    at = wanted.where(levels(F.col("size")) > first).select("g", "idx", level)
    run = F.expr(f"shiftright(idx, {SHIFT} * (level - {first} + 1))")
    position = F.expr(f"shiftright(idx, {SHIFT} * (level - {first})) & {FAN - 1}")
    # A node at the level has at most FAN ** (level - first + 1) of the wanted below it.
    copies = F.greatest(F.lit(1), F.ceil(F.pow(F.lit(float(FAN)), F.col("level") - first + 1) / WANTED)).cast("long")
    at = at.select("g", "idx", "level", run.alias("run"), position.alias("position"), F.pmod(F.xxhash64("idx"), copies).alias("copy"))
    nodes = runs.where(F.col("level") >= first).select("g", "level", "run", "digests", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    found = at.join(nodes, ["g", "level", "run", "copy"]).select("g", "idx", "level", siblings(F.col("digests"), F.col("position")).alias("s"))
    return found.groupBy("g", "idx").agg(F.array_sort(F.collect_list(F.struct("level", "s"))).alias("p")).select("g", "idx", F.col("p.s").alias("path"))


def fold(digest: Column, path: Column) -> Column:
    """The root that a digest and its siblings make."""
    return F.aggregate(path, digest, lambda d, s: F.sha2(F.concat(s["pre"], d, s["post"]), 256))


def manifest(docs: DataFrame, fields: list[str] = FIELDS, key: str = "doc_id", group: str = "source", tampered: dict[str, Column] | None = None) -> DataFrame:
    """Per row: the key, leaf, subroot, root, proof_sha256, folded_root and verified.

    tampered: for some of the fields another value with which the leaf is made
    that is folded; so a row whose fields are changed is found out.
    """
    none = F.array().cast("array<struct<pre:string,post:string>>")
    values, changed = [docs[c] for c in fields], [(tampered or {}).get(c, docs[c]) for c in fields]
    rows = docs.select(F.coalesce(F.concat(F.lit("="), docs[group].cast("string")), F.lit("")).alias("g"), docs[key].alias("id"), leaf(*values).alias("digest"), leaf(*changed).alias("shown"))
    rows = stored(rows, "leaves")
    leaves = ranked(rows, "g", ["id", "digest"])
    runs, roots = tree(leaves)
    # The tree of the sources' subroots is one group.
    tops = ranked(roots.withColumn("one", F.lit(0)), "one", ["g"])
    top_nodes = tops.select(F.lit("").alias("g"), "idx", "size", F.col("root").alias("digest"))
    top_runs, top_root = tree(top_nodes)
    root = (top_root.first() or {"root": None})["root"]
    top_paths = paths(top_nodes.select("g", "idx", "size"), top_runs, 0).select("idx", F.col("path").alias("top_path"))
    sizes = leaves.groupBy("g").agg(F.first("size").alias("n"))
    copies = F.greatest(F.lit(1), F.ceil(F.col("n") / (FAN * WANTED))).cast("long")
    by_source = tops.select("g", "idx", F.col("root").alias("subroot")).join(top_paths, "idx", "left").join(sizes, "g").select("g", "subroot", F.coalesce("top_path", none).alias("top_path"), F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    # Leaf runs, and for groups of one leaf that leaf, with all that is above them.
    n = F.col("size")
    low = leaves.groupBy("g", F.shiftright("idx", SHIFT).alias("run")).agg(F.first("size").alias("size"))
    above = paths(low.where("size > 1").select("g", F.col("run").alias("idx"), "size"), runs, 1).withColumnRenamed("idx", "run")
    own = runs.where("level = 0").select("g", "run", "digests")
    low = low.join(above, ["g", "run"], "left").join(own, ["g", "run"], "left")
    low = low.withColumn("copy", F.pmod(F.xxhash64("run"), F.greatest(F.lit(1), F.ceil(n / (FAN * WANTED))).cast("long"))).join(by_source, ["g", "copy"])
    low = stored(low.select("g", "run", "subroot", "digests", F.concat(F.coalesce("path", none), "top_path").alias("path")), "paths")
    full = leaves.withColumn("run", F.shiftright("idx", SHIFT)).join(low, ["g", "run"]).withColumn("root", F.lit(root).cast("string"))
    first = F.when(F.col("digests").isNull(), none).otherwise(F.array(siblings(F.col("digests"), F.col("idx").bitwiseAND(F.lit(FAN - 1)))))
    full = full.select(F.col("id").alias(key), F.col("digest").alias("leaf"), "shown", "subroot", "root", F.concat(first, "path").alias("path"))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["pre"], s["post"])), ""), 256)
    full = full.select(key, "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("shown"), F.col("path")).alias("folded_root"))
    out = stored(full.withColumn("verified", F.col("folded_root") == F.col("root")), "manifest")
    discard(rows, leaves, *runs.parts, roots, tops, *top_runs.parts, top_root, low)
    return out


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return manifest(docs, tampered={"text": F.when(hit, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))})
