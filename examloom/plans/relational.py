"""Queries of set operations, snapshot differences, reshaping and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.operators import diff
from examloom.plans.base import query, table

TWO = "WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 14 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0)"


def _two(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    k = F.col("o_orderkey")
    local = orders.where(k % 10 != 0)
    remote = orders.where(k % 11 != 0).withColumns({"o_orderstatus": F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")), "o_totalprice": F.when(k % 14 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))})
    return local, remote


@query(TWO + """ SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'append' WHEN a.o_orderkey IS NULL THEN 'delete' WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'patch' ELSE 'unchanged' END AS action,
CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN [] ELSE list_filter([CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END, CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END], lambda x: x IS NOT NULL) END AS changed FROM a FULL JOIN b USING (o_orderkey)""")
def snapshot_diff(spark, d):
    return diff.snapshot_diff(*_two(spark, d), "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query(TWO + " SELECT o_orderkey, o_orderstatus, o_totalprice FROM a")
def snapshot_apply(spark, d):
    local, remote = _two(spark, d)
    plan = diff.snapshot_diff(local, remote, "o_orderkey", ["o_orderstatus", "o_totalprice"])
    return diff.apply_diff(local, remote, plan, "o_orderkey")


@query("SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 'english' ELSE 'other' END AS bucket FROM documents")
def language_buckets_union(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return docs.where("lang = 'en'").withColumn("bucket", F.lit("english")).unionByName(docs.where("lang <> 'en'").withColumn("bucket", F.lit("other")))


@query("SELECT source FROM documents EXCEPT SELECT source FROM documents WHERE doc_id % 2 = 0 AND source < 'src5'")
def dataset_difference(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("source").exceptAll(docs.select("source").limit(0)).distinct().subtract(docs.where("doc_id % 2 = 0 AND source < 'src5'").select("source"))


@query("SELECT conv_id, list(role ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY 1")
def group_rows_ordered(spark, d):
    rows = table(spark, d, "conversations")
    g = diff.grouped(rows, "conv_id", F.col("turn"), ["role"])
    return g.select("conv_id", F.transform("questions", lambda x: x["role"]).alias("roles"), F.size("questions").cast("long").alias("n"))


@query("SELECT conv_id, len(list(turn) FILTER (role = 'user'))::BIGINT AS n FROM conversations GROUP BY 1")
def rebuild_groups(spark, d):
    rows = table(spark, d, "conversations")
    out = diff.rebuilt(rows.select("conv_id").distinct(), rows.where("role = 'user'"), "conv_id", "turn", ["role", "text"])
    return out.select("conv_id", F.size("questions").cast("long").alias("n"))


@query("SELECT c.c_custkey, coalesce(n1.n_name, n2.n_name) AS place FROM customer c LEFT JOIN nation n1 ON c.c_nationkey = n1.n_nationkey AND c.c_custkey % 2 = 0 LEFT JOIN nation n2 ON c.c_nationkey % 5 = n2.n_nationkey")
def lookup_with_fallback(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation").select("n_nationkey", "n_name")
    exact = n.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("a"))
    other = n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("b"))
    out = c.join(exact, (F.col("c_nationkey") == F.col("k1")) & (F.col("c_custkey") % 2 == 0), "left").join(other, F.col("c_nationkey") % 5 == F.col("k2"), "left")
    return out.select("c_custkey", F.coalesce("a", "b").alias("place"))


@query("SELECT event_type, list(DISTINCT user_id ORDER BY user_id) AS users FROM events GROUP BY 1")
def keyed_set_upsert(spark, d):
    """The users of every event type."""
    return table(spark, d, "events").groupBy("event_type").agg(F.array_sort(F.collect_set("user_id")).alias("users"))


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON l_orderkey = o_orderkey")
def selected_ids_semi(spark, d):
    keep = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey").join(keep, "l_orderkey", "left_semi").agg(F.count("*").alias("n"), F.countDistinct("l_orderkey").alias("orders"))


@query("""SELECT o_orderkey, coalesce(e.l_partkey, f.l_partkey) AS part FROM (SELECT o_orderkey, o_orderkey % 5 + 1 AS l_linenumber FROM orders) o
LEFT JOIN (SELECT l_orderkey, l_linenumber, arg_min(l_partkey, l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) e ON o_orderkey = e.l_orderkey AND o.l_linenumber = e.l_linenumber
LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, struct_pack(a := l_linenumber, b := l_partkey)) AS l_partkey FROM lineitem GROUP BY 1) f ON o_orderkey = f.l_orderkey WHERE coalesce(e.l_partkey, f.l_partkey) IS NOT NULL""")
def remap_with_fallback(spark, d):
    """The part of one line of every order, or else of its first line."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("l_linenumber"))
    files = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_partkey")
    got = diff.remapped(rows, files.withColumn("line", F.col("l_linenumber")), ["l_orderkey", "l_linenumber"], "l_orderkey", "line", "l_partkey", "part")
    return got.select(F.col("l_orderkey").alias("o_orderkey"), "part")


@query("SELECT c.conv_id, coalesce(t.texts, []) AS texts FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, list(role || ': ' || text ORDER BY turn) AS texts FROM conversations WHERE role = 'user' GROUP BY 1) t USING (conv_id)")
def rebuilt_contents(spark, d):
    """Groups with their rows looked up again, in order; those without stay empty."""
    rows = table(spark, d, "conversations")
    out = diff.rebuilt(rows.select("conv_id").distinct(), rows.where("role = 'user'"), "conv_id", "turn", ["role", "text"])
    return out.select("conv_id", F.transform("questions", lambda q: F.concat(q["role"], F.lit(": "), q["text"])).alias("texts"))
