"""Queries of metrics, score aggregates and recency."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.functions import metrics as M
from examloom.functions import text as X
from examloom.operators import aggregates as A
from examloom.operators import dedup
from examloom.plans.base import query, table

IDS = """WITH t AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber) AS p0, list(l_linestatus ORDER BY l_linenumber) AS e0 FROM lineitem GROUP BY l_orderkey),
u AS (SELECT l_orderkey, list_distinct(p0) AS p, list_distinct(list_append(e0, 'A')) AS e FROM t),
m AS (SELECT l_orderkey, len(list_intersect(p, e)) AS tp, len(p) AS np, len(e) AS ne FROM u)"""


def _ids(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("p"), F.collect_list("l_linestatus").alias("e"))
    return rows.select("l_orderkey", "p", F.concat("e", F.array(F.lit("A"))).alias("e"))


@query(IDS + """ SELECT l_orderkey, tp::BIGINT AS tp, round(tp / np, 6)::DOUBLE AS precision, round(tp / ne, 6)::DOUBLE AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (np + ne) END, 6)::DOUBLE AS f1 FROM m""")
def question_prf1(spark, d):
    p, e = F.col("p"), F.col("e")
    return _ids(spark, d).select("l_orderkey", M.true_positives(p, e).cast("long").alias("tp"), F.round(M.precision(p, e), 6).alias("precision"), F.round(M.recall(p, e), 6).alias("recall"), F.round(M.f1(p, e), 6).alias("f1"))


@query(IDS + """, x AS (SELECT *, l_orderkey % 5 = 0 AS bad, CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (np + ne) END AS f FROM m)
SELECT l_orderkey, CASE WHEN bad THEN 0.0 ELSE round(f, 6) END::DOUBLE AS score, CASE WHEN bad THEN 'error' WHEN f = 1 THEN 'perfect' WHEN f = 0 THEN 'none' ELSE 'partial' END AS label FROM x""")
def prf1_error_labels(spark, d):
    p = F.when(F.col("l_orderkey") % 5 != 0, F.col("p"))
    return _ids(spark, d).select("l_orderkey", M.evaluated(M.f1, p, F.col("e")).alias("x")).select("l_orderkey", F.round("x.score", 6).alias("score"), "x.label")


SCORES = """WITH p AS (SELECT l_returnflag AS dataset, l_suppkey AS experiment, count(*) AS run_count, count(l_discount) AS scored, sum(l_discount) AS total, sum(l_discount * l_discount) AS squares, min(l_discount) AS lowest, max(l_discount) AS highest FROM lineitem GROUP BY ALL),
f AS (SELECT *, total / scored AS mean, CASE WHEN scored > 1 THEN greatest(0, (squares - total * total / scored) / (scored - 1)) WHEN scored = 1 THEN 0 END AS variance FROM p),
g AS (SELECT *, sqrt(variance) AS sd, sqrt(variance) / sqrt(scored) AS se FROM f)"""


def _scores(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("experiment"), "l_discount")
    return A.final_scores(A.score_partials(rows, ["dataset", "experiment"], F.col("l_discount")))


@query(SCORES + " SELECT dataset, experiment, scored, round(mean, 6) AS mean, round(variance, 6)::DOUBLE AS variance, round(se, 6)::DOUBLE AS se, lowest, highest FROM g")
def standard_errors(spark, d):
    return _scores(spark, d).select("dataset", "experiment", "scored", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"), F.round("se", 6).alias("se"), "lowest", "highest")


@query(SCORES + """, m AS (SELECT dataset, sum(run_count)::BIGINT AS run_count, sum(scored)::BIGINT AS scored, sum(total) AS total, CASE WHEN count(*) FILTER (experiment % 10 = 3 AND lowest <> highest) = 0 THEN sum(squares) END AS squares, min(lowest) AS lowest, max(highest) AS highest FROM p GROUP BY dataset)
SELECT dataset, run_count, scored, round(total, 4) AS total, round(squares, 4)::DOUBLE AS squares, lowest, highest FROM m""")
def score_partials_merge(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("dataset"), F.col("l_suppkey").alias("experiment"), "l_discount")
    parts = A.score_partials(rows, ["dataset", "experiment"], F.col("l_discount"))
    summary = A.summary_partials(parts, F.col("total") / F.col("scored"), F.col("scored"), F.col("lowest"), F.col("highest"))
    mixed = parts.where("experiment % 10 <> 3").unionByName(summary.where("experiment % 10 = 3"))
    return A.merged(mixed, ["dataset"]).select("dataset", "run_count", "scored", F.round("total", 4).alias("total"), F.round("squares", 4).alias("squares"), "lowest", "highest")


@query(SCORES + " SELECT experiment % 5 AS model, count(DISTINCT dataset) AS datasets, count(DISTINCT experiment) AS experiments, round(sum(total) / sum(scored), 6) AS weighted_mean, round(avg(mean), 6) AS unweighted_mean, round(sqrt(sum(se * se)) / count(se), 6)::DOUBLE AS unweighted_se FROM g GROUP BY 1")
def weighted_vs_unweighted_mean(spark, d):
    out = A.over_experiments(_scores(spark, d).withColumn("model", F.col("experiment") % 5), ["model"])
    return out.select("model", "datasets", "experiments", *(F.round(c, 6).alias(c) for c in ("weighted_mean", "unweighted_mean", "unweighted_se")))


@query(SCORES + " SELECT sum(run_count)::BIGINT AS run_count, round(sum(total) / sum(scored), 6) AS mean FROM g")
def grand_total(spark, d):
    return _scores(spark, d).agg(F.sum("run_count").alias("run_count"), F.round(F.sum("total") / F.sum("scored"), 6).alias("mean"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_key(spark, d):
    t = X.timestamp_or_never("o_orderdate")
    return dedup.latest(table(spark, d, "orders"), ["o_custkey"], t, t, F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, CASE WHEN o_orderkey % 9 = 0 THEN TIMESTAMP '0001-01-01' ELSE o_orderdate END DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_prefer_scored(spark, d):
    t = X.timestamp_or_never(F.when(F.col("o_orderkey") % 9 == 0, "not a time").otherwise(F.col("o_orderdate").cast("string")))
    return dedup.latest(table(spark, d, "orders"), ["o_custkey"], t, t, F.col("o_orderkey"), prefer=F.col("o_orderstatus") == "F").select("o_custkey", "o_orderkey")


BIN = "CASE WHEN s IS NULL THEN 'missing' WHEN abs(s) < 1e-9 THEN 'zero' WHEN abs(s - 1) < 1e-9 THEN 'one' WHEN s > 0 AND s < 1 THEN 'partial' ELSE 'other' END"


@query(f"""SELECT lang, {", ".join(f"count(*) FILTER (b = '{k}') AS {k}" for k in ("zero", "partial", "one", "other", "missing"))} FROM (SELECT lang, {BIN} AS b FROM (SELECT lang, CASE WHEN doc_id % 6 = 0 THEN 0.4 WHEN doc_id % 6 = 1 THEN 2 ELSE quality END AS s FROM documents LEFT JOIN labels USING (doc_id))) GROUP BY lang""")
def score_histogram_bins(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    s = F.when(F.col("doc_id") % 6 == 0, F.lit(0.4)).when(F.col("doc_id") % 6 == 1, F.lit(2.0)).otherwise(F.col("quality").cast("double"))
    return A.histogram(rows, ["lang"], s)


@query("SELECT CASE o_orderpriority WHEN '1-URGENT' THEN '2-HIGH' ELSE o_orderpriority END AS model, round(avg(m), 4) AS mean, sum(n)::BIGINT AS n FROM (SELECT o_orderpriority, avg(o_totalprice) AS m, count(*) AS n FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1) GROUP BY 1")
def alias_merge(spark, d):
    per = table(spark, d, "orders").where(~F.col("o_orderpriority").isin("5-LOW")).groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("n"))
    return per.groupBy(X.alias("o_orderpriority", {"1-URGENT": "2-HIGH"}).alias("model")).agg(F.round(F.avg("m"), 4).alias("mean"), F.sum("n").alias("n"))


@query("SELECT coalesce(nullif(CASE WHEN event_id % 8 = 0 THEN '' ELSE event_type END, ''), '(unnamed)') AS name, count(*) AS n, count(s) AS scored, count(*) - count(s) AS missing, round(avg(s), 6) AS mean, min(s) AS lowest, max(s) AS highest FROM (SELECT *, CASE WHEN event_id % 5 <> 0 THEN value END AS s FROM events) GROUP BY 1")
def annotation_stats(spark, d):
    rows = table(spark, d, "events").select(F.when(F.col("event_id") % 8 == 0, "").otherwise(F.col("event_type")).alias("t"), F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("s"))
    return A.annotation_stats(rows, F.col("t"), F.col("s")).withColumn("mean", F.round("mean", 6))


@query("SELECT event_type, count(*) AS runs, sum(user_id)::BIGINT AS tokens, round(sum(value), 4) AS cost, round(sum(user_id) / count(*), 6)::DOUBLE AS mean_tokens, round(sum(value) / count(*), 6) AS mean_cost, round(sum(CASE WHEN event_id % 3 <> 0 THEN value END) / count(CASE WHEN event_id % 3 <> 0 THEN value END), 6) AS mean_latency FROM events GROUP BY 1")
def usage_rollup(spark, d):
    out = A.usage(table(spark, d, "events"), ["event_type"], F.col("user_id"), F.col("value"), F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return out.withColumns({"cost": F.round("cost", 4)} | {c: F.round(c, 6) for c in ("mean_tokens", "mean_cost", "mean_latency")})
