"""Queries of counts, shares and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from examloom.functions import metrics as M
from examloom.functions import text as X
from examloom.operators import aggregates as A
from examloom.operators import packing, resume
from examloom.plans.base import query, table


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN floor(1000.0 * {a} / {b} + 0.5) / 10 ELSE 0 END::DOUBLE"


@query("SELECT event_type, bucket, day, grouping_id(event_type, bucket, day)::BIGINT AS level, count(*) AS n FROM (SELECT event_type, user_id % 4 AS bucket, CAST(ts AS DATE) AS day FROM events) GROUP BY GROUPING SETS ((event_type), (event_type, bucket), (event_type, day), (event_type, bucket, day))")
def grouping_sets_mode_stats(spark, d):
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 4).alias("bucket"), F.to_date("ts").alias("day"))
    return A.counts_over_sets(rows, [["event_type"], ["event_type", "bucket"], ["event_type", "day"], ["event_type", "bucket", "day"]], ["event_type", "bucket", "day"])


@query("SELECT v AS event_type, coalesce(n, 0) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('signup'), ('never')) t(v) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e ON v = event_type")
def dense_distribution(spark, d):
    return A.dense_counts(table(spark, d, "events"), "event_type", ["click", "view", "purchase", "signup", "never"])


@query(f"SELECT source, n, {pct('n', 'total')} AS pct FROM (SELECT source, count(*) AS n, sum(count(*)) OVER () AS total FROM documents GROUP BY 1) ORDER BY n DESC, source")
def sorted_counts_pct(spark, d):
    docs = table(spark, d, "documents")
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("source", "n", X.percent(F.col("n"), F.col("total")).alias("pct")).orderBy(F.desc("n"), "source")


@query(f"""WITH f AS (SELECT doc_id, list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 3) AS fs FROM (SELECT doc_id, [lang, source, lang, 'all', 'x' || (doc_id % 3)::VARCHAR] AS l FROM documents)),
e AS (SELECT doc_id, unnest(fs) AS facet FROM f), t AS (SELECT count(DISTINCT doc_id) AS q, count(*) AS a FROM e)
SELECT facet, count(*) AS n, {pct('count(*)', 'any_value(q)')} AS pct_questions, {pct('count(*)', 'any_value(a)')} AS pct_assignments FROM e, t GROUP BY facet""")
def facet_usage(spark, d):
    facets = F.slice(F.array_distinct(F.array("lang", "source", "lang", F.lit("all"), F.concat(F.lit("x"), (F.col("doc_id") % 3).cast("string")))), 1, 3)
    docs = table(spark, d, "documents").select("doc_id", facets.alias("fs"))
    total = docs.agg(F.count("*").alias("q"), F.sum(F.size("fs")).alias("a"))
    n = docs.select(F.explode("fs").alias("facet")).groupBy("facet").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(total)).select("facet", "n", X.percent(F.col("n"), F.col("q")).alias("pct_questions"), X.percent(F.col("n"), F.col("a")).alias("pct_assignments"))


@query("""WITH t AS (SELECT l_orderkey, list(l_returnflag) AS c FROM lineitem GROUP BY 1),
u AS (SELECT CASE WHEN len(c) <= 1 THEN 'single' WHEN len(list_distinct(c)) < len(c) OR len(list_filter(c, lambda x: x NOT IN ('A', 'N'))) > 0 THEN 'garbled' WHEN len(list_distinct(c)) = 2 THEN 'all_correct' ELSE 'plausible_multi' END AS category FROM t) SELECT category, count(*) AS n FROM u GROUP BY 1""")
def multi_answer_audit(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("c"))
    return rows.groupBy(M.multi_answer_category(F.col("c"), F.array(F.lit("A"), F.lit("N"))).alias("category")).agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT doc_id, quality, unnest(list_distinct(list_filter(['the', 'der', 'que', 'les'], lambda w: contains(lower(text), w)))) AS keyword FROM documents JOIN labels USING (doc_id))
SELECT keyword, count(*) AS total, sum(quality)::BIGINT AS relevant, (count(*) - sum(quality))::BIGINT AS irrelevant, {pct('sum(quality)', 'count(*)')} AS pct FROM k GROUP BY 1""")
def keyword_effectiveness(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    found = F.filter(F.array(*map(F.lit, ("the", "der", "que", "les"))), lambda w: F.contains(F.lower("text"), w))
    k = docs.select("quality", F.explode(found).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("total"), F.sum("quality").alias("relevant"))
    return k.select("keyword", "total", "relevant", (F.col("total") - F.col("relevant")).alias("irrelevant"), X.percent(F.col("relevant"), F.col("total")).alias("pct"))


@query("""WITH k AS (SELECT len(list_filter(['the', 'der', 'que', 'les'], lambda w: contains(lower(text), w))) AS n FROM documents)
SELECT count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multiple, round(avg(n), 2) AS mean FROM k WHERE n > 0""")
def overlap_analysis(spark, d):
    n = F.size(F.filter(F.array(*map(F.lit, ("the", "der", "que", "les"))), lambda w: F.contains(F.lower("text"), w)))
    return table(spark, d, "documents").select(n.alias("n")).where("n > 0").agg(F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multiple"), F.round(F.avg("n"), 2).alias("mean"))


BUCKETS = {"license": ["license", "licence"], "contact": ["@", "http"], "question": ["?"], "article": ["the ", "der ", "las "]}


@query(" UNION ALL ".join(f"SELECT '{p}' AS pattern, count(*) AS n, list(conv_id ORDER BY conv_id, turn)[1:3] AS examples FROM conversations WHERE {' OR '.join(f'''contains(lower(text), '{k}')''' for k in ks)} HAVING count(*) > 0" for p, ks in BUCKETS.items()))
def pattern_buckets(spark, d):
    rows = table(spark, d, "conversations")
    named = F.array_compact(F.array(*(F.when(X.matches_keyword(ks, F.col("text")), F.lit(p)) for p, ks in BUCKETS.items())))
    hits = rows.select("conv_id", "turn", F.explode(named).alias("pattern"))
    counts = hits.groupBy("pattern").agg(F.count("*").alias("n"))
    first = packing.per_key(hits, ["pattern"], [F.col("conv_id"), F.col("turn")], 3).groupBy("pattern").agg(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", "turn"))), lambda x: x["conv_id"]).alias("examples"))
    return counts.join(first, "pattern").select("pattern", "n", "examples")


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def nearest_rank_percentile(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(A.nearest_rank("value", 0.5).alias("p50"), A.nearest_rank("value", 0.95).alias("p95"))


@query("SELECT event_type, count(*) AS n, round(count(*) * 60.0 / greatest(1, date_diff('second', min(ts), max(ts))), 6)::DOUBLE AS per_minute, round(avg(value), 6) AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def throughput(spark, d):
    seconds = F.greatest(F.lit(1), F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts")))
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count("*") * 60.0 / seconds, 6).alias("per_minute"), F.round(F.avg("value"), 6).alias("mean"), A.nearest_rank("value", 0.5).alias("p50"), A.nearest_rank("value", 0.95).alias("p95"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def hard_examples_semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 0"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT lang, count(*) FILTER (quality = 0) AS hard, count(*) AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def hard_example_counts(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("lang").agg(F.count_if(F.col("quality") == 0).alias("hard"), F.count("*").alias("total"))


@query("""WITH s AS (SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_totalprice) < 20000)
SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders WHERE o_custkey IN (SELECT o_custkey FROM s) AND o_totalprice < 20000) WHERE r = 1""")
def failed_runs_latest(spark, d):
    orders = table(spark, d, "orders")
    able = orders.groupBy("o_custkey").agg(F.min("o_totalprice").alias("m")).where("m < 20000")
    failed = orders.where("o_totalprice < 20000").join(able, "o_custkey", "left_semi")
    return packing.per_key(failed, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 1).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_pending_anti(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return resume.pending(table(spark, d, "orders"), done, ["o_orderkey"]).select("o_orderkey")


@query("""WITH s AS (SELECT 1 AS stage, (SELECT count(*) FROM documents) AS before, (SELECT count(*) - count(DISTINCT text) FROM documents) AS removed UNION ALL SELECT 2, 0, (SELECT count(*) FROM labels WHERE quality = 0) UNION ALL SELECT 3, 0, (SELECT count(*) FROM labels WHERE toxic = 1))
SELECT stage, removed, (first_value(before) OVER (ORDER BY stage) - sum(removed) OVER (ORDER BY stage))::BIGINT AS after FROM s""")
def stage_summary(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    one = docs.agg(F.lit(1).alias("stage"), F.count("*").alias("before"), (F.count("*") - F.countDistinct("text")).alias("removed"))
    two = labels.agg(F.lit(2).alias("stage"), F.lit(0).cast("long").alias("before"), F.count_if(F.col("quality") == 0).alias("removed"))
    three = labels.agg(F.lit(3).alias("stage"), F.lit(0).cast("long").alias("before"), F.count_if(F.col("toxic") == 1).alias("removed"))
    return packing.cumulative_stages(one.unionByName(two).unionByName(three), "stage", "before", "removed").select("stage", "removed", "after")


@query("SELECT lang, sum(least(n, 100))::BIGINT AS capped, sum(n)::BIGINT AS total FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY 1")
def dataset_counts_capped(spark, d):
    n = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(F.sum(F.least("n", F.lit(100))).alias("capped"), F.sum("n").alias("total"))


@query("SELECT coalesce(CASE WHEN doc_id % 10 <> 0 THEN lang END, 'unknown') AS type, count(*) AS n FROM documents GROUP BY 1")
def type_counts(spark, d):
    return table(spark, d, "documents").groupBy(F.coalesce(F.when(F.col("doc_id") % 10 != 0, F.col("lang")), F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def top_topics(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("SELECT count(*) AS selected, count(*) AS processed, count(*) FILTER (quality = 1) AS converted, count(*) FILTER (quality = 0) AS skipped FROM labels")
def checkpoint_counts(spark, d):
    rows = table(spark, d, "labels").select(F.when(F.col("quality") == 1, "converted").otherwise("skipped").alias("status"))
    return resume.progress(rows, rows.count()).withColumn("selected", F.col("selected").cast("long"))


@query("SELECT event_id, floor((row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) / 50)::BIGINT AS batch FROM events")
def fixed_batches(spark, d):
    return packing.batches(table(spark, d, "events"), [F.col("event_id")], 50, ["event_type"]).select("event_id", "batch")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
p AS (SELECT source, doc_id, r, 0::BIGINT AS bin, n_chars AS used FROM o WHERE r = 1 UNION ALL
SELECT o.source, o.doc_id, o.r, CASE WHEN p.used > 0 AND p.used + o.n_chars > 20000 THEN p.bin + 1 ELSE p.bin END, CASE WHEN p.used > 0 AND p.used + o.n_chars > 20000 THEN o.n_chars ELSE p.used + o.n_chars END FROM p JOIN o ON o.source = p.source AND o.r = p.r + 1)
SELECT source, doc_id, bin FROM p""")
def budget_packing(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return packing.pack(docs, "source", "doc_id", "n_chars", 20000).select("source", "doc_id", F.col("bin").cast("long").alias("bin"))


@query("SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, d):
    from examloom.streaming.incremental import tumbling

    return tumbling(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
k AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM k GROUP BY user_id, k""")
def session_counts(spark, d):
    from examloom.streaming.incremental import sessions

    return sessions(table(spark, d, "events"), "30 minutes")


@query("SELECT event_type, round(value - first_value(value) OVER w, 6) AS gap, event_id FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value, event_id) QUALIFY row_number() OVER w <= 5")
def ranked_events(spark, d):
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    rows = table(spark, d, "events").select("event_type", "event_id", "value", F.row_number().over(w).alias("r"), F.first("value").over(w).alias("v0")).where("r <= 5")
    return rows.select("event_type", F.round(F.col("value") - F.col("v0"), 6).alias("gap"), "event_id")
