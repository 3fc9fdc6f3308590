"""Queries of duplicate resolution and joins by similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.functions import text as X
from examloom.operators import dedup, filters, similarity
from examloom.plans.base import query, table
from examloom.plans.text import NORMAL

NEAR = 0.4


@query(f"""WITH t AS (SELECT doc_id, {NORMAL.format('text')} AS k, length(text) AS n FROM documents),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY k ORDER BY n DESC, doc_id) AS keep_id FROM t)
SELECT keep_id, count(*) AS group_size, coalesce(list(doc_id ORDER BY doc_id) FILTER (doc_id <> keep_id), []) AS removed_ids FROM r GROUP BY keep_id""")
def exact_dedup_groups(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.normalize_text("text").alias("k"), F.length("text").alias("n"))
    return dedup.groups(docs, F.col("k"), "doc_id", F.col("n"))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text", F.lit(None).cast("string").alias("original_id"), F.array("lang").alias("options"))
    return dedup.first_by_key(docs, "original_id", "text", "options", [F.col("doc_id")]).select("doc_id", "lang")


@query(f"SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY {NORMAL.format('text')} ORDER BY length(source) DESC, length(text) DESC, doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup_keep_best(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", X.normalize_text("text").alias("k"), F.length("source").alias("o"), F.length("text").alias("q"))
    return dedup.keep_one(docs, ["k"], [F.desc("o"), F.desc("q"), F.col("doc_id")]).select("doc_id", "n_chars")


REASON = "CASE WHEN source IN ('src1', 'src2') THEN 'short_answer' WHEN quality IS NULL THEN 'null_answer' WHEN n_chars < 300 THEN 'null_options' ELSE 'kept' END"


@query(f"SELECT {REASON} AS reason, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def drop_reason_counters(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    options = F.create_map(F.lit("A"), F.lit(" "), F.lit("B"), F.when(F.col("n_chars") >= 300, F.col("lang")))
    reason = F.coalesce(filters.drop_reason(F.col("source"), F.col("quality").cast("string"), options, ["src1", "src2"]), F.lit("kept"))
    return docs.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {NEAR}")
def embedding_near_pairs(spark, d):
    return similarity.near_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", NEAR).select("i", "j", F.round("sim", 6).alias("sim"))


@query(f"""WITH RECURSIVE p AS (SELECT i, j, row_number() OVER (ORDER BY sim DESC, i, j) AS r, sim, CASE WHEN wi > wj OR (wi = wj AND i < j) THEN j ELSE i END AS loser FROM (
SELECT a.vec_id AS i, b.vec_id AS j, a.label::BIGINT AS wi, b.label::BIGINT AS wj, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE sim >= {NEAR}),
g(r, gone, hit) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL SELECT p.r, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, loser) END, NOT (list_contains(gone, i) OR list_contains(gone, j)) FROM g JOIN p ON p.r = g.r + 1)
SELECT CASE WHEN loser = i THEN j ELSE i END AS kept, loser AS removed, round(sim, 6) AS similarity FROM g JOIN p USING (r) WHERE hit""")
def embedding_greedy_dedup(spark, d):
    return dedup.greedy_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", "label", NEAR).withColumn("similarity", F.round("similarity", 6))


FUZZY = 50.0
#: Token-set ratios of all pairs of benchmark items: the longest common subsequence column by column of a table with a row for each place of x.
TOKEN_SETS = f"""w AS (SELECT item_id, list_sort(list_distinct(list_filter(string_split({NORMAL.format("text")}, ' '), lambda x: x <> ''))) AS ws, length({NORMAL.format("text")}) AS size FROM benchmark),
p AS (SELECT a.item_id AS i, b.item_id AS j, a.size AS wi, b.size AS wj, list_filter(a.ws, lambda x: list_contains(b.ws, x)) AS c, list_filter(a.ws, lambda x: NOT list_contains(b.ws, x)) AS ra, list_filter(b.ws, lambda x: NOT list_contains(a.ws, x)) AS rb FROM w a JOIN w b ON a.item_id < b.item_id),
q AS (SELECT i, j, wi, wj, len(ra) AS na, len(rb) AS nb, array_to_string(c, ' ') AS z, array_to_string(list_concat(c, ra), ' ') AS x, array_to_string(list_concat(c, rb), ' ') AS y FROM p),
l(i, j, k, s, v) AS (SELECT i, j, unnest(range(0, length(x) + 1)), 0, 0 FROM q
  UNION ALL SELECT i, j, k, s + 1, max(CASE WHEN hit THEN coalesce(above, 0) + 1 ELSE v END) OVER (PARTITION BY i, j ORDER BY k) FROM (
    SELECT l.i, l.j, k, s, v, k > 0 AND substr(x, k, 1) = substr(y, s + 1, 1) AS hit, lag(v) OVER (PARTITION BY l.i, l.j ORDER BY k) AS above FROM l JOIN q ON l.i = q.i AND l.j = q.j WHERE s < length(y))),
ts AS (SELECT q.i, q.j, wi, wj, CASE WHEN z <> '' AND (na = 0 OR nb = 0) THEN 100.0 ELSE greatest(200.0 * v / (length(x) + length(y)), CASE WHEN z <> '' THEN 200.0 * length(z) / (length(z) + least(length(x), length(y))) ELSE 0.0 END) END AS sim
  FROM q JOIN l ON l.i = q.i AND l.j = q.j AND k = length(x) AND s = length(y) WHERE length(x) > 0 AND length(y) > 0)"""


@query(f"WITH RECURSIVE {TOKEN_SETS} SELECT i, j, round(sim, 6) AS sim FROM ts WHERE sim >= {FUZZY}")
def fuzzy_pairs(spark, d):
    return dedup.fuzzy_pairs(table(spark, d, "benchmark").select("item_id", X.normalize_text("text").alias("t")), "item_id", "t", FUZZY).withColumn("sim", F.round("sim", 6))


@query(f"""WITH RECURSIVE {TOKEN_SETS}, e AS (SELECT *, row_number() OVER (ORDER BY i, j) AS r, CASE WHEN wi >= wj THEN j ELSE i END AS loser FROM ts WHERE sim >= {FUZZY}),
g(r, gone, hit) AS (SELECT 0::BIGINT, []::BIGINT[], false UNION ALL SELECT e.r, CASE WHEN list_contains(gone, i) OR list_contains(gone, j) THEN gone ELSE list_append(gone, loser) END, NOT (list_contains(gone, i) OR list_contains(gone, j)) FROM g JOIN e ON e.r = g.r + 1)
SELECT CASE WHEN loser = i THEN j ELSE i END AS kept, loser AS removed, NULL::DOUBLE AS similarity FROM g JOIN e USING (r) WHERE hit""")
def fuzzy_greedy_dedup(spark, d):
    items = table(spark, d, "benchmark").select("item_id", X.normalize_text("text").alias("t"))
    pairs = dedup.fuzzy_pairs(items, "item_id", "t", FUZZY)
    return dedup.greedy(pairs, items.select(F.col("item_id").alias("id"), F.length("t").cast("long").alias("weight")), by_similarity=False)


@query()
def leader_clusters(spark, d):
    items = table(spark, d, "benchmark")
    q = X.normalize_text("text")
    some = items.select(F.col("item_id").alias("pos"), F.col("item_id").cast("string").alias("id"), F.element_at(F.split(q, " "), -1).alias("answer_key"), q.alias("question_blob"), q.alias("options_blob"), F.array().cast("array<string>").alias("image_ids"), F.length("text").alias("size"))
    return dedup.leader_clusters(some, 50.0)


@query(f"""SELECT i, j, round(sim, 6) AS sim, CASE WHEN (same AND sim >= 0.45) OR sim >= 0.48 THEN 'trusted' ELSE 'verify' END AS decision FROM (
SELECT a.vec_id AS i, b.vec_id AS j, a.label = b.label AS same, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE sim >= {NEAR}""")
def verification_split(spark, d):
    pairs = similarity.near_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", NEAR, beside="label")
    return dedup.verification_split(pairs, F.col("ei") == F.col("ej"), F.col("sim"), F.lit(True), trusted=0.48, same=0.45).select("i", "j", F.round("sim", 6).alias("sim"), "decision")


@query("SELECT doc_id, quality FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, quality FROM labels WHERE quality = 0 AND toxic = 1")
def verdict_recovery(spark, d):
    rows = table(spark, d, "labels")
    verdicts = rows.select("doc_id", F.when(F.col("toxic") == 1, "DIFFERENT").otherwise("DUPLICATE").alias("verdict"))
    return dedup.recovered(rows.where("quality = 0"), verdicts, rows.where("quality = 1").select("doc_id", "quality"), "doc_id")


@query(f"""SELECT i, j, round(sim, 6) AS sim, list, row_number() OVER (PARTITION BY list ORDER BY round(sim, 6) DESC, i, j) AS place FROM (
SELECT a.vec_id AS i, b.vec_id AS j, CASE WHEN a.label = b.label THEN 'removed' ELSE 'recovered' END AS list, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE sim >= {NEAR}""")
def verdict_lists(spark, d):
    """Near pairs as a judge of labels would part them, each list by falling similarity."""
    pairs = similarity.near_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", NEAR, beside="label").withColumn("sim", F.round("sim", 6))
    told = pairs.select("i", "j", "sim", F.coalesce(F.col("ei") == F.col("ej"), F.lit(False)).alias("same"))
    return dedup.verdict_lists(told, F.when(F.col("same"), "DUPLICATE").otherwise("DIFFERENT")).select("i", "j", "sim", "list", "place")
