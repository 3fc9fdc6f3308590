"""Queries of chunking, retrieval and the index."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.operators import chunking, indexing, retrieval, similarity
from examloom.plans.base import query, table
from examloom.plans.text import SPACE


@query(r"SELECT doc_id, 0 AS chunk, text, 0 AS start_index, length(text)::INT AS end_index, len(regexp_split_to_array(text, '\s+'))::INT AS token_count FROM documents")
def chunk_whole(spark, d):
    return chunking.chunk(table(spark, d, "documents"), "whole")


@query(rf"""WITH RECURSIVE h AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text <> ''),
b AS (SELECT doc_id, list(s ORDER BY i) AS c FROM (SELECT doc_id, i, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM h) GROUP BY 1),
t AS (SELECT doc_id, text, length(text) AS n, c FROM documents JOIN b USING (doc_id)),
r(doc_id, k, a, z) AS (SELECT doc_id, -1, 0::BIGINT, 0::BIGINT FROM t UNION ALL
SELECT doc_id, k + 1, z, CASE WHEN m < n AND length(regexp_extract(text[z + 1:m], '(?s)^.*[
.?]')) > 0 THEN z + length(regexp_extract(text[z + 1:m], '(?s)^.*[
.?]')) ELSE m END
FROM (SELECT r.doc_id, k, z, n, text, greatest(z + 1, z + len(list_filter(c[z + 1:z + 1024], lambda x: x - CASE WHEN z = 0 THEN 0 ELSE c[z] END <= 1024))) AS m FROM r JOIN t USING (doc_id) WHERE z < n))
SELECT doc_id, k::INT AS chunk, text[a + 1:z] AS text, a::INT AS start_index, z::INT AS end_index, len(regexp_extract_all(text[a + 1:z], '{SPACE.replace('[', '[^', 1)}'))::INT AS token_count FROM r JOIN t USING (doc_id) WHERE k >= 0""")
def chunk_delimited(spark, d):
    return chunking.chunk(table(spark, d, "documents"), "fast", chunk_size=1024)


@query()
def chunk_recursive(spark, d):
    return chunking.chunk(table(spark, d, "documents"), "recursive", chunk_size=128)


@query()
def chunk_semantic(spark, d):
    return chunking.chunk(table(spark, d, "documents"), "semantic", threshold=0.3, chunk_size=256)


BM25 = r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), len AS (SELECT doc_id, sum(tf)::DOUBLE AS length FROM tf GROUP BY 1),
st AS (SELECT count(*)::DOUBLE AS n, avg(length) AS m FROM len), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark),
s AS (SELECT item_id, tf.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len ON len.doc_id = tf.doc_id, st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


@query(BM25 + " SELECT item_id, doc_id, score, rank::INT AS rank FROM bm WHERE rank <= 5")
def bm25_topk(spark, d):
    return retrieval.bm25_topk(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "doc_id", "text", "text", 5)


DENSE = """WITH s AS (SELECT q.vec_id AS q_id, c.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0),
de AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 12) DESC, vec_id) AS rank FROM s)"""


def _dense(spark, d, k):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qv"))
    return similarity.nearest(q, v, "q_id", "vec_id", "qv", "embedding", k)


@query(DENSE + " SELECT q_id, vec_id, round(score, 6) AS score, rank::INT AS rank FROM de WHERE rank <= 10")
def dense_topk(spark, d):
    return _dense(spark, d, 10).withColumn("score", F.round("score", 6))


@query(DENSE + """, r2 AS (SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY abs(vec_id - q_id), vec_id) AS rank FROM s),
u AS (SELECT q_id, vec_id, 1.0::DOUBLE / (60 + rank) AS p FROM de WHERE rank <= 20 UNION ALL SELECT q_id, vec_id, 1.0::DOUBLE / (60 + rank) FROM r2 WHERE rank <= 20),
f AS (SELECT q_id, vec_id, round(sum(p), 9) AS score FROM u GROUP BY ALL)
SELECT * FROM (SELECT q_id, vec_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id)::INT AS rank FROM f) WHERE rank <= 10""")
def rrf_fusion(spark, d):
    from pyspark.sql import Window

    v = table(spark, d, "embeddings").select("vec_id")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q_id"))
    # Ids at most 40 apart lie in the same bucket of 41 or in neighbouring ones, so that keys can be joined.
    buckets = q.select("q_id", F.explode(F.array(*(F.floor(F.col("q_id") / 41) + i for i in (-1, 0, 1)))).alias("bucket"))
    near = v.withColumn("bucket", F.floor(F.col("vec_id") / 41)).join(buckets, "bucket").where(F.abs(F.col("vec_id") - F.col("q_id")) <= 40).drop("bucket")
    other = near.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy(F.abs(F.col("vec_id") - F.col("q_id")), "vec_id"))).where("rank <= 20")
    return retrieval.rrf([_dense(spark, d, 20), other], "q_id", "vec_id", 10)


@query("""WITH g AS (SELECT vec_id // 5 AS g, list(embedding::DOUBLE[] ORDER BY vec_id) AS late FROM embeddings GROUP BY 1),
s AS (SELECT q.g AS q_id, c.g AS c_id, round(list_sum(list_transform(q.late, lambda a: list_max(list_transform(c.late, lambda b: list_dot_product(a, b))))), 6) AS score FROM g q JOIN g c ON q.g % 20 = 0)
SELECT * FROM (SELECT q_id, c_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, c_id)::INT AS rank FROM s) WHERE rank <= 5""")
def maxsim_rerank(spark, d):
    """The best of all groups for every twentieth one (ids divisible by 100)."""
    groups = table(spark, d, "embeddings").groupBy((F.floor(F.col("vec_id") / 5)).alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("late"))
    q, c = groups.where("g % 20 = 0").withColumnRenamed("g", "q_id"), groups.withColumnRenamed("g", "c_id")
    return similarity.nearest_late(q, c, "q_id", "c_id", "late", "late", 5)


@query("""SELECT source, sum(length(text))::BIGINT AS chars, count(*) AS n FROM (SELECT source, CASE WHEN source = 'src1' THEN text || '+' ELSE text END AS text FROM documents) GROUP BY 1""")
def index_overwrite_by_source(spark, d):
    """The documents indexed, then one source indexed anew: others stay as they were."""
    from uuid import uuid4

    from examloom.storage import folder

    path = f"{folder(spark)}/index-{uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    indexing.overwrite_sources(docs, path)
    indexing.overwrite_sources(docs.where("source = 'src1'").withColumn("text", F.concat("text", F.lit("+"))), path)
    return spark.read.parquet(path).groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))


@query("SELECT source, md5(source) AS file_key FROM (SELECT DISTINCT source FROM documents) WHERE source NOT IN ('src1', 'src2')")
def index_skip_existing(spark, d):
    files = table(spark, d, "documents").select("source").distinct()
    return indexing.not_indexed(files, files.where("source IN ('src1', 'src2')").select(F.md5("source").alias("file_key")))


@query("SELECT count(*) AS without_key, (SELECT list(s ORDER BY s) FROM (SELECT vec_id::VARCHAR AS s FROM embeddings ORDER BY s LIMIT 25)) AS keyless, count(*) AS points, count(*) FILTER (vec_id % 3 <> 0) AS dense_reuse, count(*) FILTER (vec_id % 3 = 0) AS dense_recompute FROM embeddings")
def migrate_vector_reuse(spark, d):
    points = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("source"), F.lit(0).alias("start_index"), F.lit(1).alias("end_index"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("chunk_key"), F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("dense"))
    return indexing.migration_report(indexing.migrated(points, {"dense": 64}, "fast"), ["dense"])
