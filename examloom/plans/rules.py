"""Queries of rules over single rows, and of filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.functions import text as X
from examloom.operators import dedup, filters, packing, retrieval
from examloom.plans.base import query, table


def _mod(column, n, *values):
    """Values in turn by column modulo n."""
    out = None
    for i, v in enumerate(values):
        c = F.col(column) % n == i
        out = F.when(c, v) if out is None else out.when(c, v)
    return out


def _case(column, n, *values):
    return "CASE " + f"{column} % {n} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


@query("SELECT doc_id, 'Question: ' || text || chr(10) || 'A. ' || source || chr(10) || 'B. ' || lang || chr(10) || 'Answer: A' AS prompt FROM documents")
def prompt_format(spark, d):
    options = F.create_map(F.lit("B"), F.col("lang"), F.lit("A"), F.col("source"))
    return table(spark, d, "documents").select("doc_id", X.prompt_text("text", options, F.lit("A")).alias("prompt"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['http://h/' || source || '.png'] WHEN 1 THEN [] ELSE ['x.png'] END AS sources, doc_id % 3 <> 2 AS valid, 'See ' || lang AS plain FROM documents")
def image_extraction(spark, d):
    k = F.col("doc_id") % 3
    tag = F.when(k == 0, F.concat(F.lit('<img src="http://h/'), "source", F.lit('.png">'))).when(k == 1, "<img src=null>").otherwise("<IMG width=1 src='x.png'/>")
    html = F.concat(F.lit("See "), "lang", tag, F.lit(" <br/>"))
    return table(spark, d, "documents").select("doc_id", X.image_sources(html).alias("sources"), X.images_valid(html).alias("valid"), X.without_images(html).alias("plain"))


@query("SELECT doc_id, CASE WHEN n_chars >= 2000 THEN 1 WHEN lang IN ('de', 'es') THEN 2 ELSE 0 END::BIGINT AS n_options, CASE WHEN lang IN ('de', 'es') THEN 'true_false' WHEN lang = 'fr' THEN 'single_choice' ELSE lang END AS type FROM documents")
def true_false_defaults(spark, d):
    kind = F.when(F.col("lang").isin("de", "es"), "判断题").when(F.col("lang") == "fr", "单选题").otherwise(F.col("lang"))
    options = X.default_options(kind, F.when(F.col("n_chars") >= 2000, F.create_map(F.lit("A"), F.col("source"))).otherwise(F.create_map().cast("map<string,string>")))
    return table(spark, d, "documents").select("doc_id", F.size(options).cast("long").alias("n_options"), X.type_name(kind).alias("type"))


SCOPED = "CASE lang WHEN 'en' THEN 'Inland only: ' WHEN 'de' THEN 'INTERNATIONAL ONLY ' WHEN 'fr' THEN 'US INLAND, INLAND and international D' || lpad((n_chars % 1000)::VARCHAR, 3, '0') || 'sa ' ELSE '' END || regexp_replace(text, '[^A-Za-z ]', ' ', 'g')"


@query(rf"""WITH t AS (SELECT doc_id, {SCOPED} AS t FROM documents)
SELECT doc_id, CASE WHEN contains(upper(t), 'INLAND ONLY') THEN 'inland' WHEN contains(upper(t), 'INTERNATIONAL ONLY') THEN 'international' WHEN contains(upper(t), 'INTERNATIONAL') AND contains(upper(t), 'INLAND') THEN 'both' ELSE 'unknown' END AS scope,
replace(regexp_replace(regexp_replace(t, '\bUS INLAND\b', chr(1), 'g'), '\bINLAND\b', 'US INLAND', 'g'), chr(1), 'US INLAND') AS clear, list_distinct(regexp_extract_all(upper(t), '\b(D\d{{3}}[A-Z]*)\b', 1)) AS figures FROM t""")
def scope_and_figures(spark, d):
    head = F.when(F.col("lang") == "en", "Inland only: ").when(F.col("lang") == "de", "INTERNATIONAL ONLY ").when(F.col("lang") == "fr", F.concat(F.lit("US INLAND, INLAND and international D"), F.lpad((F.col("n_chars") % 1000).cast("string"), 3, "0"), F.lit("sa "))).otherwise("")
    t = F.concat(head, F.regexp_replace("text", "[^A-Za-z ]", " "))
    return table(spark, d, "documents").select("doc_id", X.scope_category(t).alias("scope"), X.clarify_inland(t).alias("clear"), X.distinct_matches(t, r"\b(D\d{3}[A-Z]*)\b").alias("figures"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'plain' ELSE doc_id::VARCHAR END AS trace FROM documents")
def trace_id_decode(spark, d):
    one = F.base64(F.concat(F.lit("Trace:"), F.col("doc_id").cast("string")).cast("binary"))
    two = F.base64(F.concat(F.lit("Trace:"), one).cast("binary"))
    k = F.col("doc_id") % 3
    return table(spark, d, "documents").select("doc_id", X.trace_id(F.when(k == 0, one).when(k == 1, two).otherwise("plain")).alias("trace"))


@query("SELECT doc_id, CASE WHEN length(x) < 4 THEN lpad(x, 4, '0') ELSE x END AS number FROM (SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(source || '.' || n_chars, '[^0-9]', '', 'g'), '^0+', ''), ''), (doc_id + 1)::VARCHAR) AS x FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN source ELSE 'src' END AS source, CASE WHEN lang = 'de' THEN n_chars::VARCHAR ELSE '' END AS n_chars FROM documents))")
def question_number_pad(spark, d):
    raw = F.concat(F.when(F.col("lang") == "en", F.col("source")).otherwise("src"), F.lit("."), F.when(F.col("lang") == "de", F.col("n_chars").cast("string")).otherwise(""))
    return table(spark, d, "documents").select("doc_id", X.question_number(raw, F.col("doc_id") + 1).alias("number"))


@query(f"SELECT doc_id, {_case('doc_id', 5, 'DUPLICATE', 'DIFFERENT', 'DUPLICATE', 'DIFFERENT', None)} AS verdict, {_case('doc_id', 5, 'GOOD', 'BAD', 'GOOD', 'BAD', None)} AS quality FROM documents")
def verdict_parse(spark, d):
    v = _mod("doc_id", 5, "DUPLICATE: same", "thinking...\nDIFFERENT", "duplicate or different\nboth duplicate, so duplicate and different?", "different / duplicate / different", "unclear")
    q = _mod("doc_id", 5, "GOOD", " bad, unclear", "it is good", "rather BAD", "?")
    return table(spark, d, "documents").select("doc_id", X.duplicate_verdict(v).alias("verdict"), X.quality_verdict(q).alias("quality"))


@query("SELECT doc_id, 'm' || (doc_id % 6)::VARCHAR || CASE WHEN doc_id % 2 = 0 THEN ' (RAG, k=5, collection=' || source || ')' ELSE '' END AS label FROM documents WHERE doc_id % 6 <> 3 AND NOT contains(lower(source), 'src1')")
def experiment_filter_label(spark, d):
    meta = F.concat(F.lit('{"model":{"id":"m'), (F.col("doc_id") % 6).cast("string"), F.lit('"}'), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(',"retrieval":{"limit":5,"collection":"'), "source", F.lit('"}'))).otherwise(""), F.lit("}"))
    rows = table(spark, d, "documents").select("doc_id", "source", meta.alias("meta")).withColumn("label", X.group_label("meta")).withColumn("model", F.get_json_object("meta", "$.model.id"))
    return filters.usable_experiments(rows, "model", "meta", "source", exclude_models=["m3"], exclude_words=["SRC1"]).select("doc_id", "label")


@query(r"SELECT CASE WHEN length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) < 5 THEN 'short_question' WHEN n_chars < 500 THEN 'few_options' WHEN quality IS NULL THEN 'no_answer' WHEN quality = 0 THEN 'unknown_answer' ELSE 'valid' END AS reason, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def question_validation(spark, d):
    """Documents as questions: short ones have one option, and a label is the answer."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    two = F.create_map(F.lit("0"), F.col("source"), F.lit("1"), F.col("lang"))
    options = F.when(F.col("n_chars") < 500, F.create_map(F.lit("1"), F.col("lang"))).otherwise(two)
    answer = F.when(F.col("quality") == 0, "Z").otherwise(F.col("quality").cast("string"))
    return docs.groupBy(F.coalesce(filters.question_problem(F.col("text"), options, answer), F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 1 OR o_orderstatus = 'P'")
def remap_changed(spark, d):
    orders = table(spark, d, "orders")
    new_price = F.when(F.col("o_orderkey") % 4 == 1, F.lit(None)).otherwise(F.col("o_totalprice"))
    new_status = F.when(F.col("o_orderstatus") == "P", "X").otherwise(F.col("o_orderstatus"))
    return orders.where(filters.changed([F.col("o_totalprice"), F.col("o_orderstatus")], [new_price, new_status])).select("o_orderkey")


@query("SELECT l_orderkey FROM (SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_returnflag)) FILTER (l_linestatus = 'F') AS label FROM lineitem GROUP BY 1) WHERE label = 'R'")
def repair_target_filter(spark, d):
    notes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_linestatus", "l_returnflag"))), lambda x: F.struct(x["l_linestatus"].alias("name"), x["l_returnflag"].alias("label"), F.lit("why").alias("explanation")))
    runs = table(spark, d, "lineitem").groupBy("l_orderkey").agg(notes.alias("notes"))
    return filters.repair_targets(runs, "notes", "F", "R", "why").select("l_orderkey")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders GROUP BY 1")
def best_candidate_per_key(spark, d):
    return dedup.keep_one(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("best"))


@query("""WITH t AS (SELECT doc_id, source, sha256(text) AS s FROM documents), f AS (SELECT *, min(doc_id) OVER (PARTITION BY source, s) AS f FROM t)
SELECT doc_id, source, dense_rank() OVER (PARTITION BY source ORDER BY f)::INT AS index FROM f""")
def content_dedup_names(spark, d):
    return filters.content_names(table(spark, d, "documents").select("doc_id", "source", "text"), "source", F.col("text"), [F.col("doc_id")]).select("doc_id", "source", "index")


@query("SELECT c.conv_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS images FROM (SELECT conv_id, list(CASE WHEN role = 'user' THEN 'u.png' ELSE 'o.png' END ORDER BY turn) AS l FROM conversations GROUP BY 1) c")
def image_names_ordered(spark, d):
    q = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.when(x["role"] == "user", "u").otherwise("o")).alias("ids"))
    images = spark.createDataFrame([("u", "u.png"), ("o", "o.png")], "image string, name string")
    return filters.images_of(q, "conv_id", "ids", images, "image", "name")


@query("SELECT conv_id, string_agg('[' || (turn + 1)::VARCHAR || '] ' || text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY 1")
def context_numbering(spark, d):
    return retrieval.numbered_context(table(spark, d, "conversations").withColumn("rank", (F.col("turn") + 1).cast("int")), "conv_id", "text")


@query("SELECT o_orderpriority AS model, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE round(avg(o_totalprice), 4) END AS mean FROM orders GROUP BY 1 ORDER BY coalesce(mean, -1) DESC, model")
def model_ordering(spark, d):
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.avg("o_totalprice"), 4).alias("m"))
    out = m.select("model", F.when(F.col("model") != "5-LOW", F.col("m")).alias("mean"))
    return out.orderBy(F.coalesce("mean", F.lit(-1.0)).desc(), "model")


@query("SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25")
def capped_groups(spark, d):
    return packing.capped(table(spark, d, "documents").select("doc_id", "source"), [F.col("source"), F.col("doc_id")], 25)


@query("SELECT doc_id, sum(CASE WHEN text IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing, length(concat(text, coalesce(CASE WHEN doc_id % 2 = 0 THEN source END, '')))::BIGINT AS n FROM documents GROUP BY doc_id, text, source")
def embed_input_lengths(spark, d):
    from examloom.operators.indexing import embed_input

    docs = table(spark, d, "documents")
    n = F.length(embed_input(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("source"))))
    return docs.select("doc_id", F.col("text").isNull().cast("long").alias("missing"), n.cast("long").alias("n"))


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents), h AS (SELECT doc_id, md5(w) AS h FROM w),
d AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, ('0x' || h[1:2])::INT % 64 AS slot, sum(CASE WHEN ('0x' || h[3:4])::INT % 2 = 1 THEN 1 ELSE -1 END) AS v FROM h GROUP BY ALL) WHERE v <> 0 GROUP BY 1),
s AS (SELECT doc_id, count(DISTINCT i) AS n, min(i) AS least FROM (SELECT doc_id, ('0x' || h[1:8])::BIGINT & 2147483647 AS i FROM h) GROUP BY 1)
SELECT doc_id, coalesce(d.n, 0)::INT AS dense_used, coalesce(s.n, 0)::INT AS n_terms, s.least::INT AS least_term FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN s USING (doc_id)""")
def embed_dense_and_sparse(spark, d):
    from examloom import hooks
    from examloom.session import small_batches

    small_batches(spark)
    v = table(spark, d, "documents").select("doc_id", hooks.dense()("text").alias("dense"), hooks.sparse("text").alias("sparse"))
    return v.select("doc_id", F.size(F.filter("dense", lambda x: x != 0)).alias("dense_used"), F.size("sparse.indices").alias("n_terms"), F.array_min("sparse.indices").alias("least_term"))
