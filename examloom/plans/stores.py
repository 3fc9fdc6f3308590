"""Queries of scrolled and written stores, of jobs in steps, and of table functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from examloom.operators import tables
from examloom.plans.base import ORACLE_SQL, query, table
from examloom.plans.harness import place
from examloom.plans.text import key_heads, key_page
from examloom.sources import remote
from examloom.streaming import grouping


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id >= 50 AND event_type = 'click' AND user_id % 2 = 1")
def scrolled_source(spark, d):
    """The events scrolled page by page from a store that takes the comparisons; what it can't compare is filtered after."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(remote.scrolled_source("examloom_scroll", "event_id", lambda o: remote.ParquetStore(o["path"], "event_id")))
    events = spark.read.format("examloom_scroll").option("path", f"{d}/events.parquet").option("size", 2000).load()
    return events.where("event_id >= 50 AND event_type = 'click' AND user_id % 2 = 1").select("event_id", "user_id", "event_type")


@query("SELECT doc_id, lang, source, n_chars FROM documents")
def points_written(spark, d):
    """Documents written to a store of points in requests of 4,000 bytes, and read back."""
    path = place(spark, "points")
    spark.dataSource.register(remote.point_sink("examloom_points", lambda o: remote.FolderSink(o["folder"])))
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    docs.write.format("examloom_points").option("folder", path).option("budget", 4000).mode("append").save()
    return spark.read.schema(docs.schema).option("recursiveFileLookup", "true").json(f"{path}/points")


@query("SELECT c_custkey, c_acctbal * 2 AS doubled FROM customer")
def job_in_steps(spark, d):
    """Customers worked through in files of 200, with a checkpoint after each file or hundredth of the work; results in input order."""
    work = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return grouping.resumable(work, place(spark, "job"), lambda batch: batch.select("c_custkey", (F.col("c_acctbal") * 2).alias("doubled")), "c_custkey", 200)


@query(ORACLE_SQL["chunk_delimited"])
def chunk_table_function(spark, d):
    """Chunks by a table function in SQL."""
    tables.register(spark)
    table(spark, d, "documents").createOrReplaceTempView("documents_to_chunk")
    return spark.sql("SELECT d.doc_id, c.* FROM documents_to_chunk d, LATERAL chunk(d.text, 'fast', 1024) c")


@query(ORACLE_SQL["key_format_parse"])
def questions_table_function(spark, d):
    """Questions by a table function in SQL, of the texts that key_format_parse makes."""
    tables.register(spark)
    table(spark, d, "documents").select("doc_id", key_page("text").alias("page")).createOrReplaceTempView("pages_to_parse")
    got = spark.sql("SELECT p.doc_id, q.* FROM pages_to_parse p, LATERAL questions(p.page, 'key') q")
    return key_heads(got.select("doc_id", "number", F.regexp_replace("question", r"\\(.)", "$1").alias("question"), *(F.element_at("options", k).alias(f"option_{k.lower()}") for k in "ABCD"), "answer", "explanation", "repairs"))
