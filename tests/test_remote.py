"""Scrolled and written stores, groups on a stream, jobs that go on where they stopped."""

import json
import os
import warnings

import pytest
from pyspark.sql import functions as F

from examloom.sources import remote
from examloom.streaming import grouping


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "points")
    spark.range(100, 1100).selectExpr("id", "id % 7 AS kind", "concat('p', id) AS name").repartition(3).write.parquet(path)
    return path


def test_scrolled_scan_with_pushed_filters(spark, table):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(remote.scrolled_source("points_test", "id", lambda o: remote.ParquetStore(o["path"], "id")))
    read = spark.read.format("points_test").option("path", table).option("size", 50).option("ranges", 5).load()
    assert read.count() == 1000 and sorted(r.id for r in read.collect()) == list(range(100, 1100))
    some = read.where("id > 300 AND id <= 420 AND kind = 3")
    assert sorted(r.id for r in some.collect()) == [i for i in range(301, 421) if i % 7 == 3]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(kind" in plan.replace(" ", "") or "kind" in plan
    # Filters on the key narrow the ranges; what the store can't compare stays in Spark.
    reader = remote._ScrollReader(remote.ParquetStore(table, "id"), "id", 4, 10, ())
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNull

    assert list(reader.pushFilters([GreaterThan(("id",), 1000), EqualTo(("kind",), 1), IsNull(("name",))])) == [IsNull(("name",))]
    assert min(p.after for p in reader.partitions()) == 1000 and max(p.upto for p in reader.partitions()) == 1099
    got = [r[0] for p in reader.partitions() for r in reader.read(p)]
    assert got == [i for i in range(1001, 1100) if i % 7 == 1]


def test_scroll_retries_and_stops_at_a_null_row():
    class Flaky(remote.Store):
        def __init__(self):
            self.calls = 0

        def scroll(self, after, upto, size, where):
            self.calls += 1
            if self.calls == 2:
                raise ConnectionError("try again")
            return ([(after + 1,), None], after + 2) if after >= 4 else ([(after + 1,), (after + 2,)], after + 2)

    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        got = list(remote._Scroll(Flaky(), 2, [], (0.0,)).read(remote._Range(0, 100)))
    assert got == [(1,), (2,), (3,), (4,), (5,)] and "null row" in str(told[0].message)


def test_scrolled_stream_goes_on_where_it_stopped(spark, table, tmp_path):
    spark.dataSource.register(remote.scrolled_source("points_stream", "id", lambda o: remote.ParquetStore(o["path"], "id")))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def go():
        stream = spark.readStream.format("points_stream").option("path", table).option("size", 200).load()
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()

    go()
    assert spark.read.parquet(out).count() == 1000
    spark.range(1100, 1150).selectExpr("id", "id % 7 AS kind", "concat('p', id) AS name").write.mode("append").parquet(table)
    go()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(100, 1150))


def test_points_are_written_once_in_bounded_requests(spark, tmp_path):
    folder = str(tmp_path / "sink")

    def failing(options):
        class Sink(remote.FolderSink):
            def stage(self, token, number, body):
                mark = f"{self.folder}-failed"
                if not os.path.exists(mark):  # the first request of all fails once
                    open(mark, "w").close()
                    raise ConnectionError("try again")
                super().stage(token, number, body)

        return Sink(options["folder"])

    spark.dataSource.register(remote.point_sink("sink_test", failing, (0.0,)))
    df = spark.range(500).selectExpr("id", "concat('name ', id) AS name", "array(id, 2) AS v").repartition(3)
    df.write.format("sink_test").option("folder", folder).option("budget", 1000).mode("append").save()
    files = [os.path.join(d, f) for d, _, fs in os.walk(f"{folder}/points") for f in fs]
    assert all(os.path.getsize(f) <= 1000 for f in files) and len(files) > 20
    rows = [json.loads(line) for f in files for line in open(f)]
    assert sorted(r["id"] for r in rows) == list(range(500)) and rows[0]["v"][1] == 2
    assert not os.listdir(f"{folder}/staged")


def test_failed_write_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "sink")
    spark.dataSource.register(remote.point_sink("sink_broken", lambda o: remote.FolderSink(o["folder"]), ()))
    df = spark.range(50).selectExpr("id", "if(id = 37, repeat('x', 2000), 'x') AS name").repartition(4)
    with pytest.raises(Exception, match="exceeds the budget"):
        df.write.format("sink_broken").option("folder", folder).option("budget", 1000).mode("append").save()
    assert not os.path.exists(f"{folder}/points") and not os.listdir(f"{folder}/staged")
    with pytest.raises(ValueError):
        list(remote.requests(iter([{"a": "x" * 50}]), 20))


def test_groups_on_a_stream_with_a_restart(spark, tmp_path):
    src, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def feed(lo, hi):
        spark.range(lo, hi, 1, 1).selectExpr("id % 2 AS k", "id AS v").coalesce(1).write.mode("append").parquet(src)

    def go(wait):
        stream = spark.readStream.schema("k long, v long").parquet(src)
        got = grouping.grouped_stream(stream, "k", "v", size=5, wait_ms=wait)
        got.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()

    feed(0, 14)  # seven values a key: one group each, two wait
    go(None)
    assert sorted((r.key, r.number, r.size) for r in spark.read.parquet(out).collect()) == [(0, 0, 5), (1, 0, 5)]
    feed(14, 20)  # three more a key, after a restart: the waiting two and these are a group
    go(None)
    rows = sorted((r.key, r.number, sorted(r["values"])) for r in spark.read.parquet(out).collect())
    assert [r[:2] for r in rows] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert sorted(v for r in rows for v in r[2]) == list(range(20))


def test_groups_that_have_waited_long_enough(spark, tmp_path):
    src, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    spark.range(3).selectExpr("'a' AS k", "id AS v").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("k string, v long").parquet(src)
    q = grouping.grouped_stream(stream, "k", "v", size=50, wait_ms=500).writeStream.format("memory").queryName("waited").option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(40):
            q.awaitTermination(1)
            if spark.table("waited").count():
                break
        assert [(r.key, r.size, sorted(r["values"])) for r in spark.table("waited").collect()] == [("a", 3, [0, 1, 2])]
    finally:
        q.stop()


def test_job_goes_on_where_it_stopped(spark, tmp_path):
    folder = str(tmp_path / "job")
    mark = str(tmp_path / "fail")
    open(mark, "w").close()
    work = spark.range(95).select("id", (F.col("id") * 2).alias("x"))
    done = []

    def step(batch):
        done.append(batch.count())
        if os.path.exists(mark) and len(done) == 4:
            os.remove(mark)
            raise RuntimeError("killed")
        return batch.withColumn("y", F.col("x") + 1)

    with pytest.raises(Exception, match="killed"):
        grouping.resumable(work, folder, step, "id", 10)
    n, of = grouping.progress_of(spark, folder)
    assert 0 < n < of == 95
    out = grouping.resumable(work, folder, step, "id", 10)
    assert [(r.id, r.y) for r in out.collect()] == [(i, 2 * i + 1) for i in range(95)]
    before = len(done)
    assert grouping.resumable(work, folder, step, "id", 10).count() == 95 and len(done) == before
    assert max(done) <= 10 and sum(done) < 95 + 11


def test_job_of_many_files_takes_a_bounded_number_of_batches(spark, tmp_path):
    work, sizes = spark.range(1050).select("id"), []

    def step(batch):
        sizes.append(batch.count())
        return batch.withColumn("y", F.col("id") + 1)

    out = grouping.resumable(work, str(tmp_path / "job"), step, "id", 3)
    assert [(r.id, r.y) for r in out.collect()] == [(i, i + 1) for i in range(1050)]
    assert sum(sizes) == 1050 and len(sizes) <= grouping.BATCHES
