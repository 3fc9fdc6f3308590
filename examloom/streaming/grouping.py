"""Groups of a bounded size on a stream, and batch jobs that go on where they stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Keyed state with timers is kept by this provider.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Groups(StatefulProcessor):
    """Rows of a key wait until there are enough of them, or the first has waited long enough."""

    def __init__(self, size: int, wait_ms: int | None, shape: str) -> None:
        self.size, self.wait_ms, self.shape = size, wait_ms, shape

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.shape)
        self.made = handle.getValueState("made", "n long")

    def _told(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        n = (self.made.get() or (0,))[0] if self.made.exists() else 0
        self.made.update((n + 1,))
        return pd.DataFrame({"key": [key[0]], "number": [n], "size": [len(rows)], "values": [[r[0] for r in rows]]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [tuple(x) for x in self.waiting.get()] if self.waiting.exists() else []
        before = bool(waiting)
        for part in rows:
            waiting += [(v,) for v in part["value"].tolist()]
            while len(waiting) >= self.size:
                some, waiting = waiting[: self.size], waiting[self.size :]
                before = False
                yield self._told(key, some)
        if self.wait_ms is not None and not before:  # whoever waits now has come with this batch
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            if waiting:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        if waiting:
            self.waiting.put(waiting)
        else:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            waiting = [tuple(x) for x in self.waiting.get()]
            self.waiting.clear()
            if waiting:
                yield self._told(key, waiting)

    def close(self) -> None:
        pass


def grouped_stream(rows: DataFrame, key: str, value: str, size: int = 50, wait_ms: int | None = 10_000) -> DataFrame:
    """On a stream, groups of `size` values of a key in the order they come: (key, number, size, values).

    A smaller group is given out once its first row has waited `wait_ms`; without
    that it waits for more rows, and a query that takes what is available ends (a
    query with timers runs until it is stopped).  The
    rows that wait are keyed state: a query that is started again with its
    checkpoint gives out the groups it would have given without the stop.
    """
    kinds = dict(rows.dtypes)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    some = rows.select(F.col(key).alias("key"), F.col(value).alias("value"))
    shape = f"value {kinds[value]}"
    return some.groupBy("key").transformWithStateInPandas(_Groups(size, wait_ms, shape), f"key {kinds[key]}, number long, size int, values array<{kinds[value]}>", "Append", "none" if wait_ms is None else "processingTime")


#: Batches of a job in steps: a batch costs the driver about half a second, whatever is in it.
BATCHES = 100


def resumable(work: DataFrame, folder: str, step: Callable[[DataFrame], DataFrame], order: str, size: int = 10, at_once: int | None = None) -> DataFrame:
    """step over all of the work, with a checkpoint after every `at_once` files of `size` rows; all results in input order.

    Without at_once it is one file, or as many as make BATCHES checkpoints where
    there are more files than that; a stop loses one batch at most, that is, one
    file or a hundredth of the work.

    The work is laid out once in files of that size; one streaming query goes
    through them and keeps its place in its checkpoint.  A batch overwrites the
    results under its own number, so one that is repeated after a failure counts
    once.  Called again, with the same folder, it goes on where it stopped, and
    does nothing when all is done; rows that came into the work since the files
    were laid out take no part.
    """
    from examloom.operators.indexing import exists

    spark = work.sparkSession
    laid = f"{folder}/work"
    if not exists(spark, f"{laid}/_SUCCESS"):
        spread = work.repartitionByRange(F.col(order)).sortWithinPartitions(order)
        spread.write.mode("overwrite").option("maxRecordsPerFile", size).parquet(laid)

    def one(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")

    if at_once is None:
        at_once = max(1, -(-len(spark.read.schema(work.schema).parquet(laid).inputFiles()) // BATCHES))
    stream = spark.readStream.schema(work.schema).option("maxFilesPerTrigger", at_once).parquet(laid)
    stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    if not exists(spark, f"{folder}/results"):
        return step(work.limit(0))
    return spark.read.parquet(f"{folder}/results").drop("batch").orderBy(order)


def progress_of(spark: SparkSession, folder: str) -> tuple[int, int]:
    """How many of the rows laid out have results, and how many there are."""
    from examloom.operators.indexing import exists

    done = spark.read.parquet(f"{folder}/results").count() if exists(spark, f"{folder}/results") else 0
    return done, spark.read.parquet(f"{folder}/work").count() if exists(spark, f"{folder}/work") else 0
