"""Checkpoint and resume of long batch jobs over manifests and result tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from examloom.storage import stored


def mismatches(saved: dict | None, wanted: dict, required: tuple[str, ...], may_grow: tuple[str, ...] = (), may_differ: tuple[str, ...] = ()) -> list[str]:
    """Why a saved state can't be resumed; empty if it can.  A state without manifest passes."""
    if saved is None:
        return []
    out = []
    for k in required:
        if k not in saved:
            out.append(f"{k} is missing")
        elif k in may_grow:
            if saved[k] is None or (wanted.get(k) is not None and wanted[k] < saved[k]):
                out.append(f"{k}: {saved[k]} saved, {wanted.get(k)} wanted")
        elif k not in may_differ and saved[k] != wanted.get(k):
            out.append(f"{k}: {saved[k]} saved, {wanted.get(k)} wanted")
    return out


def latest_state(paths: list[str], prefix: str, suffix: str = ".json") -> str | None:
    """The newest file by the time in its name."""
    found = [p for p in paths if re.fullmatch(rf"(?:.*/)?{re.escape(prefix)}.*{re.escape(suffix)}", p)]
    return max(found, default=None, key=lambda p: p.rsplit("/", 1)[-1])


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def without_annotation(runs: DataFrame, annotations: DataFrame, run: str, names: list[str]) -> DataFrame:
    """The second phase's work: every finished run (no error) and evaluator that has no annotation yet."""
    every = runs.where("error IS NULL").select("*", F.explode(F.array(*map(F.lit, names))).alias("name"))
    return every.join(annotations.select(run, "name").distinct(), [run, "name"], "left_anti")


def evaluated_later(runs: DataFrame, annotations: DataFrame, run: str, evaluators: dict[str, Callable]) -> DataFrame:
    """Annotations of what an experiment-only phase left: run, name, score, label by each evaluator of (output, expected)."""
    work = without_annotation(runs, annotations, run, list(evaluators))
    result = None
    for name, evaluate in evaluators.items():
        case = F.when(F.col("name") == name, evaluate(F.col("output"), F.col("expected")))
        result = case if result is None else F.coalesce(result, case)
    return work.withColumn("r", result).select(run, "name", F.col("r.score").alias("score"), F.col("r.label").alias("label"))


def progress(entries: DataFrame, selected: int) -> DataFrame:
    return entries.agg(F.lit(selected).alias("selected"), F.count("*").alias("processed"), F.count_if(F.col("status") == "converted").alias("converted"), F.count_if(F.col("status") == "skipped").alias("skipped"))


def run_in_steps(work: DataFrame, path: str, keys: list[str], step: Callable[[DataFrame], DataFrame], order: str, size: int = 10) -> DataFrame:
    """Apply step to what is not yet in the result table, appending after every `size` rows; all results in input order."""
    spark = work.sparkSession
    from examloom.operators.indexing import exists
    from examloom.operators.packing import batches

    left = pending(work, spark.read.parquet(path), keys) if exists(spark, path) else work
    numbered = batches(left, [F.col(order)], size)
    top = numbered.agg(F.max("batch")).first()[0]
    for i in range(0 if top is None else int(top) + 1):
        step(numbered.where(F.col("batch") == i).drop("batch")).write.mode("append").parquet(path)
    return spark.read.parquet(path).orderBy(order)


def summarised(texts: DataFrame, text: str, order: str, budget: int, merge: Callable[[list[str]], str]) -> str:
    """One text of many by merging bins that fit the budget, again and again.  Each round's bins run in parallel."""
    import pandas as pd

    from examloom.operators.packing import pack

    level = texts.select(F.lit(0).alias("k"), F.col(order).cast("long").alias("p"), F.col(text).alias("t"))
    while True:
        binned = pack(level.withColumn("c", F.length("t")), "k", "p", "c", budget)

        def join(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("p")
            return pd.DataFrame({"k": [0], "p": [part["bin"].iloc[0]], "t": [merge(part["t"].tolist())]})

        level = binned.groupBy("bin").applyInPandas(join, "k int, p long, t string")
        rows = level.orderBy("p").limit(2).collect()
        if len(rows) <= 1:
            return rows[0].t if rows else ""
        level = stored(level, "summary")
