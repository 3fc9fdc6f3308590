"""Interfaces to what needs a model: embedders, judges and tasks, each with a deterministic stand-in."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from examloom.session import small_batches

DIMENSION = 64
EMBEDDERS: dict[str, Callable[[str], list[float]]] = {}
EVALUATORS: dict[str, Callable] = {}
TASKS: dict[str, Callable[[list[str]], list[str]]] = {}


def hash_embedding(text: str, size: int = DIMENSION) -> list[float]:
    """Signed hashed words, scaled to length 1: for tests and as a baseline, no model."""
    v = [0.0] * size
    for w in re.findall(r"\w+", text.lower()):
        h = hashlib.md5(w.encode()).digest()
        v[h[0] % size] += 1.0 if h[1] % 2 else -1.0
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


def count_embedding(text: str, size: int = DIMENSION) -> list[float]:
    """Hashed words of ASCII letters, digits and _, counted and scaled to length 1: without signs, so words never cancel each other out."""
    v = [0.0] * size
    for w in re.findall(r"\w+", text.lower(), re.ASCII):
        v[hashlib.md5(w.encode()).digest()[0] % size] += 1.0
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]


EMBEDDERS["hash"] = hash_embedding
EMBEDDERS["counts"] = count_embedding


def dense(name: str = "hash"):
    """A column function that embeds texts with the named embedder."""
    embed = EMBEDDERS[name]

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else embed(t))

    return run


@F.pandas_udf(T.StructType([T.StructField("indices", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.FloatType()))]))
def sparse(texts: pd.Series) -> pd.DataFrame:
    """Saturated term weights by hashed term; inverse document frequency is applied on retrieval."""
    rows = []
    for t in texts:
        words = Counter(int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") & 0x7FFFFFFF for w in re.findall(r"\w+", (t or "").lower()))
        n = sum(words.values())
        rows.append((sorted(words), [words[k] * 2.2 / (words[k] + 1.2 * (0.25 + 0.75 * n / 256)) for k in sorted(words)]))
    return pd.DataFrame(rows, columns=["indices", "values"])


def late(name: str = "hash"):
    """One vector a word."""
    embed = EMBEDDERS[name]

    @F.pandas_udf("array<array<float>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [embed(w) for w in t.split()])

    return run


def vector_size(name: str = "hash") -> int:
    return len(EMBEDDERS[name]("probe"))


def lookup_judge(choices: dict[tuple[str, str], str]):
    """A judge that knows its choices for (answer, reference) beforehand; unknown pairs are unscored."""

    @F.pandas_udf("string")
    def run(answer: pd.Series, reference: pd.Series) -> pd.Series:
        return pd.Series([choices.get((a, r)) if a else None for a, r in zip(answer, reference, strict=True)], dtype="object")

    return run


def judged_correctness(judge, answer, reference):
    """score, label and error of an open answer by a judge's choice; an empty answer is an error without score."""
    from examloom.functions.text import choice_score

    empty = answer.isNull() | (F.trim(answer) == "")
    choice = F.when(~empty, judge(answer, reference))
    return F.struct(choice_score(choice).alias("score"), choice.alias("label"), F.when(empty, "empty answer").when(choice.isNull(), "no choice").alias("error"))


#: Waits in seconds between tries.
WAITS = (1.0, 2.0, 4.0)


def with_retries(call: Callable, waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] | None = None):
    """call(), tried again after each wait; the last failure is raised."""
    import time

    for wait in (*waits, None):
        try:
            return call()
        except Exception:
            if wait is None:
                raise
            (sleep or time.sleep)(wait)


def patiently(call: Callable, probe: Callable[[], bool] | None = None, attempts: int = 10, first: float = 1.0, most: float = 1800.0, jitter: float = 300.0, poll: float = 10.0, clock: tuple[Callable, Callable, Callable] | None = None):
    """call(), for services that limit their callers.

    An error with a reset_at (seconds since 1970) is waited out until a second
    after it.  When the connection fails and there is a probe, it is asked every
    poll seconds until it answers, and the call is made again.  Any other error
    waits first, twice, four times that ... seconds, most at most, and a random
    part of the jitter besides, but of no more than that wait.  The error of the
    last of the attempts is raised.  clock: (now, sleep, a random number from 0 to
    1), for tests.
    """
    import random
    import time

    now, sleep, dice = clock or (time.time, time.sleep, random.random)
    for k in range(1, attempts + 1):
        try:
            return call()
        except Exception as e:
            if k == attempts:
                raise
            reset = getattr(e, "reset_at", None)
            if reset is not None:
                sleep(max(0.0, reset + 1 - now()))
            elif probe is not None and isinstance(e, ConnectionError | TimeoutError):
                while not probe():
                    sleep(poll)
            else:
                wait = min(most, first * 2 ** (k - 1))
                sleep(wait + dice() * min(jitter, wait))


def embedded_in_batches(df, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], size: int = 50, waits: tuple[float, ...] = WAITS):
    """key and vector of every text, embedded `size` texts a call with retries; tasks run side by side, as many as the cluster has cores."""
    small_batches(df.sparkSession)

    def run(parts):
        for part in parts:
            for at in range(0, len(part), size):
                some = part.iloc[at : at + size]
                vectors = with_retries(lambda some=some: embed(some["t"].fillna("").tolist()), waits)
                yield pd.DataFrame({"k": some["k"], "vector": vectors})

    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {dict(df.dtypes)[key]}, vector array<float>").withColumnRenamed("k", key)


def register_task(name: str, task: Callable[[list[str]], list[str]]) -> None:
    """A task maps prompts to outputs (JSON), one each, in order."""
    TASKS[name] = task


def task_runs(df, key: str, prompt: str, name: str, size: int = 20, waits: tuple[float, ...] = WAITS):
    """key, output and error of the named task over every prompt, `size` prompts a call, with retries; a call that fails for good is an error of its rows."""
    task = TASKS[name]

    def run(parts):
        for part in parts:
            for at in range(0, len(part), size):
                some = part.iloc[at : at + size]
                try:
                    out, error = with_retries(lambda some=some: task(some["t"].tolist()), waits), None
                except Exception as e:
                    out, error = [None] * len(some), f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"k": some["k"], "output": out, "error": [error] * len(some)})

    return df.select(F.col(key).alias("k"), F.col(prompt).alias("t")).mapInPandas(run, f"k {dict(df.dtypes)[key]}, output string, error string").withColumnRenamed("k", key)


def register_evaluator(name: str, column: Callable) -> None:
    """An evaluator maps columns (predicted, expected) to struct(score, label)."""
    EVALUATORS[name] = column


def evaluated_totals(df, name: str, predicted, expected):
    """label, its number of rows (n) and the sum of their scores (score) by the named evaluator, which sees each distinct pair of answers once."""
    pairs = df.groupBy(predicted.alias("predicted"), expected.alias("expected")).agg(F.count("*").alias("n"))
    told = pairs.select(EVALUATORS[name](F.col("predicted"), F.col("expected")).alias("r"), "n")
    return told.groupBy("r.label").agg(F.sum("n").alias("n"), F.sum(F.col("r.score") * F.col("n")).alias("score"))
