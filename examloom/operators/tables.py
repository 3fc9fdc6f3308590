"""Chunkers and question grammars as table functions, for SQL with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf

from examloom.operators.chunking import METHODS, needs_model
from examloom.sources import parsers

#: A function is analysed where there is no session to parse DDL.
CHUNKS = T.StructType([T.StructField(k, t) for k, t in (("chunk", T.IntegerType()), ("text", T.StringType()), ("start_index", T.IntegerType()), ("end_index", T.IntegerType()), ("token_count", T.IntegerType()))])
QUESTIONS = T.StructType([T.StructField(k, t) for k, t in (("number", T.IntegerType()), ("question", T.StringType()), ("options", T.MapType(T.StringType(), T.StringType())), ("answer", T.StringType()), ("explanation", T.StringType()), ("images", T.ArrayType(T.StringType())), ("repairs", T.IntegerType()))])


def _named(argument: AnalyzeArgument, known: dict, what: str) -> str:
    """A name that must be a constant, so that a wrong one fails before anything runs."""
    if not argument.isConstantExpression or argument.value not in known:
        raise ValueError(f"{what} must be one of {', '.join(sorted(known))}")
    return argument.value


class Chunk:
    """chunk(text, method[, size]): the chunks of a text by a registered method; null texts have none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, method: AnalyzeArgument, size: AnalyzeArgument | None = None) -> AnalyzeResult:
        if METHODS[_named(method, METHODS, "the method")] is needs_model:
            raise ValueError(f"the chunker {method.value} needs a model")
        return AnalyzeResult(schema=CHUNKS)

    def eval(self, text: str, method: str, size: int | None = None) -> Iterator[tuple]:
        for i, (a, b, n) in enumerate(METHODS[method](text, **({} if size is None else {"chunk_size": size})) if text else ()):
            yield i, text[a:b], a, b, n


class Questions:
    """questions(text, grammar): the questions of a text by a registered grammar; null texts have none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, grammar: AnalyzeArgument) -> AnalyzeResult:
        _named(grammar, parsers.PARSERS, "the grammar")
        return AnalyzeResult(schema=QUESTIONS)

    def eval(self, text: str, grammar: str) -> Iterator[tuple]:
        for q in parsers.PARSERS[grammar](text) if text else ():
            yield q["number"], q["question"], q["options"], q["answer"], q["explanation"], q["images"], q["repairs"]


def register(spark: SparkSession) -> None:
    """chunk and questions, for this session's SQL."""
    spark.udtf.register("chunk", udtf(Chunk, useArrow=True))
    spark.udtf.register("questions", udtf(Questions, useArrow=True))
