"""Row filters with reasons, targets of repair, lookups by ordered ids, and content-addressed names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examloom.functions.text import is_null_like, is_retrieval, matches_keyword, strip


def drop_reason(kind: Column, answer: Column, options: Column, short_kinds: list[str]) -> Column:
    """Why a question is dropped, the first of: short answer, no answer, no option with text; null if it stays."""
    blank = F.forall(F.map_values(options), lambda v: is_null_like(v))
    return F.when(kind.isin(*short_kinds), "short_answer").when(is_null_like(answer), "null_answer").when(F.coalesce(blank, F.lit(True)), "null_options")


def question_problem(question: Column, options: Column, answer: Column) -> Column:
    """The first problem of an extracted question; null if it is valid."""
    return F.when(F.length(strip(F.coalesce(question, F.lit("")))) < 5, "short_question").when(F.coalesce(F.size(options), F.lit(0)) < 2, "few_options").when(is_null_like(answer), "no_answer").when(~F.map_contains_key(options, answer), "unknown_answer")


def allowed_type(kind: Column, allowed: list[str]) -> Column:
    return is_null_like(kind) | kind.isin(*allowed)


def usable_experiments(df: DataFrame, model: str, metadata: str, label: str, include: list[str] | None = None, exclude_models: list[str] | None = None, exclude_words: list[str] | None = None, retrieval_only: bool = False) -> DataFrame:
    """Experiments by model, by words in their metadata or label, and by whether they retrieve."""
    keep = [F.lit(True)]
    if include:
        keep.append(F.col(model).isin(*include))
    if exclude_models:
        keep.append(~F.col(model).isin(*exclude_models))
    if exclude_words:
        keep.append(~matches_keyword(exclude_words, F.col(metadata), F.col(label)))
    if retrieval_only:
        keep.append(is_retrieval(metadata))
    return df.where(reduce(lambda a, b: a & b, keep))


def valid_image(uri: Column) -> Column:
    return F.coalesce(uri.rlike(r"^https?://[^\s/]+"), F.lit(False))


def split_example(df: DataFrame, question: str, options: str, correct: str, metadata: list[str]) -> DataFrame:
    """A question as an example of a data set: input (without the right answer), expected, metadata."""
    rest = [c for c in df.columns if c not in (question, options, correct, *metadata)]
    return df.select(*rest, F.struct(F.col(question).alias("questionText"), F.col(options).alias("options")).alias("input"), F.col(correct).alias("expected"), F.struct(*metadata).alias("metadata"))


def expected_of(runs: DataFrame, examples: DataFrame, key: str, expected: str) -> DataFrame:
    """Runs with the expected answer of their example; those of unknown examples have none."""
    return runs.join(examples.select(key, expected), key, "left")


def repair_targets(runs: DataFrame, annotations: str, name: str, label: str, words: str) -> DataFrame:
    """Runs whose first annotation of the name has the label and the words in its explanation."""
    first = F.get(F.filter(annotations, lambda a: a["name"] == name), F.lit(0))
    return runs.where((first["label"] == label) & F.contains(first["explanation"], F.lit(words)))


def changed(old: list[Column], new: list[Column]) -> Column:
    """Whether any field differs; nulls are equal."""
    return reduce(lambda a, b: a | b, (~x.eqNullSafe(y) for x, y in zip(old, new, strict=True)))


def require_known(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """wanted; an error if it has keys that are not known."""
    odd = wanted.join(known.select(key), key, "left_anti").select(key).distinct().limit(5).collect()
    if odd:
        raise ValueError(f"unknown: {[r[key] for r in odd]}")
    return wanted


def images_of(questions: DataFrame, key: str, ids: str, images: DataFrame, image_id: str, name: str) -> DataFrame:
    """Per question the image names of its ids, in order, each once."""
    wanted = questions.select(key, F.posexplode(ids).alias("p", image_id))
    got = wanted.join(images.select(image_id, name), image_id)
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("p", F.col(name).alias("n")))), lambda x: x["n"]))
    return got.groupBy(key).agg(names.alias("images"))


def content_names(files: DataFrame, owner: str, content: Column, order: list[Column]) -> DataFrame:
    """Each owner's files with the index of their content among the owner's distinct contents, by first occurrence."""
    own = Window.partitionBy(owner)
    some = files.withColumn("sha256", F.sha2(content, 256)).withColumn("__p", F.row_number().over(own.orderBy(*order)))
    first = some.withColumn("__f", F.min("__p").over(Window.partitionBy(owner, "sha256")))
    return first.withColumn("index", F.dense_rank().over(own.orderBy("__f"))).drop("__p", "__f")
