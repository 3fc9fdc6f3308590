"""Row-level measures of answers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from examloom.functions.text import option_ids, score_label


def true_positives(predicted: Column, expected: Column) -> Column:
    return F.size(F.array_intersect(option_ids(predicted), option_ids(expected)))


def precision(predicted: Column, expected: Column) -> Column:
    n = F.size(option_ids(predicted))
    return F.when(n > 0, true_positives(predicted, expected) / n).otherwise(F.lit(0.0))


def recall(predicted: Column, expected: Column) -> Column:
    n = F.size(option_ids(expected))
    return F.when(n > 0, true_positives(predicted, expected) / n).otherwise(F.lit(0.0))


def f1(predicted: Column, expected: Column) -> Column:
    p, r = precision(predicted, expected), recall(predicted, expected)
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def evaluated(metric, predicted: Column, expected: Column) -> Column:
    """score and label; a missing expectation or prediction is an error that scores 0."""
    bad = expected.isNull() | predicted.isNull() | (F.size(option_ids(F.coalesce(predicted, F.array().cast("array<string>")))) == 0)
    score = metric(predicted, expected)
    return F.struct(F.when(bad, 0.0).otherwise(score).alias("score"), F.when(bad, "error").otherwise(score_label(score)).alias("label"))


def answer_mode(expected: Column) -> Column:
    return F.when(F.size(expected) == 1, "single").otherwise("multi")


def run_score(score: Column, run_error: Column, annotation_error: Column) -> Column:
    """Null wherever the run or its annotation failed."""
    return F.when(run_error.isNull() & annotation_error.isNull() & ~F.isnan(score), score)


def first_annotation(annotations: Column, name: str) -> Column:
    return F.get(F.filter(annotations, lambda a: a["name"] == name), F.lit(0))


def multi_answer_category(correct: Column, options: Column) -> Column:
    """single; garbled if ids repeat or are unknown; all_correct; else plausible_multi."""
    unique = F.array_distinct(correct)
    bad = (F.size(unique) < F.size(correct)) | (F.size(F.array_except(correct, options)) > 0)
    return F.when(F.size(correct) <= 1, "single").when(bad, "garbled").when(F.size(unique) == F.size(options), "all_correct").otherwise("plausible_multi")
