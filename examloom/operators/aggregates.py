"""Mergeable score and usage aggregates.  All are sums, counts, minima and maxima, so Spark combines them before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def score_partials(df: DataFrame, keys: list[str], score: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("run_count"), F.count(score).alias("scored"), F.sum(score).alias("total"), F.sum(score * score).alias("squares"), F.min(score).alias("lowest"), F.max(score).alias("highest"))


def summary_partials(df: DataFrame, mean: Column, n: Column, lowest: Column, highest: Column) -> DataFrame:
    """Partials of rows that hold summaries only: squares are known only if all scores are equal."""
    return df.withColumns({"scored": n, "total": mean * n, "squares": F.when(lowest == highest, n * lowest * lowest), "lowest": lowest, "highest": highest})


def merged(partials: DataFrame, keys: list[str]) -> DataFrame:
    """Unknown squares of any part make the whole's unknown."""
    known = F.count(F.when((F.col("scored") == 0) | F.col("squares").isNotNull(), 1)) == F.count("*")
    return partials.groupBy(*keys).agg(F.sum("run_count").alias("run_count"), F.sum("scored").alias("scored"), F.sum("total").alias("total"), F.when(known, F.coalesce(F.sum("squares"), F.lit(0.0))).alias("squares"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))


def final_scores(df: DataFrame) -> DataFrame:
    """mean, variance (0 for one score), standard deviation and error."""
    n = F.col("scored")
    spread = F.greatest(F.lit(0.0), (F.col("squares") - F.col("total") * F.col("total") / n) / (n - 1))
    out = df.withColumn("mean", F.when(n > 0, F.col("total") / n)).withColumn("variance", F.when(n > 1, spread).when((n == 1) & F.col("squares").isNotNull(), F.lit(0.0)))
    return out.withColumn("sd", F.sqrt("variance")).withColumn("se", F.when(n > 0, F.col("sd") / F.sqrt(n)))


def over_experiments(df: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted and unweighted means of finalised experiments."""
    return df.groupBy(*keys).agg(
        F.countDistinct("dataset").alias("datasets"),
        F.countDistinct("experiment").alias("experiments"),
        (F.sum("total") / F.sum("scored")).alias("weighted_mean"),
        F.avg("mean").alias("unweighted_mean"),
        (F.sqrt(F.sum(F.col("se") * F.col("se"))) / F.count("se")).alias("unweighted_se"),
    )


def usage(df: DataFrame, keys: list[str], tokens: Column, cost: Column, latency: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("runs"), F.sum(tokens).alias("tokens"), F.sum(cost).alias("cost"), (F.sum(tokens) / F.count("*")).alias("mean_tokens"), (F.sum(cost) / F.count("*")).alias("mean_cost"), (F.sum(latency) / F.count(latency)).alias("mean_latency"))


def score_bins(score: Column, eps: float = 1e-9) -> Column:
    return F.when(score.isNull(), "missing").when(F.abs(score) < eps, "zero").when(F.abs(score - 1) < eps, "one").when((score > 0) & (score < 1), "partial").otherwise("other")


def histogram(df: DataFrame, keys: list[str], score: Column) -> DataFrame:
    b = score_bins(score)
    return df.groupBy(*keys).agg(*(F.count_if(b == k).alias(k) for k in ("zero", "partial", "one", "other", "missing")))


def annotation_stats(df: DataFrame, name: Column, score: Column) -> DataFrame:
    return df.groupBy(F.coalesce(F.nullif(name, F.lit("")), F.lit("(unnamed)")).alias("name")).agg(F.count("*").alias("n"), F.count(score).alias("scored"), (F.count("*") - F.count(score)).alias("missing"), F.avg(score).alias("mean"), F.min(score).alias("lowest"), F.max(score).alias("highest"))


def counts_over_sets(df: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """Counts for several sets of columns at once."""
    keys = [[F.col(c) for c in x] for x in sets]
    return df.groupingSets(keys, *columns).agg(F.grouping_id(*columns).alias("level"), F.count("*").alias("n"))


def mode_label(mode: Column, custom: Column) -> Column:
    """The failure mode; of mode "other" with what the analyst called it."""
    return F.when((mode == "other") & (F.length(F.trim(F.coalesce(custom, F.lit("")))) > 0), F.concat(F.lit("other: "), F.trim(custom))).otherwise(mode)


def failure_modes(df: DataFrame, mode: str, dataset: str, model: str) -> DataFrame:
    """Counts of modes overall (with their percentage), by dataset, by model and by both."""
    n = counts_over_sets(df, [[mode], [dataset, mode], [model, mode], [dataset, model, mode]], [dataset, model, mode])
    total = df.agg(F.count("*").alias("total"))
    share = F.when(F.col("level") == 6, F.floor(F.col("n") * 1000.0 / F.col("total") + 0.5) / 10)
    return n.crossJoin(F.broadcast(total)).withColumn("pct", share).drop("total")


def mode_groups(df: DataFrame, label: str, example: str) -> DataFrame:
    """The groups of a label, the largest first: their size and examples, each once."""
    return df.groupBy(label).agg(F.count("*").alias("n"), F.countDistinct(example).alias("examples")).orderBy(F.desc("n"), label)


def dense_counts(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """A count for every value of a fixed domain, 0 for those absent."""
    spark = df.sparkSession
    every = spark.createDataFrame([(v,) for v in domain], f"{column} string")
    found = df.where(F.col(column).isin(*domain)).groupBy(column).agg(F.count("*").alias("n"))
    return every.join(F.broadcast(found), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def nearest_rank(column: str, p: float) -> Column:
    """The value at the p-th share of the sorted ones."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{column}`)")
