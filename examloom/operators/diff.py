"""Differences of snapshots, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df; an error if a key occurs twice."""
    twice = df.groupBy(key).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"duplicate keys: {[r[key] for r in twice]}")
    return df


def snapshot_diff(local: DataFrame, remote: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key what to do to make remote like local: append, delete, patch (with the changed fields) or unchanged."""
    a = local.select(F.col(key), F.struct(*fields).alias("a"))
    b = remote.select(F.col(key), F.struct(*fields).alias("b"))
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields)))
    action = F.when(F.col("b").isNull(), "append").when(F.col("a").isNull(), "delete").when(F.size(changed) > 0, "patch").otherwise("unchanged")
    return both.select(key, action.alias("action"), F.when(action == "patch", changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def apply_diff(local: DataFrame, remote: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """remote after the plan: deleted rows go, appended and patched ones come from local."""
    touched = plan.where("action IN ('append', 'patch')").select(key)
    stay = remote.join(plan.where("action = 'unchanged'").select(key), key, "left_semi")
    return stay.unionByName(local.join(touched, key, "left_semi").select(*remote.columns))


def missing_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return wanted.join(known.select(key), key, "left_anti")


def grouped(df: DataFrame, group: str, pos: Column, row: list[str]) -> DataFrame:
    """Rows of each group as an ordered array."""
    return df.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("__p"), F.struct(*row).alias("__r")))), lambda x: x["__r"]).alias("questions"))


def rebuilt(groups: DataFrame, rows: DataFrame, group: str, pos: str, row: list[str]) -> DataFrame:
    """Groups with their rows again; groups without rows stay, empty."""
    arrays = grouped(rows, group, F.col(pos), row)
    none = F.array().cast(dict(arrays.dtypes)["questions"])
    return groups.join(arrays, group, "left").withColumn("questions", F.coalesce("questions", none))


def remapped(rows: DataFrame, files: DataFrame, exact: list[str], by: str, order: str, value: str, name: str = "found") -> DataFrame:
    """rows with the value of the file that has all their exact keys, else of the first file (by the order) with the same `by`; rows with neither go, equal results stay once.

    Of several files with the same exact keys the first counts.
    """
    first = lambda keys: files.groupBy(*keys).agg(F.min_by(value, F.struct(order, value)).alias("__v"))
    own = first(exact).withColumnRenamed("__v", "__exact")
    other = first([by]).withColumnRenamed("__v", "__other")
    out = rows.join(own, exact, "left").join(other, by, "left").withColumn(name, F.coalesce("__exact", "__other"))
    return out.where(F.col(name).isNotNull()).select(*rows.columns, name).distinct()
