"""The chunk index: a table partitioned by source, with vectors; incremental updates, migration and schema identity."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examloom.functions.text import content_key

PROBE = "dimension probe"


def schema_id(descriptors: dict[str, dict]) -> str:
    """Twelve hex digits that name a set of vector descriptions, whatever their order."""
    if not ({"dense", "sparse"} & descriptors.keys()):
        raise ValueError("a dense or a sparse vector is needed")
    lines = sorted(f"{k}:{json.dumps(v, sort_keys=True)}" for k, v in descriptors.items())
    return hashlib.sha256("|".join(lines).encode()).hexdigest()[:12]


def table_name(method: str, descriptors: dict[str, dict]) -> str:
    return f"documents_{method}_{schema_id(descriptors)}"


def require_same_schema(found: dict[str, dict], wanted: dict[str, dict]) -> None:
    if schema_id(found) != schema_id(wanted):
        raise ValueError(f"the index holds {sorted(found)} with other settings than {sorted(wanted)}")


def embed_input(text: Column, context: Column) -> Column:
    return F.concat(text, F.coalesce(context, F.lit("")))


def with_keys(chunks: DataFrame, method: str) -> DataFrame:
    return chunks.withColumn("chunk_key", content_key("source", F.lit(method), "start_index", "end_index", "text"))


def overwrite_sources(chunks: DataFrame, path: str) -> None:
    """Replace the chunks of every source in chunks, all at once per source; other sources stay."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def create(spark: SparkSession, path: str, schema: str) -> bool:
    """An empty table at the path, unless there is one; whether it was made."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.parquet(path)
    return True


def count_points(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count() if exists(spark, path) else 0


def drop(spark: SparkSession, path: str) -> bool:
    """Whether there was a table to delete."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def file_key(name: Column) -> Column:
    return F.md5(name)


def not_indexed(files: DataFrame, indexed: DataFrame, name: str = "source", content: str | None = None) -> DataFrame:
    """Files whose name (or name and content) is not among the indexed ones."""
    key = F.md5(F.col(name)) if content is None else F.md5(F.concat_ws("|", name, F.sha2(content, 256)))
    return files.withColumn("file_key", key).join(indexed.select("file_key").distinct(), "file_key", "left_anti")


def migrated(points: DataFrame, sizes: dict[str, int], method: str, force: tuple[str, ...] = (), relaxed: bool = False) -> DataFrame:
    """Per vector whether it is reused or must be made anew (relaxed: any vector is reused); missing chunk keys are filled and noted."""
    out = points.withColumn("had_key", F.col("chunk_key").isNotNull()).withColumn("chunk_key", F.coalesce("chunk_key", content_key("source", F.lit(method), "start_index", "end_index", "text")))
    for name, size in sizes.items():
        v = F.col(name)
        if relaxed:
            good = v.isNotNull()
        elif name == "sparse":
            good = v.isNotNull() & (F.size(v["indices"]) == F.size(v["values"]))
        elif name == "late":
            good = v.isNotNull() & (F.size(F.get(v, F.lit(0))) == size)
        else:
            good = v.isNotNull() & (F.size(v) == size)
        out = out.withColumn(f"{name}_plan", F.when(F.lit(name not in force) & good, "reuse").otherwise("recompute"))
    return out


def migration_report(plan: DataFrame, names: list[str], samples: int = 25) -> DataFrame:
    """Counts by vector and plan, how many points had no chunk key, and the first of these."""
    missing = F.when(~F.col("had_key"), F.col("chunk_key"))
    first = plan.where("NOT had_key").orderBy("source", "start_index").limit(samples).agg(F.sort_array(F.collect_list("source")).alias("keyless"))
    return plan.agg(F.count(missing).alias("without_key"), F.count("*").alias("points"), *(F.count_if(F.col(f"{n}_plan") == p).alias(f"{n}_{p}") for n in names for p in ("reuse", "recompute"))).crossJoin(F.broadcast(first))
