"""Scans of question files, documents and exported traces, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION = ("id BIGINT, question STRING, options MAP<STRING,STRING>, answer STRING, type STRING, hint STRING, explanation STRING, difficulty STRING, category_id STRING, original_id STRING, source STRUCT<exam_url:STRING, exam_title:STRING, found_by_keywords:ARRAY<STRING>>")
IMAGE = "STRUCT<id:STRING, uri:STRING, caption:STRING>"
MCQ = (f"id STRING, questionText STRING, metadata STRING, images ARRAY<{IMAGE}>, source MAP<STRING,STRING>, options ARRAY<STRUCT<id:STRING, text:STRING, images:ARRAY<{IMAGE}>>>, correctOptionIds ARRAY<STRING>")
OPEN_ENDED = (f"id STRING, questionText STRING, metadata STRING, images ARRAY<{IMAGE}>, source MAP<STRING,STRING>, referenceCorrectAnswers ARRAY<STRING>, referenceIncorrectAnswers ARRAY<STRING>")


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Whole files with their paths, from all folders below; unreadable ones are skipped."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def questions(spark: SparkSession, path: str, schema: str = QUESTION) -> DataFrame:
    """Questions of all JSON files, each an object with a list of questions or the bare list; other files give none."""
    return questions_of(documents(spark, path, "*.json"), schema)


def questions_of(raw: DataFrame, schema: str = QUESTION) -> DataFrame:
    """Questions of the texts of files (path, text)."""
    schema = T.StructType.fromDDL(schema)
    bare = F.from_json("text", T.ArrayType(schema))
    wrapped = F.from_json("text", T.StructType([T.StructField("questions", T.ArrayType(schema))]))["questions"]
    rows = F.when(F.ltrim("text").startswith("["), bare).otherwise(wrapped)
    return raw.select("path", F.posexplode(F.coalesce(rows, F.array().cast(T.ArrayType(schema)))).alias("pos", "q")).select("path", "pos", "q.*")


def question_groups(spark: SparkSession, path: str, schema: str = MCQ) -> DataFrame:
    """Questions of files with groups, one row each with its group's id and place."""
    return flattened(documents(spark, path, "*.json"), schema)


def flattened(raw: DataFrame, schema: str = MCQ) -> DataFrame:
    """Questions of the texts of files with groups (path, text)."""
    group = T.StructType([T.StructField("id", T.StringType()), T.StructField("metadata", T.StringType()), T.StructField("questions", T.ArrayType(T.StructType.fromDDL(schema)))])
    groups = raw.select("path", F.posexplode_outer(F.from_json("text", T.ArrayType(group))).alias("group_pos", "g"))
    return groups.select("path", "group_pos", F.col("g.id").alias("group_id"), F.posexplode("g.questions").alias("pos", "q")).select("path", "group_pos", "group_id", "pos", "q.*")


def validated(df: DataFrame) -> DataFrame:
    """Multiple-choice questions with a column invalid: why a row breaks the schema, null if it doesn't."""
    return df.withColumns({"images": F.coalesce("images", F.array().cast(df.schema["images"].dataType))}).withColumn(
        "invalid",
        F.when(F.col("id").isNull(), "id").when(F.col("questionText").isNull(), "questionText").when(F.coalesce(F.size("options"), F.lit(0)) < 1, "options").when(F.exists("options", lambda o: o["id"].isNull() | o["text"].isNull()), "options").when(F.coalesce(F.size("correctOptionIds"), F.lit(0)) < 1, "correctOptionIds"),
    )


def decode_or_fail(df: DataFrame) -> DataFrame:
    bad = validated(df).where("invalid IS NOT NULL").select("id", "invalid").limit(5).collect()
    if bad:
        raise ValueError(f"rows that break the schema: {[(r.id, r.invalid) for r in bad]}")
    return validated(df).drop("invalid")


def merged_pages(pages: DataFrame, document: str, name: str, text: str, image_prefix: tuple[str, str] | None = None) -> DataFrame:
    """One text a document of its page files, in the order of the numbers in their names, parted by a blank line."""
    body = F.col(text) if image_prefix is None else F.replace(F.col(text), F.lit(image_prefix[0]), F.lit(image_prefix[1]))
    number = F.regexp_extract(F.col(name), r"(\d+)\D*$", 1).cast("int")
    parts = F.transform(F.array_sort(F.collect_list(F.struct(number.alias("n"), F.col(name).alias("f"), body.alias("t")))), lambda x: x["t"])
    return pages.groupBy(document).agg(F.array_join(parts, "\n\n").alias("text"))


def scrolled(df: DataFrame, key: str, size: int = 128) -> DataFrame:
    """Rows with the page they come in when the table is scrolled in the order of its key."""
    from examloom.operators.packing import renumbered

    return renumbered(df, [F.col(key)], "place").withColumn("page", F.floor((F.col("place") - 1) / size)).drop("place")


def spans(spark: SparkSession, path: str) -> DataFrame:
    """Exported trace spans, one JSON object a line, in Parquet or JSON."""
    kind = "id STRING, parent_id STRING, name STRING, start STRING, end STRING, cost DOUBLE, tokens BIGINT, input STRING, output STRING"
    return spark.read.schema(kind).json(path)


def has_image(images: Column, options: Column) -> Column:
    return (F.size(images) > 0) | F.exists(options, lambda o: F.size(o["images"]) > 0)


def write_split(df: DataFrame, path: str) -> None:
    """Questions in folders by modality."""
    df.withColumn("modality", F.when(has_image(F.col("images"), F.col("options")), "multimodal").otherwise("text")).write.mode("overwrite").partitionBy("modality").json(path)


def write_report(df: DataFrame, path: str, kind: str = "type", removed: DataFrame | None = None) -> None:
    """Questions and, beside them, their counts by type; and, for removed pairs (stage, similarity), how many each stage removed and how similar they were."""
    df.write.mode("overwrite").json(f"{path}/questions")
    df.groupBy(F.coalesce(kind, F.lit("unknown")).alias("type")).agg(F.count("*").alias("n")).coalesce(1).write.mode("overwrite").json(f"{path}/statistics")
    if removed is not None:
        removed.groupBy("stage").agg(F.count("*").alias("removed"), F.min("similarity").alias("least"), F.max("similarity").alias("most")).coalesce(1).write.mode("overwrite").json(f"{path}/deduplication")


def upsert_in_batches(points: DataFrame, key: str, pos: str, budget: int, send, sent) -> DataFrame:
    """Send the points as JSON in batches of bounded bytes, one task a key: (key, batch, points, bytes, what sent() makes of a reply).

    A point above the budget by itself is an error.
    """
    import pandas as pd

    from examloom.operators.packing import pack

    body = points.withColumn("body", F.to_json(F.struct(*points.columns))).withColumn("size", F.octet_length("body"))
    packed = pack(body.select(key, pos, "body", F.col("size").cast("long").alias("size")), key, pos, "size", budget, strict=True)

    def run(keys, part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values(pos)
        reply = send("[" + ",".join(rows["body"]) + "]")
        return pd.DataFrame({key: [keys[0]], "batch": [int(keys[1])], "points": [len(rows)], "bytes": [int(rows["size"].sum())], "reply": [sent(reply)]})

    return packed.groupBy(key, "bin").applyInPandas(run, f"{key} {dict(points.dtypes)[key]}, batch int, points int, bytes long, reply string")


def write_rows(df: DataFrame, path: str, form: str = "json") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if form == "csv" else writer.json(path)


def create_if_absent(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at the path; made and written only if it is not there."""
    from examloom.operators.indexing import exists

    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with rows of the same key replaced by the changes, and new ones added."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes.select(*table.columns))
