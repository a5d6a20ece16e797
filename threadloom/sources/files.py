"""File sources: reviewed CSV months, JSON exports of several shapes, Markdown folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import first_text, month_key

#: Other names that the columns of reviewed files go by.
ALIASES = {
    "anchor_type": ("anchor_type", "card_type", "type"), "title": ("title", "card_name", "canonical_name"), "text": ("text", "content_text", "summary"),
    "time": ("time", "created_at", "first_seen_at"), "source_ref": ("source_ref", "ref"),
}


def csv_rows(spark: SparkSession, paths: list[str] | str, schema: str, fail: bool = False) -> DataFrame:
    """CSV with header, quotes, doubled quotes and fields over several lines; broken rows stand in ``_corrupt_record``, or fail."""
    wanted = T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.csv(paths, schema=wanted, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False, mode="FAILFAST" if fail else "PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def reviewed(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """Reviewed files under their common names, with the file's month."""
    rows = csv_rows(spark, paths, schema).withColumn("file", F.col("_metadata.file_name"))
    named = [first_text(*(c for c in names if c in rows.columns)).alias(k) if any(c in rows.columns for c in names) else F.lit("").alias(k) for k, names in ALIASES.items()]
    return rows.select(*named, "file", month_key("file").alias("month_key"), "_corrupt_record")


def json_shape(c: str) -> Column:
    """Kind of a JSON text: window_array, document_array, bundle, documents, messages, object, or text."""
    v = F.try_parse_json(c)
    has = lambda k: F.try_variant_get(v, k, "string").isNotNull()
    return (
        F.when(v.isNull(), "text").when(has("$[0].messages"), "window_array").when(has("$[0].text"), "document_array").when(has("$.bundle"), "bundle")
        .when(has("$.documents"), "documents").when(has("$.messages"), "messages").when(F.schema_of_variant(v).startswith("OBJECT"), "object").otherwise("text")
    )


def markdown_notes(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files below a folder: title, front matter type, bullets, wiki links, newest first."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified"))
    return files.select(
        "file", "modified", F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1).alias("title"), F.regexp_extract("value", r"(?m)^type:\s*(.+)$", 1).alias("type"),
        F.regexp_extract_all("value", F.lit(r"(?m)^[-*]\s+(.+)$"), F.lit(1)).alias("bullets"), F.regexp_extract_all("value", F.lit(r"\[\[([^\]|]+)"), F.lit(1)).alias("links"),
    ).orderBy(F.desc("modified"), "file")
