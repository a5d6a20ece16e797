"""Folders of files: snapshots that a pointer and an index lead to, JSON folders, draft catalogues, stage files.

Folders are reached through Spark's own file systems, so any path that its readers can open will do.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import month_key, safe_text


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def write_text(spark: SparkSession, path: str, text: str, new: bool = False) -> bool:
    """Writes a small file by way of a second name, so that readers see all of it or nothing; with ``new`` False is returned if it is there."""
    fs, at = _file(spark, path)
    if new and fs.exists(at):
        return False
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not new:
        fs.delete(at, False)
    return fs.rename(beside, at)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it is not there."""
    return spark.read.text(path, wholetext=True).first()[0] if exists(spark, path) else None


def write_roots(cards: DataFrame, path: str, snapshot: str, key: str, *shown: str, files: int | None = None) -> None:
    """A snapshot of root cards: files that hold ranges of keys (as many as asked for, else as Spark finds fit), an index (key, shown columns, file), and the pointer last.

    A reader that comes meanwhile follows the pointer to the snapshot before; a write that breaks off leaves the pointer as it is.
    """
    spark, at = cards.sparkSession, f"{path}/{snapshot}"
    ranged = cards.repartitionByRange(files, key) if files else cards.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{at}/cards")
    index = spark.read.parquet(f"{at}/cards").select(key, *shown, F.col("_metadata.file_path").alias("file"))
    index.write.mode("overwrite").parquet(f"{at}/index")
    n = spark.read.parquet(f"{at}/index").count()
    write_text(spark, f"{path}/latest.json", json.dumps({"latest_snapshot": at, "root_count": n}))


def root_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The index that the pointer leads to; None where there is no pointer, or an empty one."""
    text = read_text(spark, f"{path}/latest.json")
    at = json.loads(text).get("latest_snapshot") if text else None
    return spark.read.parquet(f"{at}/index") if at else None


def load_roots(spark: SparkSession, path: str, key: str, wanted: Column | None = None) -> DataFrame | None:
    """Root cards of the latest snapshot that the index has (and ``wanted`` accepts, by index columns); only their files are opened.

    Names of files are gathered, one for each file of the snapshot at most, never keys.
    """
    index = root_index(spark, path)
    if index is None:
        return None
    rows = index if wanted is None else index.where(wanted)
    files = [r["file"] for r in rows.select("file").distinct().collect()]
    schema = spark.read.parquet(json.loads(read_text(spark, f"{path}/latest.json"))["latest_snapshot"] + "/cards").schema
    cards = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return cards if wanted is None else cards.join(rows.select(key), key, "left_semi")


def json_folder(spark: SparkSession, path: str, fields: str, under: str | None = None) -> DataFrame:
    """(file, place, fields, broken): entries of the lists in a folder's JSON files, in the files' list itself or in its field ``under``.

    A folder that is not there is an empty one. Files without such a list have no rows; a file that is no JSON has one row that says so.
    """
    schema = spark.createDataFrame([], fields).schema
    empty = spark.createDataFrame([], f"file string, place long, {fields}, broken boolean")
    if not exists(spark, path):
        return empty
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), F.try_parse_json("value").alias("v"))
    items = F.try_variant_get("v", f"$.{under}" if under else "$", "array<variant>")
    rows = files.select("file", F.col("v").isNull().alias("broken"), F.posexplode_outer(F.coalesce(items, F.array().cast("array<variant>"))).alias("place", "e")).where("broken OR place IS NOT NULL")
    named = [F.try_variant_get("e", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema]
    return rows.select("file", F.col("place").cast("long").alias("place"), *named, "broken")


def draft_catalogue(spark: SparkSession, path: str, summary: dict[str, str], at: str = "generated_at", kind: str | None = None, most: int = 12) -> DataFrame:
    """(artifact_id, card_type, json_file, markdown_file, summary, total): JSON drafts in a folder for each type, newest first, ``most`` of them."""
    if not exists(spark, path):
        return spark.createDataFrame([], "artifact_id string, card_type string, json_file string, markdown_file string, " + ", ".join(f"{k} string" for k in summary) + ", total long")
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_path").alias("json_file"))
    parts = F.split("json_file", "/")
    v = F.try_parse_json("value")
    rows = files.withColumn("artifact_id", F.regexp_replace(F.element_at(parts, -1), r"\.json$", "")).withColumn("card_type", F.element_at(parts, -2)).where(v.isNotNull())
    if kind is not None:
        rows = rows.where(F.col("card_type") == kind)
    total = rows.select(F.count("*").alias("total"))
    rows = rows.select("artifact_id", "card_type", "json_file", F.regexp_replace("json_file", r"\.json$", ".md").alias("markdown_file"), *(safe_text(F.try_variant_get(v, p, "string")).alias(k) for k, p in summary.items()))
    newest = rows.orderBy(F.desc(at), "artifact_id").limit(most)
    return newest.join(F.broadcast(total))  # one row


def stage_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(stage, file, month_key, bytes, stage_files, stage_bytes): the files below a folder's subfolders; contents are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("bytes"))
    parts = F.split("path", "/")
    rows = files.select(F.element_at(parts, -2).alias("stage"), F.element_at(parts, -1).alias("file"), "bytes").withColumn("month_key", month_key("file"))
    by = Window.partitionBy("stage")
    return rows.withColumn("stage_files", F.count("*").over(by)).withColumn("stage_bytes", F.sum("bytes").over(by))
