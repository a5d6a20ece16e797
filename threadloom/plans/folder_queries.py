"""Queries of snapshots, JSON folders, catalogues and commits; each writes what it reads to the shared folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import commits
from threadloom.sources import folders
from threadloom.sources.shared import shared_dir
from threadloom.sources.tables import table

from .registry import query


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT p_partkey, p_name, p_brand, p_size FROM part WHERE p_partkey BETWEEN 40 AND 60 OR (p_partkey > 150 AND p_brand = 'Brand#3')""")
def indexed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards in a snapshot, found by pointer and index; the snapshot before has other rows and stays unread."""
    p, path = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), _new(spark, "roots")
    folders.write_roots(p.limit(3), path, "first", "p_partkey", "p_brand")
    folders.write_roots(p, path, "second", "p_partkey", "p_brand")
    return folders.load_roots(spark, path, "p_partkey", F.expr("p_partkey BETWEEN 40 AND 60 OR (p_partkey > 150 AND p_brand = 'Brand#3')"))


@query("""SELECT 'f' || (conv_id % 4) || '.json' AS file, count(*) AS n, sum(turn) AS turns, count(DISTINCT role) AS roles FROM conversations GROUP BY 1""")
def topic_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the lists in a folder of JSON files; one that is not there is empty."""
    path = _new(spark, "topics")
    c = table(spark, sf_dir, "conversations")
    files = c.groupBy((F.col("conv_id") % 4).alias("k")).agg(F.collect_list(F.struct("conv_id", "turn", "role")).alias("source_topic_index"))
    for k in range(4):
        files.where(F.col("k") == k).select("source_topic_index").coalesce(1).write.json(f"{path}/raw{k}")
        text = spark.read.text(f"{path}/raw{k}", wholetext=True, pathGlobFilter="*.json").first()
        if text:
            folders.write_text(spark, f"{path}/in/f{k}.json", text[0])
    found = folders.json_folder(spark, f"{path}/in", "conv_id long, turn long, role string", "source_topic_index").unionByName(folders.json_folder(spark, f"{path}/none", "conv_id long, turn long, role string"))
    return found.groupBy("file").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"), F.count_distinct("role").alias("roles"))


_DECIDED = """SELECT event_id, user_id % 5 AS s, CASE event_id % 6 WHEN 0 THEN 'new' WHEN 1 THEN 'update' WHEN 2 THEN 'skip' WHEN 3 THEN 'delete' WHEN 4 THEN 'touch' ELSE 'merge' END AS d,
  CASE WHEN event_id % 6 = 4 AND event_id % 4 = 0 THEN '' ELSE 'c' || (user_id % 37) END AS card, CASE WHEN event_id % 6 = 4 THEN '' ELSE event_type END AS title FROM events WHERE user_id % 3 < 2 OR event_id % 2 = 0"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of events, a batch for each user modulo 3; the last batch keeps every second one."""
    e = table(spark, sf_dir, "events").where("user_id % 3 < 2 OR event_id % 2 = 0")
    k = F.col("event_id") % 6
    said = F.element_at(F.array(*map(F.lit, ("create", "Patch", "hold", "archive", "", "merge_into"))), (k + 1).cast("int"))
    none = {c: F.lit("") for c in ("family_id", "card_type", "status", "phase", "summary", "inject_short", "next_hint", "actor", "source")}
    return e.select(
        (F.col("user_id") % 3).alias("part"), (F.col("user_id") % 5).cast("string").alias("scope"), F.col("event_id").alias("at"), said.alias("decision"), F.col("event_id").cast("string").alias("packet_id"),
        F.when((k == 4) & (F.col("event_id") % 4 == 0), "").otherwise(F.concat(F.lit("c"), (F.col("user_id") % 37).cast("string"))).alias("card_id"), F.when(k == 4, "").otherwise(F.col("event_type")).alias("title"),
        F.lit("r").alias("reason"), F.array("event_type").alias("tags"), F.lit(None).cast("array<string>").alias("related"), *(v.alias(c) for c, v in none.items()),
    )


def commit_all(spark: SparkSession, sf_dir: str) -> str:
    """Three batches, of which the second comes twice and a fourth breaks off before its marker."""
    path, d = _new(spark, "commits"), decided(spark, sf_dir)
    for part in (0, 1, 1, 2):
        commits.commit(d.where(F.col("part") == part).drop("part"), path, f"b{part}", part)
    for name, rows in zip(("registry", "ledger"), commits.entries(d.drop("part").withColumn("title", F.lit("never"))), strict=True):
        rows.write.parquet(f"{path}/{name}/batch=b9")
    return path


@query(f"""WITH e AS ({_DECIDED}), m AS (SELECT *, user_id % 3 AS b FROM e JOIN events USING (event_id)), r AS (SELECT * FROM m WHERE d <> 'skip' AND (d <> 'touch' OR card || title <> '')),
  l AS (SELECT *, row_number() OVER (PARTITION BY s, card ORDER BY b DESC, event_id DESC) AS n, min(event_id) OVER (PARTITION BY s, card) AS first FROM r)
  SELECT CAST(s AS VARCHAR) AS scope, card AS card_id, CASE WHEN title <> '' THEN title ELSE '已存在卡片' END AS title, CASE WHEN d = 'delete' THEN 'archived' ELSE 'draft' END AS status, d AS last_action, event_id AS updated_at, first AS created_at FROM l WHERE n = 1""")
def committed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: the registry after three batches, a replay and a batch that broke off."""
    return commits.registry(spark, commit_all(spark, sf_dir)).select("scope", "card_id", "title", "status", "last_action", "updated_at", "created_at")


@query(f"""WITH e AS ({_DECIDED}), m AS (SELECT *, user_id % 3 AS b FROM e JOIN events USING (event_id)), l AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY b DESC, event_id DESC) AS rank FROM m)
  SELECT CAST(s AS VARCHAR) AS scope, event_id AS created_at, d AS decision, card AS target_card_id, rank FROM l WHERE rank <= 100""")
def committed_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred ledger rows of each scope after the same batches."""
    return commits.ledger(spark, commit_all(spark, sf_dir), 100).select("scope", F.col("at").alias("created_at"), "decision", "target_card_id", F.col("rank").cast("long").alias("rank"))
