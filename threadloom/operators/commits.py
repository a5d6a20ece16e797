"""Decisions that change a registry and a ledger as one step.

Each batch writes its rows of both tables under its own id, and its marker last. Readers join the rows with the markers, so a batch that
broke off is not there, and one that comes again is told from its marker: the same contents are a replay, others a conflict. Nothing is
rewritten: the registry is each card's latest entry, the ledger the newest rows of each scope.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import distinct_exact, first_text, safe_text
from threadloom.sources.folders import exists, read_text, write_text

from .signals import decision

#: What a card without title is called, with and without an id; how many ledger rows a scope keeps.
KNOWN_TITLE, NEW_TITLE, KEPT = "已存在卡片", "未命名卡片", 400
TEXTS = ["packet_id", "family_id", "card_type", "card_id", "title", "status", "phase", "summary", "inject_short", "reason", "next_hint", "actor", "source"]


def _or(c: str, other: str | Column) -> Column:
    return first_text(c, F.lit(other) if isinstance(other, str) else other)


def entries(decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry and ledger rows of decisions (scope, at, decision, the columns of ``TEXTS``, tags, related).

    A decision that skips changes no card; a touch only one that names a card, a title or a summary. Deleted cards are archived.
    """
    d = decisions.withColumn("decision", decision("decision"))
    d = d.select("scope", "at", "decision", *(safe_text(c).alias(c) for c in TEXTS), distinct_exact(F.coalesce("tags", F.array().cast("array<string>")), 24).alias("tags"), distinct_exact(F.coalesce("related", F.array().cast("array<string>")), 24).alias("related"))
    summary = first_text("summary", "inject_short")
    named = F.when(F.col("card_id") != "", KNOWN_TITLE).otherwise(NEW_TITLE)
    d = d.withColumns({"card_type": _or("card_type", "memo"), "family_id": _or("family_id", "unassigned"), "actor": _or("actor", "unknown"), "touched": (F.col("decision") != "skip") & ((F.col("decision") != "touch") | (F.concat("card_id", "title", "summary") != "")), "title": _or("title", named), "summary": summary})
    made = F.concat(F.lit("card_"), F.left(F.sha2(F.concat_ws("|", "scope", "family_id", "card_type", "title"), 256), F.lit(16)))
    status = F.when(F.col("status") != "", F.col("status")).when(F.col("decision") == "delete", "archived").otherwise("draft")
    d = d.withColumn("card_id", F.when(F.col("touched"), first_text("card_id", made)).otherwise(F.col("card_id")))
    registry = d.where("touched").select("scope", "card_id", "card_type", "family_id", "title", status.alias("status"), "phase", "summary", "inject_short", "tags", "related", "packet_id", F.col("decision").alias("last_action"), F.col("actor").alias("last_actor"), "at")
    key = F.concat_ws("|", "scope", F.col("at").cast("string"), "packet_id", "decision", "card_id", "reason")
    ledger = d.select(F.concat(F.lit("entry_"), F.left(F.sha2(key, 256), F.lit(16))).alias("entry_id"), "scope", "at", "packet_id", "family_id", "card_type", "decision", F.col("card_id").alias("target_card_id"), "reason", "next_hint", "actor", "source", "tags", "related")
    return registry, ledger


def contents(rows: DataFrame) -> str:
    """A digest of rows in any order: their number and the sum of their hashes."""
    r = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(F.to_json(F.struct(*rows.columns)),)).cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']}:{r['s'] or 0}"


def commit(decisions: DataFrame, path: str, batch: str, seq: int) -> str:
    """Writes a batch; ``write``, ``replay`` (its marker is there with the same contents) or ``conflict`` (with others; nothing is changed)."""
    spark, marker, digest = decisions.sparkSession, f"{path}/commits/{batch}.json", contents(decisions)
    if exists(spark, marker):
        return "replay" if json.loads(read_text(spark, marker))["digest"] == digest else "conflict"
    for name, rows in zip(("registry", "ledger"), entries(decisions), strict=True):
        rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")  # what a broken run has left goes
    return "write" if write_text(spark, marker, json.dumps({"batch": batch, "seq": seq, "digest": digest}), new=True) else "replay"


def _committed(spark: SparkSession, path: str, name: str) -> DataFrame:
    marks = spark.read.schema("batch string, seq long").json(f"{path}/commits")
    return spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}").withColumn("batch", F.col("batch").cast("string")).join(marks, "batch")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Each card's latest entry, with the time of its first one."""
    rows = _committed(spark, path, "registry").drop("batch")
    rest = [c for c in rows.columns if c not in ("scope", "card_id", "seq")]
    latest = rows.groupBy("scope", "card_id").agg(F.max_by(F.struct(*rest), F.struct("seq", "at", F.to_json(F.struct(*rest)))).alias("r"), F.min("at").alias("created_at"))
    return latest.select("scope", "card_id", *(F.col(f"r.{c}").alias("updated_at" if c == "at" else c) for c in rest), "created_at")


def ledger(spark: SparkSession, path: str, most: int = KEPT) -> DataFrame:
    """The newest entries of each scope; an entry that was written twice is one."""
    rows = _committed(spark, path, "ledger").drop("batch").dropDuplicates(["scope", "entry_id"])
    rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("seq"), F.desc("at"), "entry_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def registry_summary(cards: DataFrame) -> DataFrame:
    """(scope, card_type, n, last_updated): how many cards of each type a scope has."""
    return cards.groupBy("scope", "card_type").agg(F.count("*").alias("n"), F.max("updated_at").alias("last_updated"))
