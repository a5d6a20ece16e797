"""Tables that grow by submissions: replay and conflict, upsert, retention, latest state, guarded sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def submissions(incoming: DataFrame, known: DataFrame, key: str, digest: str) -> DataFrame:
    """``incoming`` with ``outcome``: replay (same digest known), conflict (another digest known), repeat within the call, or write."""
    seen = known.groupBy(key).agg(F.collect_set(digest).alias("seen_"))  # a key has one digest unless something went wrong
    first = F.row_number().over(Window.partitionBy(key).orderBy("arrival"))
    out = incoming.join(seen, key, "left").withColumn("nth_", first)
    head = F.first(digest).over(Window.partitionBy(key).orderBy("arrival"))
    within = F.when(F.col("nth_") == 1, "write").when(F.col(digest) == head, "replay").otherwise("conflict")
    known_ = F.when(F.array_contains("seen_", F.col(digest)), "replay").otherwise("conflict")
    return out.withColumn("outcome", F.when(F.col("seen_").isNotNull(), known_).otherwise(within)).drop("seen_", "nth_")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of the same key, others are added."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def retained(rows: DataFrame, by: str, at: str, tie: str, most: int) -> DataFrame:
    """The newest ``most`` rows of each ``by``."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most)


def current(events: DataFrame, key: str, state: str, at: str, tie: str) -> DataFrame:
    """Each key's latest state from an append-only table of events."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(at, tie)).alias(state), F.count("*").alias("n_events"))


def write_unless_empty(df: DataFrame, path: str) -> bool:
    """Overwrites a table, but keeps what is there if the frame is empty."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_new(df: DataFrame, path: str) -> None:
    """Fails if the table exists."""
    df.write.mode("errorifexists").parquet(path)


def write_snapshot(df: DataFrame, path: str, *by: str) -> None:
    """One folder for each value of the partition columns; readers prune by them."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
