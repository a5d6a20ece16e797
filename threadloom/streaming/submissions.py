"""Streaming forms: submissions applied once by digest, and windowed counts with a watermark."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadloom.operators.state import submissions
from threadloom.sources.folders import exists


def apply_batch(batch: DataFrame, table: str, mark: str, key: str = "task", digest: str = "digest") -> None:
    """Writes what a batch adds to the table, and its conflicts to ``<table>_conflicts``, under the batch's own mark (column ``batch``).

    What is known are the rows of other batches, and each write replaces what the same batch has left, so a batch that is run again, whole or after it broke
    off between its writes, leaves the same rows and the same conflicts once.
    """
    spark = batch.sparkSession
    known = spark.read.parquet(table).where(F.col("batch") != mark).select(key, digest) if exists(spark, table) else batch.select(key, digest).limit(0)
    judged = submissions(batch, known, key, digest).persist()
    for outcome, path in (("write", table), ("conflict", f"{table}_conflicts")):
        judged.where(F.col("outcome") == outcome).drop("outcome").write.mode("overwrite").parquet(f"{path}/batch={mark}")
    judged.unpersist()


def applied_once(stream: DataFrame, table: str, checkpoint: str, key: str = "task", digest: str = "digest") -> StreamingQuery:
    """Appends each submission once: a replay is dropped, another digest for a known key goes to the conflicts.

    Runs until all that is there has been read, and resumes at its checkpoint. Batches are told apart by the checkpoint and their number.
    """
    run = f"r{zlib.crc32(checkpoint.encode()):08x}"
    put = lambda batch, number: apply_batch(batch, table, f"{run}-{number}", key, digest)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, kind: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts per time window and kind; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
