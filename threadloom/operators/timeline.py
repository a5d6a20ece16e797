"""Messages in windows: merged timelines, ranges, census, contiguity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.sources.shared import held


def merged_timeline(rows: DataFrame, seconds: str, arrival: str) -> DataFrame:
    """Adds ``position`` in one sequence over all windows: by time, unknown times (0) last, then by arrival.

    Rows are sorted in ranges of (time, arrival), so a busy day or many unknown times are split like others; ranges are kept, counted, and moved
    by the rows of the ranges before: one row for each range is all that meets.
    """
    at = F.when(F.col(seconds) == 0, F.lit(2**60)).otherwise(F.col(seconds)).cast("long")
    ranged = rows.withColumn("at_", at).repartitionByRange("at_", arrival).sortWithinPartitions("at_", arrival).drop("at_")
    kept = held(ranged.withColumn("in_", F.monotonically_increasing_id()).withColumn("range_", F.spark_partition_id()))
    ranges = kept.groupBy("range_").agg(F.count("*").alias("n_"), F.min("in_").alias("low_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = ranges.select("range_", (before - F.col("low_") + 1).alias("start_"))
    return kept.join(F.broadcast(start), "range_").withColumn("position", F.col("start_") + F.col("in_")).drop("range_", "in_", "start_")  # as many rows as ranges


def window_ranges(messages: DataFrame, window: str, index: str) -> DataFrame:
    return messages.groupBy(window).agg(F.min(index).alias("start_msg_index"), F.max(index).alias("end_msg_index"), F.count("*").alias("message_count"))


def census(messages: DataFrame, window: str, index: str) -> DataFrame:
    """Per window: rows, distinct numbers, duplicates, numbers below 1, and whether 1..max is complete."""
    per = messages.groupBy(window, index).agg(F.count("*").alias("n"))
    valid = F.col(index) >= 1
    return per.groupBy(window).agg(
        F.sum("n").alias("n_rows"), F.count_if(valid).alias("n_numbers"), F.count_if(F.col("n") > 1).alias("n_duplicates"),
        F.sum(F.when(valid, 0).otherwise(F.col("n"))).alias("n_invalid"), (F.max(index) == F.count_if(valid)).alias("complete"),
    )


def contiguity(messages: DataFrame, window: str, index: str, arrival: str) -> DataFrame:
    """Per window, in order of arrival: ``exact``, or the first kind of break among disorder, duplicate, gap."""
    step = F.col(index) - F.lag(index).over(Window.partitionBy(window).orderBy(arrival))
    per = messages.withColumn("step", step).groupBy(window)
    kinds = per.agg(F.count_if(F.col("step") < 0).alias("back"), F.count_if(F.col("step") == 0).alias("same"), F.count_if(F.col("step") > 1).alias("gaps"))
    return kinds.select(window, F.when(F.col("back") > 0, "disorder").when(F.col("same") > 0, "duplicate").when(F.col("gaps") > 0, "gap").otherwise("exact").alias("status"), "gaps")


def exact_chunks(messages: DataFrame, bundle: str, window: str, index: str, arrival: str, size: int) -> tuple[DataFrame, DataFrame]:
    """States of bundles, and chunks of those that are exact: (bundle, status) and (bundle, window, chunk_no, start_msg_index, end_msg_index, message_count).

    A bundle is ``exact`` if each message names a window and a number of 1 and more, windows stand one after the other, and numbers rise by one in each. Else it has the first of these: ``missing_window``,
    ``missing_index``, ``mixed_window``, ``disorder``, ``duplicate``, ``gap``, and no chunks at all. Chunks have ``size`` messages of one window, the last one what is left.
    """
    by = Window.partitionBy(bundle).orderBy(arrival)
    step = F.col(index) - F.lag(index).over(Window.partitionBy(bundle, window).orderBy(arrival))
    named = F.coalesce(F.trim(F.col(window).cast("string")), F.lit("")) != ""
    rows = messages.withColumn("named_", named).withColumn("turn_", (F.lag(window).over(by).isNull() | (F.lag(window).over(by) != F.col(window))).cast("int")).withColumn("step_", step)
    per = rows.groupBy(bundle).agg(
        F.count_if(~F.col("named_")).alias("a"), F.count_if(F.coalesce(F.col(index) < 1, F.lit(True))).alias("b"), (F.sum("turn_") - F.count_distinct(window)).alias("c"), F.count_if(F.col("step_") < 0).alias("d"),
        F.count_if(F.col("step_") == 0).alias("e"), F.count_if(F.col("step_") > 1).alias("f"),
    )
    status = F.lit("exact")
    for column, name in reversed(list(zip("abcdef", ("missing_window", "missing_index", "mixed_window", "disorder", "duplicate", "gap"), strict=True))):
        status = F.when(F.col(column) > 0, name).otherwise(status)
    states = per.select(bundle, status.alias("status"))
    good = messages.join(states.where("status = 'exact'").select(bundle), bundle, "left_semi")
    first = good.groupBy(bundle, window).agg(F.min(index).alias("first_"))
    numbered = good.join(first, [bundle, window]).withColumn("chunk_no", (F.floor((F.col(index) - F.col("first_")) / size) + 1).cast("long"))
    chunks = numbered.groupBy(bundle, window, "chunk_no").agg(F.min(index).alias("start_msg_index"), F.max(index).alias("end_msg_index"), F.count("*").alias("message_count"))
    return states, chunks
