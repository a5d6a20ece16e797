"""Top-k with a report of what fell off, round-robin picks, tiered recall, latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """All rows with rank and ``selected``; what is beyond k stays, marked."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("rank", rank).withColumn("selected", F.col("rank") <= k)


def round_robin(rows: DataFrame, kind: str, kinds: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows taken in turn from each kind, kinds in the given order; a kind keeps its best k at most."""
    place = F.array_position(F.array(*map(F.lit, kinds)), F.col(kind))
    turn = F.row_number().over(Window.partitionBy(kind).orderBy(*order))
    best = rows.where(place > 0).withColumn("turn", turn).where(F.col("turn") <= k).withColumn("place_", place)
    return best.orderBy("turn", "place_").limit(k).drop("place_")


def cascade(candidates: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """Tiers (exact before prepared before topical) filled up to k for each query; an item counts in its best tier."""
    once = candidates.groupBy(query, item).agg(F.min_by(F.struct("tier", "score"), F.struct("tier", -F.col("score"))).alias("t")).select(query, item, "t.tier", "t.score")
    rank = F.row_number().over(Window.partitionBy(query).orderBy("tier", F.desc("score"), item))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def latest(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """The last non-blank value of each key."""
    return rows.where(F.length(value) > 0).groupBy(key).agg(F.max_by(value, position).alias(value))
