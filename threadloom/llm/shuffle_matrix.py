"""Exact uniform shuffle into shards by a hypergeometric communication matrix.

Rows fall into source buckets by a hash. How many rows each bucket gives to each shard is drawn
from the multivariate hypergeometric law with the exact shard sizes as margins; each bucket is permuted and cut by
those counts, the pieces are exchanged, and every shard is permuted again. Shard sizes differ by at most one.

The permutations are orders of seeded hashes of a row's contents and of its number in a checkpoint, so a recomputed task
deals the same rows to the same places, and repeated rows, were they a third of all, are spread like others. Large shards are permuted in blocks (a hash range each), so that no task holds a whole shard.

Defined results: null texts have no bytes and checksum 0; equal rows are told apart by their numbers only, and are
interchangeable; very long texts travel as their hash and size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import math
import random

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, table

BUCKET_ROWS, MOST_BUCKETS = 200_000, 4096


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` balls without return are good: inversion of the law outwards from its mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    left, down, up, p_down, p_up = rng.random() - at_mode, mode, mode, at_mode, at_mode
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up, left = up + 1, left - p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down, left = down - 1, left - p_down
            if left <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(sizes: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Row i, column j: how many of the ``sizes[i]`` rows of bucket i go to shard j; both margins are exact."""
    rng, room, out = random.Random(seed), list(shards), []
    for n in sizes:
        row, rest = [], sum(room)
        for j, free in enumerate(room):
            k = hypergeometric(rng, free, rest - free, n)
            row.append(k)
            rest, n, room[j] = rest - free, n - k, free - k
        out.append(row)
    return out


def deal(rows: DataFrame, shards: int, seed: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``shard`` and ``slot`` to rows that carry ``row_hash``, a 64-bit hash of their contents.

    The matrix has one row for each ``bucket_rows`` rows of input, 64 at least and ``MOST_BUCKETS`` at most, and ``shards``
    columns; that is all that the driver draws and all that is broadcast (1.3 MB at most for 40 shards). Larger inputs have
    larger buckets, which are sorted by way of spilling.
    """
    base = kept(rows.withColumn("nth_", F.monotonically_increasing_id()))  # kept, so a row's number stays as it is
    n = base.count()
    buckets = min(MOST_BUCKETS, max(64, math.ceil(n / bucket_rows)))
    base = base.withColumn("bucket_", F.pmod(F.xxhash64("row_hash", "nth_", F.lit(seed)), F.lit(buckets)))
    sizes = {r["bucket_"]: r["count"] for r in base.groupBy("bucket_").count().collect()}  # at most ``buckets`` rows
    ids = sorted(sizes)
    wanted = [n // shards + (j < n % shards) for j in range(shards)]
    drawn = communication_matrix([sizes[b] for b in ids], wanted, seed)
    text = json.dumps([{"bucket_": b, "ends_": list(itertools.accumulate(row))} for b, row in zip(ids, drawn, strict=True)])
    matrix = rows.sparkSession.range(1).select(F.inline(F.from_json(F.lit(text), "array<struct<bucket_: long, ends_: array<long>>>")))
    local = F.row_number().over(Window.partitionBy("bucket_").orderBy(F.xxhash64(F.lit(seed + 1), "row_hash", "nth_"), "row_hash"))
    sent = (
        base.withColumn("place_", local)
        .join(F.broadcast(matrix), "bucket_")
        .withColumn("shard", F.size(F.filter("ends_", lambda e: e < F.col("place_"))))
        .drop("ends_", "place_", "bucket_")
    )
    blocks = max(8, math.ceil(n / shards / bucket_rows))
    order = F.xxhash64(F.lit(seed + 2), "row_hash", "nth_")
    sent = kept(sent.withColumn("order_", order).withColumn("block_", F.floor((order / 2.0**64 + 0.5) * blocks)))
    ahead = sent.groupBy("shard", "block_").agg(F.count("*").alias("rows_")).withColumn(
        "start_", F.sum("rows_").over(Window.partitionBy("shard").orderBy("block_")) - F.col("rows_")
    ).drop("rows_")
    again = F.row_number().over(Window.partitionBy("shard", "block_").orderBy("order_", "row_hash"))
    return (
        sent.withColumn("place_", again).join(ahead, ["shard", "block_"])
        .withColumn("slot", F.col("start_") + F.col("place_") - 1).drop("order_", "block_", "place_", "start_", "nth_")
    )


def op6_shuffle_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64("doc_id", "text").alias("row_hash")
    )
    return deal(rows, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
