"""Roots and entries: entries of one root merged into one, and merged entries into the roots that are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import distinct_exact, first_text, let, safe_text

#: Attributes that keep their first text, lists and how many values they keep (facts first, then provenance).
ATTRIBUTES = ["anchor_type", "canonical_name", "trunk", "secondary_slot", "slot_path", "slot_owner_hint"]
LISTS = {"stable_facts": 24, "source_batches": 24, "source_refs": 64, "source_windows": 64, "topic_ids": 32, "persona_refs": 32}
UPDATE = "struct<signature:string,first_seen_at:string,last_seen_at:string,conflict:boolean>"


def once(updates: Column) -> Column:
    """Updates of different signatures, the first of each, in order of the time they were first (or else last) seen; equal times as they stood."""
    order = F.array_sort(F.transform(updates, lambda u, i: F.struct(u["signature"].alias("s"), i.alias("i"), u.alias("u"))))
    heads = let(order, lambda e: F.array_compact(F.transform(e, lambda x, i: F.when((i == 0) | (F.get(e, i - 1)["s"] != x["s"]), x))))
    timed = F.transform(heads, lambda x: F.struct(first_text(x["u"]["first_seen_at"], x["u"]["last_seen_at"]).alias("t"), x["i"].alias("i"), x["u"].alias("u")))
    return F.transform(F.array_sort(timed), lambda x: x["u"])


def _dates(*cs: Column) -> Column:
    return F.filter(F.concat(*cs), lambda x: F.coalesce(x, F.lit("")) != "")


def merged_entries(entries: DataFrame) -> DataFrame:
    """One entry for each ``root_key`` of entries (root_key, place, ATTRIBUTES, first_seen_at, last_seen_at, LISTS, updates, conflict_hint).

    Attributes are the first that are not blank, lists the ordered distinct values up to their number, dates the earliest and latest (a missing last one is the first), conflicts hold if any does.
    """
    first = lambda c: F.coalesce(F.min_by(safe_text(c), F.when(safe_text(c) != "", F.col("place"))), F.lit("")).alias(c)
    listed = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(c).alias("v")))), lambda x: F.coalesce(x["v"], F.array().cast(entries.schema[c].dataType))))
    date = lambda f, c: F.coalesce(f(F.when(safe_text(c) != "", safe_text(c))), F.lit("")).alias(c)
    per = entries.groupBy("root_key").agg(*map(first, ATTRIBUTES), date(F.min, "first_seen_at"), date(F.max, "last_seen_at"), *(listed(c).alias(c) for c in LISTS), listed("updates").alias("updates"), F.max(F.coalesce("conflict_hint", F.lit(False))).alias("conflict_hint"))
    return per.select(
        "root_key", *ATTRIBUTES, "first_seen_at", first_text("last_seen_at", "first_seen_at").alias("last_seen_at"), *(F.slice(distinct_exact(F.col(c), None), 1, n).alias(c) for c, n in LISTS.items()), once(F.col("updates")).alias("updates"), "conflict_hint",
    )


def merged_roots(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Roots (as merged entries, with version_count) after entries, one for each root: (the same columns, version_count, branch_count, evolution_status, added_updates).

    What is there wins where it is not blank; updates that are new by signature are versions, and new facts without any new update are one; a new root begins with as many versions as it has updates, one at least.
    A root without an entry stays as it is.
    """
    old = existing.select("root_key", *(F.col(c).alias(f"{c}_") for c in existing.columns if c != "root_key"), F.lit(True).alias("there"))
    new = incoming.withColumn("comes", F.lit(True))
    both = old.join(new, "root_key", "full").withColumn("there", F.coalesce("there", F.lit(False))).withColumn("comes", F.coalesce("comes", F.lit(False)))
    none, no_updates = F.array().cast("array<string>"), F.array().cast(f"array<{UPDATE}>")
    both = both.withColumn("before", once(F.coalesce("updates_", no_updates))).withColumn("all_updates", once(F.concat(F.coalesce("updates_", no_updates), F.coalesce("updates", no_updates))))
    lists = {c: F.slice(distinct_exact(F.concat(F.coalesce(f"{c}_", none), F.coalesce(c, none)), None), 1, n) for c, n in LISTS.items()}
    both = both.withColumns({f"{c}_now": v for c, v in lists.items()})
    seen = lambda c: F.transform("all_updates", lambda u: u[c])
    added = F.size("all_updates") - F.size("before")
    grown = F.greatest(F.lit(0), F.size("stable_facts_now") - F.size(F.slice(distinct_exact(F.coalesce("stable_facts_", none), None), 1, LISTS["stable_facts"])))
    base = F.greatest(F.coalesce("version_count_", F.lit(0)), F.lit(1))
    versions = F.when(F.col("there"), base + added + F.when((added == 0) & (grown > 0), 1).otherwise(0)).otherwise(F.greatest(base, F.size("all_updates")))
    evolution = F.when(F.size("all_updates") >= 2, "updated").when(F.size("stable_facts_now") > 0, "stable").otherwise("volatile")
    return both.select(
        "root_key", *(first_text(f"{c}_", c).alias(c) for c in ATTRIBUTES),
        F.coalesce(F.array_min(_dates(F.array("first_seen_at_", "first_seen_at"), seen("first_seen_at"))), F.lit("")).alias("first_seen_at"), F.coalesce(F.array_max(_dates(F.array("last_seen_at_", "last_seen_at"), seen("last_seen_at"))), F.lit("")).alias("last_seen_at"),
        *(F.col(f"{c}_now").alias(c) for c in LISTS), F.col("all_updates").alias("updates"),
        (F.coalesce("conflict_hint_", F.lit(False)) | F.coalesce("conflict_hint", F.lit(False)) | F.exists("all_updates", lambda u: F.coalesce(u["conflict"], F.lit(False)))).alias("conflict_hint"),
        versions.cast("int").alias("version_count"), F.size("all_updates").alias("branch_count"), evolution.alias("evolution_status"), F.when(F.col("there"), added).otherwise(F.size("all_updates")).alias("added_updates"),
    )
