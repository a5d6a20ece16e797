"""Lineage of facts: the census of a scope's messages, references to them, whose words a fact rests on, and the geometry of reviewed rows.

References are ``window_<date>_<window>_msg_<number>``, several joined by `` | ``. A fact's references meet the census by (scope, window, number), so no scope is gathered;
what comes back are states, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import WHITE, compact, safe_text

#: The grammar of references, with and without a window.
BOUND, LEGACY = r"^window_(\d{8})_(.+)_msg_(\d+)$", r"^window_(\d{8})_msg_(\d+)$"
GOOD = ["source_role_lineage_exact", "source_subject_role_other"]


def census(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of messages (scope, window, msg_index, role): (scope, window, msg_index, role) of each message once, and (scope, n_messages, n_windows, n_invalid, n_duplicates, complete) of each scope.

    A message without window, role or a number of 1 and more is invalid; a second one of the same place is a duplicate, whatever its role. Either leaves a scope incomplete.
    """
    m = messages.select("scope", safe_text("window").alias("window"), F.col("msg_index").cast("long").alias("msg_index"), F.lower(safe_text("role")).alias("role"))
    valid = F.coalesce((F.col("window") != "") & (F.col("msg_index") > 0) & (F.col("role") != ""), F.lit(False))
    places = m.where(valid).groupBy("scope", "window", "msg_index").agg(F.min("role").alias("role"), F.count("*").alias("n"))
    held = places.groupBy("scope").agg(F.sum("n").alias("n"), F.count_distinct("window").alias("n_windows"), F.sum(F.col("n") - 1).alias("n_duplicates"))
    total = m.groupBy("scope").agg(F.count("*").alias("n_messages"), F.count_if(~valid).alias("n_invalid")).join(held, "scope", "left").fillna(0, ["n", "n_windows", "n_duplicates"])
    return places.drop("n"), total.select("scope", "n_messages", "n_windows", "n_invalid", "n_duplicates", ((F.col("n_invalid") == 0) & (F.col("n_duplicates") == 0) & (F.col("n_messages") > 0)).alias("complete"))


def references(c: Column) -> Column:
    """(ref, kind, date, window, msg_index) of each reference: ``bound``, ``unbound`` (without a window) or ``invalid``."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), rf"[{WHITE}]*\|[{WHITE}]*"), safe_text), lambda x: x != "")
    kind = lambda x: F.when(x.rlike(LEGACY), "unbound").when(x.rlike(BOUND), "bound").otherwise("invalid")
    pick = lambda x, k, j: F.when(x.rlike(LEGACY), F.regexp_extract(x, LEGACY, j) if j else F.lit("")).when(x.rlike(BOUND), F.regexp_extract(x, BOUND, k)).otherwise("")
    return F.transform(parts, lambda x: F.struct(x.alias("ref"), kind(x).alias("kind"), pick(x, 1, 1).alias("date"), pick(x, 2, 0).alias("window"), pick(x, 3, 2).try_cast("long").alias("msg_index")))


def subject(explicit: Column, key: Column, anchor: Column, user: Column, bot: Column) -> Column:
    """Whom a fact is about: what the row says, else its key's beginning or its anchor; ``conflict`` if the row says other than these; empty if nothing tells."""
    said, k, a = F.lower(safe_text(explicit)), F.lower(safe_text(key)), compact(anchor)
    told = F.when(k.startswith("user_") | ((a != "") & (a == compact(user))), "user").when(k.startswith("assistant_") | k.startswith("bot_") | ((a != "") & (a == compact(bot))), "assistant").otherwise("")
    return F.when((said != "") & (told != "") & (said != told), "conflict").when(said != "", said).otherwise(told)


def lineage(facts: DataFrame, messages: DataFrame) -> DataFrame:
    """(fact_id, status, primary_role, ok) of facts (fact_id, scope, fact_key, anchor_name, subject_role, window, source_ref, user_name, bot_name).

    In this order: the scope's census must be complete, the window known (or the scope's only one), references readable, bound to that window and in the census; then whom the fact is about must be told, and the first
    reference, the primary one, must be a message of that role. A fact about others rests on any role.
    """
    places, scopes = census(messages)
    one = places.groupBy("scope").agg(F.min("window").alias("only_"))
    windows = places.select("scope", F.col("window").alias("own_window"), F.lit(True).alias("known_window")).distinct()
    f = facts.withColumn("said_window", safe_text("window")).join(scopes.select("scope", "complete", "n_windows"), "scope", "left").join(one, "scope", "left")
    f = f.withColumn("own_window", F.when((F.col("said_window") == "") & (F.col("n_windows") == 1), F.col("only_")).otherwise(F.col("said_window"))).join(windows, ["scope", "own_window"], "left")
    f = f.withColumn("refs", references(F.col("source_ref"))).withColumn("about", subject(F.col("subject_role"), F.col("fact_key"), F.col("anchor_name"), F.col("user_name"), F.col("bot_name")))
    each = f.select("fact_id", "scope", F.posexplode("refs").alias("nth", "r")).select("fact_id", "scope", "nth", F.col("r.window").alias("window"), F.col("r.msg_index").alias("msg_index"))
    met = each.join(places, ["scope", "window", "msg_index"], "left").groupBy("fact_id").agg(F.min_by("role", "nth").alias("primary_role"), F.count_if(F.col("role").isNull()).alias("n_away"))
    has = lambda kind: F.exists("refs", lambda r: r["kind"] == kind)
    about = F.col("about")
    status = (
        F.when(~F.coalesce("complete", F.lit(False)), "source_role_census_incomplete").when((F.col("said_window") == "") & (F.col("n_windows") > 1), "source_window_ambiguous").when(F.col("known_window").isNull(), "source_window_invalid")
        .when((F.size("refs") == 0) | has("invalid"), "source_ref_invalid").when(has("unbound"), "source_ref_window_unbound").when(F.exists("refs", lambda r: r["window"] != F.col("own_window")), "source_ref_window_mismatch")
        .when(F.col("n_away") > 0, "source_ref_outside_census").when(about == "conflict", "source_subject_role_conflict").when(about == "", "source_subject_role_unknown").when(about == "other", "source_subject_role_other")
        .when(F.col("primary_role") == about, "source_role_lineage_exact").otherwise("source_primary_role_mismatch")
    )
    out = f.join(met, "fact_id", "left").select("fact_id", status.alias("status"), F.coalesce("primary_role", F.lit("")).alias("primary_role"))
    return out.withColumn("ok", F.col("status").isin(*GOOD))


def geometry(ref: Column, date: Column, window: Column, first: Column, last: Column) -> Column:
    """(status, n_refs, ok): whether a reviewed row's references stay inside its prepared source (date, window, first and last number); a row without references is fine."""
    refs = references(ref)
    off = lambda cond: F.exists(refs, cond)
    status = (
        F.when(F.size(refs) == 0, "source_ref_blank").when(off(lambda r: r["kind"] != "bound"), "source_ref_invalid").when(off(lambda r: r["date"] != date), "source_ref_scope_mismatch")
        .when(off(lambda r: r["window"] != window), "source_ref_window_mismatch").when(off(lambda r: ~r["msg_index"].between(first, last)), "source_ref_outside_range").otherwise("source_ref_geometry_exact")
    )
    return F.struct(status.alias("status"), F.size(refs).alias("n_refs"), status.isin("source_ref_blank", "source_ref_geometry_exact").alias("ok"))


def partitioned(rows: DataFrame, meta: list[str], ref: str = "declared_ref") -> tuple[DataFrame, DataFrame]:
    """Rows that are accepted, with the first reference's window and the source's range, and holds (id, status) without any text. ``meta``: columns of date, window, first and last number."""
    told = rows.withColumn("g_", geometry(F.col(ref), *(F.col(c) for c in meta)))
    return told.where("g_.ok").drop("g_"), told.where("NOT g_.ok").select("id", "g_.status")
