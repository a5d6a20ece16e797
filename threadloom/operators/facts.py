"""Facts of reviewed rows: what explicit values, pairs in texts and JSON profiles say about each of a row's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.parsing import json_blobs
from threadloom.functions.text import compact, distinct_compact, fact_key, first_text, key_values, safe_text, tokens, value_type


def canonical_key(source: Column, evidence: Column) -> Column:
    """The common name of a fact's key, from the row's key and the one that the evidence uses; else the row's."""
    s, e = fact_key(source), fact_key(evidence)
    both = F.concat_ws(" ", s, e)
    return (
        F.when(both.rlike("birthday|生日|诞生"), "birthday").when(both.rlike("mbti"), "mbti").when(both.rlike("binding|绑定") & both.rlike("target|对象|伴侣"), "binding_target")
        .when(both.rlike("name_meaning|名字寓意|命名意义"), "name_meaning").when(both.rlike("name") & ~both.rlike("meaning"), "name").otherwise(F.when(s != "", s).otherwise(e))
    )


def derived(rows: DataFrame, id_: str) -> DataFrame:
    """(id, nth, kind, source_key, fact_key, value, value_type, role, evidence): the facts of rows (fact_keys, fact_value, summary, stable_points, fact_role, value_type).

    For each key, in this order: the explicit value; pairs ``key = value`` of the two texts whose key holds the row's key or is held by it (if there are none, the only pair of a row
    with one key); what JSON profiles say of a name or type. Equal values of a key and role (by the first 48 compact letters) are one fact, that of the first kind.
    """
    keys = F.slice(distinct_compact(tokens("fact_keys", r"\s*[|,]\s*"), None), 1, 64)
    texts = distinct_compact(F.array(safe_text("summary"), safe_text("stable_points")), None)
    r = rows.withColumn("keys_", keys).withColumn("texts_", texts)
    r = r.withColumn("pairs_", F.flatten(F.transform("texts_", key_values))).withColumn("blobs_", F.concat(json_blobs(F.coalesce(F.get("texts_", 0), F.lit(""))), json_blobs(F.coalesce(F.get("texts_", 1), F.lit("")))))
    r = r.select(id_, "fact_value", "summary", "stable_points", "fact_role", "value_type", "pairs_", "blobs_", F.size("keys_").alias("n_"), F.posexplode("keys_").alias("k_", "key_"))
    own = fact_key("key_")

    def fact(rank: int, kind: str, name: Column, value: Column, evidence: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), name.alias("name"), safe_text(value).alias("value"), evidence.alias("evidence"))

    def pair(rank: int, kind: str, p: Column) -> Column:
        return fact(rank, kind, p["key"], p["value"], F.concat(p["key"], F.lit(" = "), p["value"]))

    def profile(blob: Column) -> Column:
        v = F.try_parse_json(blob)
        said = F.when(own.contains("mbti"), F.try_variant_get(v, "$.mbti", "string")).when(own.contains("name"), F.try_variant_get(v, "$.name", "string"))
        return fact(4, "json_profile", F.col("key_"), F.coalesce(said, F.lit("")), blob)

    explicit = F.array(fact(1, "explicit_value", F.col("key_"), F.col("fact_value"), first_text("summary", "stable_points")))
    matching = F.filter("pairs_", lambda p: own.contains(fact_key(p["key"])) | fact_key(p["key"]).contains(own))
    only = F.when((F.col("n_") == 1) & (F.size("pairs_") == 1), F.transform("pairs_", lambda p: pair(3, "only_pair", p))).otherwise(F.array().cast("array<struct<rank:int,kind:string,name:string,value:string,evidence:string>>"))
    r = r.withColumn("matching_", matching)
    found = F.concat(explicit, F.when(F.size("matching_") > 0, F.transform("matching_", lambda p: pair(2, "matching_pair", p))).otherwise(only), F.transform("blobs_", profile))
    facts = r.select(id_, "k_", "key_", "fact_role", "value_type", F.posexplode(F.filter(found, lambda x: x["value"] != "")).alias("at_", "x"))
    role = F.lower(safe_text("fact_role"))
    facts = facts.select(
        id_, F.struct("k_", "at_").alias("nth_"), F.col("x.kind").alias("kind"), F.col("key_").alias("source_key"), canonical_key(F.col("key_"), F.col("x.name")).alias("fact_key"), F.col("x.value").alias("value"),
        first_text(F.lower(F.coalesce("value_type", F.lit(""))), value_type("x.value")).alias("value_type"), F.when(role == "", "unknown").otherwise(role).alias("role"), F.col("x.evidence").alias("evidence"),
        fact_key("key_").alias("same_key_"), F.left(compact("x.value"), F.lit(48)).alias("same_value_"),
    )
    rest = ["kind", "source_key", "fact_key", "value", "value_type", "evidence"]
    once = facts.groupBy(id_, "same_key_", "same_value_", "role").agg(F.min_by(F.struct("nth_", *rest), "nth_").alias("f"))
    return once.select(id_, (F.col("f.nth_.k_") * 1_000_000 + F.col("f.nth_.at_")).cast("long").alias("nth"), *(f"f.{c}" for c in rest), "role")


def with_conflicts(facts: DataFrame) -> DataFrame:
    """Adds ``conflict``: whether stable facts give the key two values or more. Keys are counted, never gathered."""
    values = facts.where("role = 'stable_fact' AND fact_key <> ''").groupBy("fact_key").agg(F.count_distinct("value").alias("n_")).where("n_ > 1")
    return facts.join(values, "fact_key", "left").withColumn("conflict", F.col("n_").isNotNull()).drop("n_")
