"""Queries of roots: customers are roots, orders their entries; those of odd numbers were there before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import roots
from threadloom.sources.tables import table

from .registry import query


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd")
    month = F.left(day, F.lit(7))
    update = F.struct(F.concat_ws("::", month, "o_orderstatus").alias("signature"), F.when(k % 4 == 0, "").otherwise(month).alias("first_seen_at"), month.alias("last_seen_at"), (k % 50 == 0).alias("conflict"))
    none = F.array().cast("array<string>")
    return o.select(
        F.col("o_custkey").alias("root_key"), k.alias("place"), F.lit("person").alias("anchor_type"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("N"), (k % 5).cast("string"))).alias("canonical_name"), F.lit("t").alias("trunk"),
        F.lit("").alias("secondary_slot"), F.when(k % 7 == 0, F.col("o_orderpriority")).otherwise("").alias("slot_path"), F.lit("").alias("slot_owner_hint"), day.alias("first_seen_at"), F.when(k % 2 == 0, day).otherwise("").alias("last_seen_at"),
        F.array("o_orderpriority", F.lit("all")).alias("stable_facts"), F.array(month).alias("source_batches"), *(none.alias(c) for c in ("source_refs", "source_windows", "topic_ids", "persona_refs")), F.array(update).alias("updates"), (k % 97 == 0).alias("conflict_hint"),
    )


_ENTRIES = """o AS (SELECT o_custkey AS root, o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS st, o_orderpriority AS pr, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'N' || (o_orderkey % 5) END AS name, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE '' END AS slot FROM orders)"""


def _merged(which: str) -> str:
    """Facts, updates and the rest of the merged entry of each root over some orders."""
    return f"""(SELECT root, coalesce(arg_min(name, k) FILTER (name <> ''), '') AS name, coalesce(arg_min(slot, k) FILTER (slot <> ''), '') AS slot, min(day) AS first, coalesce(max(day) FILTER (k % 2 = 0), min(day)) AS last, bool_or(k % 97 = 0) AS conflict FROM o WHERE {which} GROUP BY root)"""


def _list(of: str, order: str) -> str:
    return f"list({of} ORDER BY {order})"


@query(f"""WITH {_ENTRIES}, m AS {_merged("true")}, f AS (SELECT root, string_agg(v, '|' ORDER BY p, i) AS facts FROM (SELECT root, v, min(k) AS p, arg_min(i, k) AS i FROM (SELECT root, k, unnest([pr, 'all']) AS v, unnest([1, 2]) AS i FROM o) GROUP BY root, v) GROUP BY root),
  s AS (SELECT root, month || '::' || st AS sig, arg_min(month, k) AS t, min(k) AS p FROM o GROUP BY root, 2), u AS (SELECT root, string_agg(sig, '|' ORDER BY t, p) AS sigs FROM s GROUP BY root)
  SELECT root AS root_key, name AS canonical_name, slot AS slot_path, first AS first_seen_at, last AS last_seen_at, facts AS stable_facts, sigs AS updates, conflict AS conflict_hint FROM m JOIN f USING (root) JOIN u USING (root)""")
def entry_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of each root as one."""
    m = roots.merged_entries(entries(spark, sf_dir))
    return m.select("root_key", "canonical_name", "slot_path", "first_seen_at", "last_seen_at", F.array_join("stable_facts", "|").alias("stable_facts"), F.array_join(F.transform("updates", lambda u: u["signature"]), "|").alias("updates"), "conflict_hint")


@query(f"""WITH {_ENTRIES}, a AS {_merged("k % 2 = 1")}, b AS {_merged("k % 2 = 0")}, s AS (SELECT root, month || '::' || st AS sig, bool_or(k % 2 = 1) AS was, max(k % 50 = 0) AS any_c, coalesce(arg_min(k % 50 = 0, k) FILTER (k % 2 = 1), arg_min(k % 50 = 0, k)) AS c, coalesce(arg_min(month, k) FILTER (k % 2 = 1), arg_min(month, k)) AS t,
    coalesce(arg_min(CASE WHEN k % 4 = 0 THEN '' ELSE month END, k) FILTER (k % 2 = 1), arg_min(CASE WHEN k % 4 = 0 THEN '' ELSE month END, k)) AS fs FROM o GROUP BY root, 2),
  u AS (SELECT root, count(*) AS n, count(*) FILTER (was) AS n_was, bool_or(c) AS c, min(fs) FILTER (fs <> '') AS f, max(t) AS l FROM s GROUP BY root), g AS (SELECT root, count(DISTINCT pr) + 1 AS n, count(DISTINCT pr) FILTER (k % 2 = 1) + (count(*) FILTER (k % 2 = 1) > 0)::INT AS n_was FROM o GROUP BY root)
  SELECT u.root AS root_key, CASE WHEN coalesce(a.name, '') <> '' THEN a.name ELSE coalesce(b.name, '') END AS canonical_name, least(coalesce(a.first, b.first), coalesce(b.first, a.first), coalesce(u.f, '9')) AS first_seen_at, greatest(coalesce(a.last, ''), coalesce(b.last, ''), u.l) AS last_seen_at, u.n AS branch_count,
    CASE WHEN a.root IS NOT NULL THEN greatest(u.n_was, 1) + (u.n - u.n_was) + CASE WHEN u.n = u.n_was AND b.root IS NOT NULL AND g.n > g.n_was THEN 1 ELSE 0 END ELSE u.n END AS version_count, CASE WHEN u.n >= 2 THEN 'updated' ELSE 'stable' END AS evolution_status,
    CASE WHEN a.root IS NOT NULL THEN u.n - u.n_was ELSE u.n END AS added_updates, coalesce(a.conflict, false) OR coalesce(b.conflict, false) OR u.c AS conflict_hint FROM u JOIN g USING (root) LEFT JOIN a ON a.root = u.root LEFT JOIN b ON b.root = u.root""")
def root_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots that are there, from orders of odd numbers, after the entries of even ones."""
    e = entries(spark, sf_dir)
    old = roots.merged_entries(e.where("place % 2 = 1"))
    old = old.withColumn("version_count", F.greatest(F.size("updates"), F.lit(1)))
    out = roots.merged_roots(old, roots.merged_entries(e.where("place % 2 = 0")))
    longs = [F.col(c).cast("long").alias(c) for c in ("branch_count", "version_count", "added_updates")]
    return out.select("root_key", "canonical_name", "first_seen_at", "last_seen_at", *longs, "evolution_status", "conflict_hint")
