"""Queries of lineage: conversations are windows, four to a scope of which some are incomplete; each message has a fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import lineage
from threadloom.sources.tables import table

from .registry import query


def census_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by scope (conversations by fours); one scope in five has a message twice, another one a message without a window; one in seven has one window only."""
    c = table(spark, sf_dir, "conversations")
    scope = F.expr("conv_id div 4")
    m = c.select(scope.alias("scope"), F.when((scope % 5 == 2) & (F.col("turn") == 0), "").otherwise(F.concat(F.lit("w"), F.col("conv_id").cast("string"))).alias("window"), (F.col("turn") + 1).alias("msg_index"), "role", "conv_id")
    m = m.where((scope % 7 != 3) | (F.col("conv_id") % 4 == 0))
    return m.unionByName(m.where("scope % 5 = 1 AND msg_index = 2")).drop("conv_id")


def lineage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact of each message: about the user, the companion, others or nobody, with references that are right or wrong in some way."""
    c = table(spark, sf_dir, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    n, own = F.lpad((t + 1).cast("string"), 3, "0"), F.concat(F.lit("w"), k.cast("string"))
    ref = lambda w, i: F.concat(F.lit("window_20250201_"), w, F.lit("_msg_"), i)
    h = (k * 3 + t) % 9
    refs = (
        F.when(h == 0, "PRIVATE").when(h == 1, F.concat(F.lit("window_20250201_msg_"), n)).when(h == 2, ref(F.lit("w999999"), n)).when(h == 3, ref(own, F.lit("900"))).when(h == 4, F.concat(ref(own, n), F.lit(" | "), ref(own, F.lit("001"))))
        .when(h == 5, F.concat(ref(own, F.lit("001")), F.lit("|"), ref(own, n))).when(h == 6, " ").otherwise(ref(own, n))
    )
    return c.select(
        (k * 100 + t).alias("fact_id"), F.expr("conv_id div 4").alias("scope"), F.when(t % 4 == 3, "weather_state").otherwise(F.concat(F.when(t % 4 == 1, "assistant").otherwise("user"), F.lit("_likes"))).alias("fact_key"),
        F.when(k % 6 == 1, "A Yuan").otherwise("x").alias("anchor_name"), F.when((t % 4 == 3) & (k % 2 == 0), "Other").otherwise("").alias("subject_role"), F.when((k + t) % 8 == 5, " ").when((k + t) % 8 == 6, "w_away").otherwise(own).alias("window"),
        refs.alias("source_ref"), F.lit("ayuan").alias("user_name"), F.lit("Companion").alias("bot_name"),
    )


_CENSUS = """m0 AS (SELECT conv_id // 4 AS scope, CASE WHEN (conv_id // 4) % 5 = 2 AND turn = 0 THEN '' ELSE 'w' || conv_id END AS w, turn + 1 AS i, role FROM conversations WHERE (conv_id // 4) % 7 <> 3 OR conv_id % 4 = 0),
  m AS (SELECT * FROM m0 UNION ALL SELECT * FROM m0 WHERE scope % 5 = 1 AND i = 2), p AS (SELECT scope, w, i, min(role) AS role, count(*) AS n FROM m WHERE w <> '' GROUP BY scope, w, i),
  s AS (SELECT m.scope, count(*) AS n_messages, (SELECT count(DISTINCT w) FROM p WHERE p.scope = m.scope) AS n_windows, count(*) FILTER (w = '') AS n_invalid, coalesce((SELECT sum(n - 1) FROM p WHERE p.scope = m.scope), 0)::BIGINT AS n_duplicates FROM m GROUP BY m.scope)"""


@query(f"WITH {_CENSUS} SELECT *, n_invalid = 0 AND n_duplicates = 0 AS complete FROM s")
def source_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The census of messages of each scope."""
    return lineage.census(census_messages(spark, sf_dir))[1]


@query(f"""WITH {_CENSUS}, f AS (SELECT *, conv_id * 100 + turn AS fact_id, conv_id // 4 AS scope, (conv_id * 3 + turn) % 9 AS h, 'w' || conv_id AS own, CASE (conv_id + turn) % 8 WHEN 5 THEN '' WHEN 6 THEN 'w_away' ELSE 'w' || conv_id END AS said FROM conversations),
  g AS (SELECT f.*, s.n_windows, s.n_invalid = 0 AND s.n_duplicates = 0 AS complete, CASE WHEN said = '' AND s.n_windows = 1 THEN (SELECT min(w) FROM p WHERE p.scope = f.scope) ELSE said END AS win FROM f LEFT JOIN s ON f.scope = s.scope),
  r AS (SELECT fact_id, scope, unnest(CASE h WHEN 0 THEN ['?'] WHEN 1 THEN [''] WHEN 2 THEN ['w999999'] WHEN 4 THEN [own, own] WHEN 5 THEN [own, own] WHEN 6 THEN [] ELSE [own] END) AS w, unnest(CASE h WHEN 0 THEN [NULL] WHEN 1 THEN [turn + 1] WHEN 2 THEN [turn + 1] WHEN 3 THEN [900] WHEN 4 THEN [turn + 1, 1] WHEN 5 THEN [1, turn + 1] WHEN 6 THEN [] ELSE [turn + 1] END) AS i,
    unnest(CASE WHEN h IN (4, 5) THEN [1, 2] WHEN h = 6 THEN [] ELSE [1] END) AS nth FROM f),
  t AS (SELECT r.fact_id, max(p.role) FILTER (nth = 1) AS first_role, count(*) FILTER (p.role IS NULL) AS away FROM r LEFT JOIN p ON r.scope = p.scope AND r.w = p.w AND r.i = p.i GROUP BY r.fact_id),
  a AS (SELECT g.*, t.first_role, t.away, EXISTS (SELECT 1 FROM p WHERE p.scope = g.scope AND p.w = g.win) AS known, CASE WHEN turn % 4 IN (0, 2) OR conv_id % 6 = 1 THEN 'user' WHEN turn % 4 = 1 THEN 'assistant' ELSE '' END AS told, turn % 4 = 3 AND conv_id % 2 = 0 AS other FROM g LEFT JOIN t USING (fact_id)),
  o AS (SELECT fact_id, coalesce(first_role, '') AS primary_role, CASE WHEN NOT coalesce(complete, false) THEN 'source_role_census_incomplete' WHEN said = '' AND n_windows > 1 THEN 'source_window_ambiguous' WHEN NOT known THEN 'source_window_invalid' WHEN h IN (0, 6) THEN 'source_ref_invalid' WHEN h = 1 THEN 'source_ref_window_unbound'
    WHEN h = 2 OR own <> win THEN 'source_ref_window_mismatch' WHEN away > 0 THEN 'source_ref_outside_census' WHEN other AND told <> '' THEN 'source_subject_role_conflict' WHEN other THEN 'source_subject_role_other' WHEN told = '' THEN 'source_subject_role_unknown' WHEN first_role = told THEN 'source_role_lineage_exact' ELSE 'source_primary_role_mismatch' END AS status FROM a)
  SELECT *, status IN ('source_role_lineage_exact', 'source_subject_role_other') AS ok FROM o""")
def fact_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each fact rests on a message of the one whom it is about."""
    return lineage.lineage(lineage_facts(spark, sf_dir), census_messages(spark, sf_dir))


@query("""WITH f AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, (conv_id + turn) % 6 AS h FROM conversations)
  SELECT id, CASE h WHEN 0 THEN 'source_ref_blank' WHEN 1 THEN 'source_ref_invalid' WHEN 2 THEN 'source_ref_scope_mismatch' WHEN 3 THEN 'source_ref_window_mismatch' ELSE CASE WHEN turn + 1 > 4 OR (h = 5 AND turn + 2 > 4) THEN 'source_ref_outside_range' ELSE 'source_ref_geometry_exact' END END AS status FROM f""")
def reference_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of reviewed rows against the first four messages of their window."""
    c = table(spark, sf_dir, "conversations")
    k, t = F.col("conv_id"), F.col("turn")
    ref = lambda d, w, i: F.concat(F.lit(f"window_{d}_w"), w.cast("string"), F.lit("_msg_"), F.lpad(i.cast("string"), 3, "0"))
    h = (k + t) % 6
    said = F.when(h == 0, "").when(h == 1, "BODY").when(h == 2, ref("19990101", k, t + 1)).when(h == 3, ref("20250201", k + 1, t + 1)).when(h == 4, ref("20250201", k, t + 1)).otherwise(F.concat(ref("20250201", k, t + 1), F.lit(" | "), ref("20250201", k, t + 2)))
    rows = c.select((k * 100 + t).alias("id"), said.alias("declared_ref"), F.lit("20250201").alias("date"), F.concat(F.lit("w"), k.cast("string")).alias("window"), F.lit(1).alias("first"), F.lit(4).alias("last"))
    accepted, holds = lineage.partitioned(rows, ["date", "window", "first", "last"])
    status = accepted.select("id", F.when(F.col("declared_ref") == "", "source_ref_blank").otherwise("source_ref_geometry_exact").alias("status"))
    return status.unionByName(holds)
