"""Queries of evidence items, slots, noise, inspections, tasks, families and leaf profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import review
from threadloom.sources.tables import table

from .contract_queries import reviewed_bundles
from .evidence_queries import term_sources
from .registry import query

SAID = "CASE conv_id % 5 WHEN 0 THEN '用户喜欢的名字 ' || text WHEN 1 THEN text || ' 家人' WHEN 2 THEN '整理窗口 ' || text WHEN 3 THEN '协助 ' || text ELSE text END"


@query(f"""SELECT conv_id, turn, CASE WHEN regexp_matches({SAID}, '称呼|名字') THEN '名字与别名' WHEN regexp_matches({SAID}, '家人') THEN '关系与周边' WHEN regexp_matches({SAID}, '工作|协作|整理') THEN '工作与协作' ELSE '偏好与价值观' END AS user_slot,
  CASE WHEN regexp_matches({SAID}, '记忆|窗口') THEN '记忆治理' WHEN regexp_matches({SAID}, '整理|协助') THEN '协作与写作' ELSE '互动方式' END AS rule_slot FROM conversations""")
def line_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of lines about the user and of rules."""
    said = F.expr(SAID)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", review.user_slot(said).alias("user_slot"), review.rule_slot(said).alias("rule_slot"))


TRIGGER = "CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN 'slice ' || p_size WHEN 2 THEN CAST(p_size AS STRING) WHEN 3 THEN 'Chat Bundle ' || p_brand WHEN 4 THEN p_name || '__' || lpad(CAST(p_size AS STRING), 3, '0') WHEN 5 THEN '工作：' || p_name WHEN 6 THEN substring(p_name, 1, p_size % 4) WHEN 7 THEN 'Assistant' ELSE p_type || '→' || p_name END"


@query(rf"""WITH t AS (SELECT p_partkey, trim({TRIGGER}) AS t FROM part) SELECT p_partkey, length(t) <= 2 OR regexp_matches(t, '^(最软|最硬|日常|工作|顶回去)\s*[：:]') OR regexp_matches(lower(t), '^(user|assistant|tool)$') OR regexp_matches(t, '^\d{{1,3}}$') OR regexp_matches(lower(t), '^slice\s*\d+$') OR regexp_matches(lower(t), '^chat\s+bundle\b') OR regexp_matches(t, '__\d{{3,}}$') AS noisy FROM t""")
def trigger_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers that lead nowhere."""
    return table(spark, sf_dir, "part").select("p_partkey", review.noisy_trigger(F.expr(TRIGGER)).alias("noisy"))


@query(r"""WITH t AS (SELECT user_id, event_id, event_type || ' ' || (event_id % 13) AS t FROM events), k AS (SELECT user_id, min(event_id) AS pos, regexp_replace(t, ' \d{1,3}$', '') AS key FROM t GROUP BY user_id, 3),
  r AS (SELECT k.user_id, t.t AS trigger, row_number() OVER (PARTITION BY k.user_id ORDER BY pos) AS nth FROM k JOIN t ON t.event_id = k.pos) SELECT * FROM r WHERE nth <= 3""")
def user_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first three triggers, once for each semantic key (numbers aside)."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.concat("event_type", F.lit(" "), (F.col("event_id") % 13).cast("string")).alias("t")))).alias("x"))
    return review.clean_triggers(e.select("user_id", F.transform("x", lambda x: x["t"]).alias("ts")), "user_id", "ts", 3).withColumn("nth", F.col("nth").cast("long"))


def item_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The sources of query terms, with roles of facts, hints and related roots."""
    roots, facts, stable, families, personas, updates = term_sources(spark, sf_dir)
    facts = facts.withColumn("fact_role", F.when(F.col("place") == 1, "fingerprint_candidate").otherwise("stable_fact"))
    hint = roots.select("root", F.lit(0).alias("place"), F.when(F.col("root") % 2 == 0, "#关系/信任").otherwise("#时间").alias("tag"), F.concat(F.lit("effect "), (F.col("root") % 5).cast("string")).alias("effect"))
    related = roots.select("root", F.lit(0).alias("place"), F.concat(F.lit("R"), (F.col("root") % 3).cast("string")).alias("title"))
    return [roots, facts, stable, families, personas, updates, hint, hint, related]


@query("""WITH p AS (SELECT p_partkey AS k, p_name, p_type, p_brand, p_size, p_partkey % 4 IN (0, 3) AS r FROM part), n AS (SELECT p.*, i AS place FROM p, range(6) t(i)),
  e AS (SELECT k, 'root_name' AS kind, p_name || '（原名 ' || p_brand || '/B' || p_size || '）' AS text, CASE WHEN r THEN 0.76 ELSE 1.0 END AS weight, 0 AS place FROM p
    UNION ALL SELECT k, 'stable_fact', 'stable ' || place || '。' || p_type, CASE WHEN r THEN 0.84 ELSE 0.92 END, place FROM n
    UNION ALL SELECT k, CASE WHEN place = 1 THEN 'atomic_fingerprint' ELSE 'atomic_fact' END, p_name || '；says “hold ' || p_size || '”, at once', CASE WHEN place = 1 THEN CASE WHEN r THEN 0.58 ELSE 0.82 END ELSE CASE WHEN r THEN 0.98 ELSE 1.06 END END, place FROM n WHERE place < 3
    UNION ALL SELECT k, 'atomic_key', 'the ' || p_type || ' state of play ' || place, CASE WHEN r THEN 0.8 ELSE 0.48 END, place FROM n WHERE place < 3
    UNION ALL SELECT k, 'atomic_title', 'fact ' || place || ' of ' || p_brand, CASE WHEN r THEN 0.56 ELSE 0.42 END, place FROM n WHERE place < 3
    UNION ALL SELECT k, 'atomic_tag', t, CASE WHEN r THEN 0.44 ELSE 0.28 END, place FROM (SELECT n.*, unnest([lower(split_part(p_type, ' ', 1)), 'latenight']) AS t FROM n WHERE place < 3)
    UNION ALL SELECT k, 'update_summary', 'update ' || place || ' “' || p_brand || '” ' || p_type, CASE WHEN r THEN 0.46 ELSE 0.62 END, place FROM n WHERE place < 3
    UNION ALL SELECT k, 'family_anchor', CASE WHEN place = 0 THEN '李雷' ELSE '家族 ' || p_type || ' 长久以来的故事' END, CASE WHEN r THEN CASE WHEN place = 0 THEN 0.18 ELSE 0.64 END ELSE 0.76 END, place FROM n WHERE place < 2
    UNION ALL SELECT k, 'linked_persona', p_name || ' 人格的样子很长' || place, CASE WHEN r THEN CASE WHEN place = 0 THEN 0.16 ELSE 0.62 END ELSE 0.8 END, place FROM n WHERE place < 2
    UNION ALL SELECT k, 'linked_persona_tag', CASE WHEN place = 0 THEN '#人物/甲乙丙' ELSE '#关系/信任 早' END, CASE WHEN r THEN CASE WHEN place = 0 THEN 0.08 ELSE 0.22 END ELSE 0.36 END, place FROM n WHERE place < 2
    UNION ALL SELECT k, 'linked_persona_tag_semantic', CASE WHEN place = 0 THEN '甲乙丙' ELSE '信任早' END, CASE WHEN r THEN 0.34 ELSE 0.14 END, place FROM n WHERE place < 2
    UNION ALL SELECT k, h || '_hint', 'effect ' || (k % 5), CASE WHEN h = 'type' THEN CASE WHEN r THEN 0.46 ELSE 0.4 END ELSE CASE WHEN r THEN 0.18 ELSE 0.4 END END, 0 FROM p, (VALUES ('type'), ('leaf')) v(h)
    UNION ALL SELECT k, h || '_hint_tag', '#关系/信任', CASE WHEN h = 'type' THEN CASE WHEN r THEN 0.4 ELSE 0.34 END ELSE CASE WHEN r THEN 0.14 ELSE 0.34 END END, 0 FROM p, (VALUES ('type'), ('leaf')) v(h) WHERE k % 2 = 0
    UNION ALL SELECT k, h || '_hint_tag_semantic', CASE WHEN k % 2 = 0 THEN '信任' ELSE '时间' END, CASE WHEN h = 'type' THEN CASE WHEN r THEN 0.36 ELSE 0.2 END ELSE CASE WHEN r THEN 0.1 ELSE 0.18 END END, 0 FROM p, (VALUES ('type'), ('leaf')) v(h)
    UNION ALL SELECT k, 'related_root', 'R' || (k % 3), 0.58, 0 FROM p)
  SELECT k AS root, kind, text, CAST(weight AS DOUBLE) AS weight, CAST(place AS BIGINT) AS place FROM e""")
def root_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """evidence items of each root with their weights."""
    return review.evidence_items(*item_sources(spark, sf_dir))


_ROWS = "r AS (SELECT conv_id, role FROM conversations WHERE trim(text) <> ''), c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS u, count(*) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'system') AS s FROM r GROUP BY conv_id)"


@query(f"""WITH {_ROWS} SELECT conv_id, CASE WHEN conv_id % 5 = 1 THEN 'invalid_bundle' ELSE 'valid_bundle' END AS status, CASE WHEN conv_id % 5 = 1 THEN 'blocked_by_contract_errors' WHEN a + s > 0 THEN 'ready_with_review_ledgers' ELSE 'ready' END AS readiness,
  u AS accepted, s AS rejected, a AS hold, u AS spans, u AS bounded_spans, 0 AS cards_without_refs, conv_id % 5 <> 1 AS complete FROM c""")
def bundle_inspections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, readiness and counts of bundles."""
    return review.inspected(reviewed_bundles(spark, sf_dir), "conv_id", "json")[0]


@query(f"WITH {_ROWS} SELECT conv_id, 'rejected' AS ledger, 'system turn' AS reason, s AS n FROM c WHERE s > 0 UNION ALL SELECT conv_id, 'hold', 'assistant turn', a FROM c WHERE a > 0")
def ledger_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each ledger by reason."""
    return review.inspected(reviewed_bundles(spark, sf_dir), "conv_id", "json")[1]


@query("""WITH t AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'submitted' ELSE 'applied' END AS status, CASE WHEN event_type NOT IN ('click', 'view') THEN CAST(event_id % 7 AS VARCHAR) END AS done FROM events WHERE event_id % 3 <> 0 OR event_type <> 'click')
  SELECT user_id, coalesce(arg_min(event_id, event_id) FILTER (status = 'pending'), arg_min(event_id, event_id) FILTER (status = 'submitted')) AS next_task, CASE WHEN count(*) FILTER (status = 'pending') > 0 THEN 'pending' WHEN count(*) FILTER (status = 'submitted') > 0 THEN 'submitted' END AS next_status,
    (SELECT x.event_id FROM t x WHERE x.user_id = t.user_id AND x.done IS NOT NULL ORDER BY x.done DESC, x.event_id LIMIT 1) AS last_applied FROM t GROUP BY user_id""")
def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The task that comes next in each packet, and the one applied last."""
    e = table(spark, sf_dir, "events").where("event_id % 3 <> 0 OR event_type <> 'click'")
    status = F.when(F.col("event_type") == "click", "pending").when(F.col("event_type") == "view", "submitted").otherwise("applied")
    tasks = e.select("user_id", F.col("event_id").alias("task"), F.col("event_id").alias("place"), status.alias("status"), F.when(status == "applied", (F.col("event_id") % 7).cast("string")).alias("applied_at"))
    return review.next_tasks(tasks, "user_id")


def family_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviewed rows: families by customer, some by title only, some without."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("place"), F.when(c % 3 == 0, F.concat(F.lit("f"), (c % 50).cast("string"))).otherwise("").alias("family_id"), F.when(k % 7 == 0, "kin").otherwise(" ").alias("family_kind"), F.lit("").alias("family_anchor_id"),
        F.when(c % 3 < 2, F.concat(F.lit("Clan  "), (c % 20).cast("string"))).otherwise("").alias("family_title"), F.when(k % 5 == 0, "o_orderstatus").otherwise("").alias("family_reason"),
        F.when(F.col("o_orderstatus") == "F", "persona").when(F.col("o_orderstatus") == "O", "sql").otherwise("case").alias("layer"), F.concat(F.lit("file"), (k % 15).cast("string")).alias("source_file"), (k % 40).alias("row_no"), (k % 2).cast("string").alias("source_ref"),
    )


_FAMILIES = """r AS (SELECT o_orderkey AS place, CASE WHEN o_custkey % 3 = 0 THEN 'f' || (o_custkey % 50) ELSE '' END AS family_id, CASE WHEN o_orderkey % 7 = 0 THEN 'kin' END AS kind, CASE WHEN o_custkey % 3 < 2 THEN 'Clan  ' || (o_custkey % 20) ELSE '' END AS title, CASE WHEN o_orderkey % 5 = 0 THEN 'o_orderstatus' END AS reason,
    CASE o_orderstatus WHEN 'F' THEN 'persona' WHEN 'O' THEN 'sql' ELSE 'case' END AS layer, 'file' || (o_orderkey % 15) AS file, o_orderkey % 40 AS row_no, CAST(o_orderkey % 2 AS VARCHAR) AS ref FROM orders),
  k AS (SELECT *, CASE WHEN family_id <> '' THEN family_id WHEN title <> '' THEN 'family_title::' || lower(replace(title, ' ', '')) END AS key FROM r)"""


@query(f"""WITH {_FAMILIES}, l AS (SELECT key, list(layer ORDER BY p) AS layers FROM (SELECT key, layer, min(place) AS p FROM k WHERE key IS NOT NULL GROUP BY key, layer) GROUP BY key), f AS (SELECT key, list(file ORDER BY p)[1:12] AS files FROM (SELECT key, file, min(place) AS p FROM k WHERE key IS NOT NULL GROUP BY key, file) GROUP BY key)
  SELECT key, coalesce(arg_min(family_id, place) FILTER (family_id <> ''), '') AS family_id, coalesce(arg_min(kind, place) FILTER (kind IS NOT NULL), 'persona_sql_family') AS kind, '' AS anchor_id, coalesce(arg_min(title, place) FILTER (title <> ''), '') AS title, coalesce(arg_min(reason, place) FILTER (reason IS NOT NULL), '') AS reason,
    count(*) FILTER (layer = 'persona') AS persona_count, count(*) FILTER (layer = 'sql') AS sql_count, any_value(array_to_string(layers, '|')) AS layers, any_value(array_to_string(files, '|')) AS source_files FROM k JOIN l USING (key) JOIN f USING (key) GROUP BY key""")
def family_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with their first attributes, counts by layer, layers and files."""
    out = review.families(family_rows(spark, sf_dir).withColumn("family_reason", F.when(F.col("family_reason") != "", "o_orderstatus").otherwise("")))
    return out.select("key", "family_id", "kind", "anchor_id", "title", "reason", "persona_count", "sql_count", F.array_join("layers", "|").alias("layers"), F.array_join("source_files", "|").alias("source_files"))


@query(f"""WITH {_FAMILIES}, a AS (SELECT c_custkey AS asked, CASE WHEN c_custkey % 2 = 0 THEN 'f' || (c_custkey % 50) ELSE 'Clan  ' || (c_custkey % 20) END AS w FROM customer WHERE c_custkey % 20 = 0),
  m AS (SELECT *, CASE WHEN family_id <> '' THEN family_id ELSE title END AS own FROM r WHERE layer = 'persona') SELECT asked, family_id, file AS source_file, row_no, ref AS source_ref, min(place) AS place FROM a JOIN m ON a.w = m.own GROUP BY ALL""")
def linked_personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persona members of the families that every twentieth customer asks for, each once."""
    c = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(c.alias("asked"), F.when(c % 2 == 0, F.concat(F.lit("f"), (c % 50).cast("string"))).otherwise("").alias("family_id"), F.concat(F.lit("Clan  "), (c % 20).cast("string")).alias("family_title"))
    return review.linked_personas(asked, family_rows(spark, sf_dir)).select("asked", "family_id", "source_file", "row_no", "source_ref", "place")


@query("""WITH o AS (SELECT s_suppkey AS bot, s_name AS display_name, '' AS persona_summary, ['a', 'n' || (s_nationkey % 3)] AS style FROM supplier WHERE s_suppkey % 3 < 2), n AS (SELECT s_suppkey AS bot, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'new ' || s_name END AS display_name, 'sum' AS persona_summary, ['n1', 'b'] AS style FROM supplier WHERE s_suppkey % 3 > 0)
  SELECT bot, coalesce(nullif(n.display_name, ''), o.display_name, '') AS display_name, coalesce(nullif(n.persona_summary, ''), o.persona_summary, '') AS persona_summary, array_to_string(CASE WHEN o.bot IS NULL THEN n.style WHEN n.bot IS NULL THEN o.style WHEN o.style[2] = 'n1' THEN ['a', 'n1', 'b'] ELSE ['a', o.style[2], 'n1'] END, '|') AS style_notes FROM o FULL JOIN n USING (bot)""")
def leaf_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles after a merge: new scalars win where they say something, lists are joined to three entries."""
    s = table(spark, sf_dir, "supplier")
    none = F.array().cast("array<string>")
    old = s.where("s_suppkey % 3 < 2").select(F.col("s_suppkey").alias("bot"), F.col("s_name").alias("display_name"), F.lit("").alias("persona_summary"), F.array(F.lit("a"), F.concat(F.lit("n"), (F.col("s_nationkey") % 3).cast("string"))).alias("style_notes"), none.alias("memory_notes"), none.alias("prompt_fragments"))
    new = s.where("s_suppkey % 3 > 0").select(F.col("s_suppkey").alias("bot"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(F.concat(F.lit("new "), "s_name")).alias("display_name"), F.lit("sum").alias("persona_summary"), F.array(F.lit("n1"), F.lit("b")).alias("style_notes"), none.alias("memory_notes"), none.alias("prompt_fragments"))
    return review.merged_leaves(old, new, most=3).select("bot", "display_name", "persona_summary", F.array_join("style_notes", "|").alias("style_notes"))
