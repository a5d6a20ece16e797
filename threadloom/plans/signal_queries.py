"""Queries of scores, classes, hints and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import parsing, text
from threadloom.operators import signals
from threadloom.sources.tables import table

from .registry import query


@query(r"""WITH d AS (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' sk-' || repeat('a_', 11) WHEN 1 THEN ' /home/me/x' WHEN 2 THEN ' C:\keys ' ELSE '' END AS t FROM documents),
  h AS (SELECT doc_id, CASE WHEN regexp_matches(t, 'sk-[A-Za-z0-9_-]{20,}') THEN 'secret_like_api_key'
    WHEN regexp_matches(t, '/(?:Users|home|srv)/[^\s"''`]+|[A-Za-z]:[\\/][^\s"''`]+|\\\\[^\\\s"''`]+\\[^\\\s"''`]+') THEN 'absolute_private_path' END AS reason FROM d)
  SELECT * FROM h WHERE reason IS NOT NULL""")
def privacy_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key-like strings and private paths."""
    k = F.col("doc_id") % 4
    tail = F.when(k == 0, " sk-" + "a_" * 11).when(k == 1, " /home/me/x").when(k == 2, " C:\\keys ").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", signals.privacy_hit(F.concat("text", tail)).alias("reason")).where("reason IS NOT NULL")


@query(r"SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), '\b(user|assistant|tool|chat|bundle)\b', ' ', 'g'), '\b\d{1,3}\b', ' ', 'g'), '[·:：,，、;；.。!?！？\"''“”‘’()\[\]{}<>《》【】/\\_-]+', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM benchmark")
def semantic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F36."""
    return table(spark, sf_dir, "benchmark").select("item_id", signals.semantic_key("text").alias("key"))


NEEDLES = ["the", "of", "tion", "qu"]


@query(r"WITH c AS (SELECT conv_id, turn, regexp_replace(lower(text), '[\s\p{P}\p{S}]+', '', 'g') AS t FROM conversations) SELECT conv_id, turn, CAST(2 * CAST(contains(t, 'the') AS INT) + CAST(contains(t, 'of') AS INT) + 2 * CAST(contains(t, 'tion') AS INT) + CAST(contains(t, 'qu') AS INT) AS BIGINT) AS points FROM c")
def needle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F32: weighted needles in text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", signals.needle_score(F.col("text"), NEEDLES).cast("long").alias("points"))


SAID = "CASE event_id % 9 WHEN 0 THEN 'create' WHEN 1 THEN ' Patch' WHEN 2 THEN 'REVISE' WHEN 3 THEN 'merge_into ' WHEN 4 THEN 'hold' WHEN 5 THEN 'archive' WHEN 6 THEN 'rewrite_card' WHEN 7 THEN substring(event_type, 1, user_id % 2) ELSE upper(event_type) END"
_DECIDED = " ".join(f"WHEN d IN ({', '.join(repr(a) for a in names)}) THEN '{name}'" for name, names in signals.DECISIONS.items())


@query(f"""WITH t AS (SELECT event_id, lower(trim({SAID})) AS d FROM events) SELECT event_id, CASE {_DECIDED} WHEN d = '' THEN 'touch' ELSE d END AS decision FROM t""")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases of decisions; another word stays as it is."""
    return table(spark, sf_dir, "events").select("event_id", signals.decision(F.expr(SAID)).alias("decision"))


@query("""WITH d AS (SELECT doc_id, length(text) AS n, doc_id % 3 = 0 AS chat FROM documents), t AS (SELECT *, CASE WHEN chat THEN CASE WHEN n > 18000 THEN 2400 WHEN n > 9000 THEN 2200 ELSE 1800 END ELSE CASE WHEN n > 18000 THEN 3200 WHEN n > 9000 THEN 2800 ELSE 2200 END END AS target FROM d)
  SELECT doc_id, CAST(target AS BIGINT) AS target_chars, CAST(CASE WHEN chat THEN 2 ELSE 1 END AS BIGINT) AS max_slices, CAST(target * CASE WHEN chat THEN 2 ELSE 1 END + 600 AS BIGINT) AS max_chars, CAST(CASE WHEN n > 0 THEN greatest(1, ceil(n / target)) ELSE 0 END AS BIGINT) AS estimated_slices FROM t""")
def chunk_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P26."""
    plan = signals.chunk_plan(F.col("doc_id") % 3 == 0, F.length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", *(c.cast("long").alias(k) for k, c in plan.items()))


@query("""WITH p AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b, count(*) FILTER (event_type = 'error') AS c, count(*) FILTER (event_type = 'signup') AS d,
    count(*) FILTER (value > 100) AS e, count(*) FILTER (value < 20) AS f, max(value) > 400 AS w, count(*) FILTER (value > 250) AS shadows FROM events GROUP BY user_id),
  s AS (SELECT *, round(least(1.0, 0.14 * (a / n) + 0.18 * (b / n) + 0.24 * (c / n) + 0.18 * (d / n) + 0.08 * (e / n) + 0.06 * (f / n) + CASE WHEN w THEN 0.18 ELSE 0 END), 4)::DOUBLE AS score,
    CAST(a / n >= 0.18 AS INT) + CAST(b / n >= 0.18 AS INT) + CAST(c / n >= 0.18 AS INT) + CAST(d / n >= 0.18 AS INT) + CAST(e / n >= 0.18 AS INT) + CAST(f / n >= 0.18 AS INT) + CAST(w AS INT) AS hits FROM p)
  SELECT user_id, score, CAST(hits AS BIGINT) AS support_hits, CASE WHEN shadows = 0 THEN 'no_shadow' WHEN (score >= 0.4 AND hits >= 2) OR score >= 0.55 OR (w AND score >= 0.32 AND hits >= 2) THEN 'aligned'
    WHEN (score >= 0.22 AND hits >= 1) OR score >= 0.3 OR (w AND hits >= 1) THEN 'partial' ELSE 'weak' END AS class FROM s""")
def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of six kinds and an equal window, weighted and classed."""
    share = lambda c: F.count_if(c) / F.count("*")
    is_a, v = (lambda t: F.col("event_type") == t), F.col("value")
    kinds = dict(zip(signals.EVIDENCE, map(share, (is_a("click"), is_a("view"), is_a("error"), is_a("signup"), v > 100, v < 20)), strict=True))
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(*(c.alias(k) for k, c in kinds.items()), (F.max("value") > 400).alias("w"), F.count_if(v > 250).alias("shadows"))
    score, hits, kind = signals.alignment({k: F.col(k) for k in kinds}, F.col("w"), F.col("shadows"))
    return per.select("user_id", score.alias("score"), hits.cast("long").alias("support_hits"), kind.alias("class"))


@query(r"""WITH s AS (SELECT conv_id, turn, unnest(string_split_regex(text, '[.!?\n]+')) AS s FROM conversations), p AS (SELECT conv_id, trim(s) AS sentence, CAST(CAST(regexp_matches(s, '(?i)\bthe\b') AS INT) * 2 + CAST(regexp_matches(s, '(?i)\band\b') AS INT) AS BIGINT) AS points FROM s WHERE length(trim(s)) >= 12),
  r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY points DESC, sentence) AS rank FROM p WHERE points > 0) SELECT conv_id, sentence, points, rank FROM r WHERE rank <= 8""")
def cue_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentences with cues, eight of each window."""
    from threadloom.operators.ranking import top_k

    s = table(spark, sf_dir, "conversations").select("conv_id", F.explode(F.split("text", r"[.!?\n]+")).alias("s"))
    points = F.col("s").rlike(r"(?i)\bthe\b").cast("long") * 2 + F.col("s").rlike(r"(?i)\band\b").cast("long")
    p = s.select("conv_id", F.trim("s").alias("sentence"), points.alias("points")).where("length(sentence) >= 12 AND points > 0")
    return top_k(p, ["conv_id"], [F.desc("points"), F.col("sentence")], 8).where("selected").select("conv_id", "sentence", "points", F.col("rank").cast("long").alias("rank"))


@query(r"""SELECT conv_id, CAST(sum(len(regexp_extract_all(lower(text), '\b(the|he|she|they)\b'))) AS BIGINT) AS third_person, CAST(sum(len(regexp_extract_all(lower(text), '\b(i|we|my)\b'))) AS BIGINT) AS first_person FROM conversations GROUP BY conv_id""")
def perspective_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of persons, for drift."""
    n = lambda p: F.sum(F.regexp_count(F.lower("text"), F.lit(p))).cast("long")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(n(r"\b(the|he|she|they)\b").alias("third_person"), n(r"\b(i|we|my)\b").alias("first_person"))


@query("""SELECT count(DISTINCT conv_id) AS documents, count(*) AS slices, count(*) FILTER (role = 'user') AS pending, count(*) FILTER (role = 'assistant') AS applied, round(100.0 * count(*) FILTER (role = 'assistant') / count(*), 2) AS percent,
  CASE WHEN count(*) FILTER (role = 'user') > 0 THEN 'pending' ELSE 'ready' END AS state FROM conversations""")
def progress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One body-free row of progress."""
    n = lambda r: F.count_if(F.col("role") == r)
    return table(spark, sf_dir, "conversations").agg(
        F.countDistinct("conv_id").alias("documents"), F.count("*").alias("slices"), n("user").alias("pending"), n("assistant").alias("applied"),
        F.round(100.0 * n("assistant") / F.count("*"), 2).alias("percent"), F.when(n("user") > 0, "pending").otherwise("ready").alias("state"),
    )


@query("""SELECT strftime(o_orderdate, '%Y-%m') AS month_key, count(*) AS n_nodes, count(DISTINCT o_custkey) AS n_windows, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_node FROM orders GROUP BY 1""")
def month_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations bundled by month, and the ledger of each month."""
    month = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM")
    return table(spark, sf_dir, "orders").groupBy(month.alias("month_key")).agg(F.count("*").alias("n_nodes"), F.countDistinct("o_custkey").alias("n_windows"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_node"))


@query("""WITH n AS (SELECT DISTINCT p_brand AS token FROM part), p AS (SELECT p_partkey, regexp_replace(lower(p_brand), '\\s+', '', 'g') || CASE WHEN p_size % 3 = 0 THEN 'xyz' WHEN p_size % 3 = 1 THEN '' ELSE 'abcdefg' END AS name FROM part)
  SELECT p_partkey AS id, token AS token_id FROM p JOIN n ON name = lower(token) OR (starts_with(name, lower(token)) AND length(name) - length(token) BETWEEN 1 AND 4) OR (ends_with(name, lower(token)) AND length(name) - length(token) BETWEEN 1 AND 4)""")
def affix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are a token, or a token with a short affix."""
    p = table(spark, sf_dir, "part")
    tail = F.when(F.col("p_size") % 3 == 0, "xyz").when(F.col("p_size") % 3 == 1, "").otherwise("abcdefg")
    return signals.affix_matches(p.select(F.col("p_partkey").alias("id"), F.concat("p_brand", tail).alias("name")), p.select(F.col("p_brand").alias("token_id"), F.col("p_brand").alias("token")).distinct())


@query("""WITH r AS (SELECT c_nationkey AS scope, 1 AS rank, c_custkey AS id FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey, 2, s_suppkey FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT n_nationkey, 3, n_nationkey FROM nation),
  b AS (SELECT *, min(rank) OVER (PARTITION BY scope) AS best FROM r) SELECT CAST(scope AS BIGINT) AS scope, CAST(rank AS BIGINT) AS rank, count(*) AS n FROM b WHERE rank = best GROUP BY ALL""")
def source_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first source that has rows, per scope."""
    part = lambda t, k, i, r, cond: table(spark, sf_dir, t).where(cond).select(F.col(k).cast("long").alias("scope"), F.lit(r).cast("long").alias("rank"), F.col(i).cast("long").alias("id"))
    rows = part("customer", "c_nationkey", "c_custkey", 1, "c_acctbal > 9000").unionByName(part("supplier", "s_nationkey", "s_suppkey", 2, "s_acctbal > 5000")).unionByName(part("nation", "n_nationkey", "n_nationkey", 3, "true"))
    return signals.with_fallback(rows, "scope", "rank").groupBy("scope", "rank").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, CASE WHEN n = 1 THEN p_brand WHEN n <= 999 THEN p_brand || '_' || right('000' || n, 3) END AS file_name FROM n""")
def exclusive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: names that are taken get a number, up to 999; null past that."""
    named = signals.numbered_names(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey")
    return named.select("p_partkey", "file_name")


@query("""SELECT c_custkey, greatest(coalesce(max(o_orderdate), TIMESTAMP '1970-01-01'), TIMESTAMP '1995-01-01') > TIMESTAMP '1995-06-01' AS active FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def scope_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest activity stamp of each scope."""
    ts = lambda s: F.lit(s).cast("timestamp")
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("last"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left")
    return joined.select("c_custkey", (F.greatest(F.coalesce("last", ts("1970-01-01")), ts("1995-01-01")) > ts("1995-06-01")).alias("active"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(k, 'steel|tin') THEN 'metal' WHEN regexp_matches(k, 'brushed|polished') THEN 'finish' ELSE k END AS fact_key FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS k FROM part)""")
def fact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """normalised keys, and the canonical ones among them."""
    k = text.fact_key("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k.rlike("steel|tin"), "metal").when(k.rlike("brushed|polished"), "finish").otherwise(k).alias("fact_key"))


@query("""WITH u AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') || '::' || o_orderstatus || '::' || o_orderpriority AS signature FROM orders) SELECT o_custkey, count(DISTINCT signature) AS n_updates, min(signature) AS first_update FROM u GROUP BY o_custkey""")
def distinct_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: updates that differ by signature."""
    signature = F.concat_ws("::", F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM"), "o_orderstatus", "o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.countDistinct(signature).alias("n_updates"), F.min(signature).alias("first_update"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS valid_props FROM events GROUP BY event_type""")
def json_blob_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """balanced JSON inside text, found by a pandas function."""
    e = table(spark, sf_dir, "events").select("event_type", parsing.json_blobs(F.concat(F.lit("before {broken "), F.lit("} "), "props", F.lit(" after"))).alias("blobs"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.size("blobs")).cast("long").alias("valid_props"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS nth, role AS anchor, 'w' || turn || CASE WHEN turn % 2 = 0 THEN chr(10) || 'more of ' || role ELSE '' END AS name FROM conversations""")
def entry_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """notes in the entry grammar, written in order and parsed again, field by field; lines without a key go on with the value before."""
    more = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("more of "), "role", F.lit("\n"))).otherwise("\n")
    note = F.concat(F.lit("### ENTRY "), F.col("turn").cast("string"), F.lit("\n Anchor : "), "role", F.lit("\nname:w"), F.col("turn").cast("string"), F.lit("  \n"), more)
    lines = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", note.alias("note")))).alias("ns"))
    whole = lines.select("conv_id", F.concat(F.lit("lead\n"), F.array_join(F.transform("ns", lambda x: x["note"]), "")).alias("note"))
    return whole.select("conv_id", F.posexplode(parsing.entries("note")).alias("nth", "e")).select("conv_id", F.col("nth").cast("long").alias("nth"), F.col("e")["anchor"].alias("anchor"), F.col("e")["name"].alias("name"))


@query("""WITH e AS (SELECT l_suppkey AS a, l_partkey AS b FROM lineitem GROUP BY ALL), s AS (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0), p AS (SELECT p_partkey FROM part WHERE p_size > 10)
  SELECT a, count(*) AS n_links FROM e JOIN s ON s_suppkey = a JOIN p ON p_partkey = b GROUP BY a""")
def displayed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges both of whose ends are shown."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    s = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("a"))
    p = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("b"))
    return e.join(s, "a", "left_semi").join(p, "b", "left_semi").groupBy("a").agg(F.count("*").alias("n_links"))
