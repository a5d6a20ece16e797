"""Queries of bundles, submissions, compaction and file sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.ids import digest
from threadloom.functions.text import ngrams
from threadloom.operators import bundle, compaction, state
from threadloom.sources import files
from threadloom.sources.tables import table

from .registry import query

ROUTED = """d AS (SELECT o_orderkey, CASE WHEN o_totalprice >= 5000 THEN CAST(o_orderkey AS VARCHAR) ELSE '' END AS identity, CASE o_orderstatus WHEN 'P' THEN 'hold' WHEN 'F' THEN 'new' ELSE 'update' END AS decision FROM orders),
  s AS (SELECT l_orderkey, count(*) AS n_spans, count(*) FILTER (l_quantity >= 5) AS n_reliable FROM lineitem GROUP BY l_orderkey),
  r AS (SELECT o_orderkey, CASE WHEN identity = '' THEN 'missing_identity' WHEN decision = 'hold' THEN 'decision_hold' WHEN coalesce(n_reliable, 0) = 0 THEN 'no_reliable_span' WHEN n_reliable < n_spans THEN 'some_spans_unreliable' ELSE 'ok' END AS reason
    FROM d LEFT JOIN s ON l_orderkey = o_orderkey),
  t AS (SELECT *, CASE reason WHEN 'missing_identity' THEN 'rejected' WHEN 'ok' THEN 'accepted' ELSE 'hold' END AS state FROM r)"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.when(F.col("o_orderstatus") == "P", "hold").when(F.col("o_orderstatus") == "F", "new").otherwise("update")
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") >= 5000, F.col("o_orderkey").cast("string")).otherwise("").alias("identity"), decision.alias("decision"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_spans"), F.count_if(F.col("l_quantity") >= 5).alias("n_reliable"))
    return bundle.route(d.join(s, "o_orderkey", "left").fillna(0, ["n_spans", "n_reliable"]))


@query(f"WITH {ROUTED} SELECT o_orderkey, state, reason FROM t")
def bundle_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts to accepted, hold or rejected."""
    return _routed(spark, sf_dir).select("o_orderkey", "state", "reason")


@query(f"WITH {ROUTED} SELECT count(*) AS inputs, count(*) FILTER (state = 'accepted') AS accepted, count(*) FILTER (state = 'hold') AS held, count(*) FILTER (state = 'rejected') AS rejected, true AS conserved FROM t")
def bundle_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is lost between inputs and outcomes."""
    return bundle.conservation(_routed(spark, sf_dir))


@query("""SELECT conv_id * 100 + turn AS span_id, rule FROM (SELECT conv_id, turn, unnest([CASE WHEN turn = 3 THEN 'bounds_mismatch' END, CASE WHEN role = 'system' THEN 'digest_mismatch' END]) AS rule FROM conversations) WHERE rule IS NOT NULL""")
def span_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that were tampered with come back as violations, one row a rule."""
    sealed = F.when(F.col("role") == "system", F.lit("sha256:0")).otherwise(digest(F.col("text")))
    length = F.octet_length(F.encode("text", "UTF-16BE")) / 2
    spans = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("span_id"), F.col("text").alias("excerpt"), sealed.alias("excerpt_digest"), F.lit(0).alias("start"), (length + F.when(F.col("turn") == 3, 1).otherwise(0)).alias("end")
    )
    return bundle.violations(spans, "span_id", bundle.span_rules())


@query("""WITH e AS (SELECT event_id, user_id AS task, event_type AS digest FROM events), k AS (SELECT task, arg_min(digest, event_id) AS known FROM e WHERE task % 3 = 0 GROUP BY task),
  f AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY event_id) AS n, first_value(digest) OVER (PARTITION BY task ORDER BY event_id) AS head FROM e)
  SELECT event_id AS arrival, f.task, CASE WHEN known IS NOT NULL THEN CASE WHEN digest = known THEN 'replay' ELSE 'conflict' END WHEN n = 1 THEN 'write' WHEN digest = head THEN 'replay' ELSE 'conflict' END AS outcome FROM f LEFT JOIN k ON f.task = k.task""")
def submission_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: first writes, replays and conflicts of submissions; a third of the tasks is known from before."""
    i = table(spark, sf_dir, "events").select(F.col("event_id").alias("arrival"), F.col("user_id").alias("task"), F.col("event_type").alias("digest"))
    known = i.where("task % 3 = 0").groupBy("task").agg(F.min_by("digest", "arrival").alias("digest"))
    return state.submissions(i, known, "task", "digest").select("arrival", "task", "outcome")


@query("""SELECT user_id, arg_max(event_type, event_id) AS state, count(*) AS n_events FROM events GROUP BY user_id""")
def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task's latest state."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("state"), "event_id")
    return state.current(e, "user_id", "state", "event_id", "event_id")


@query("""SELECT coalesce(s_suppkey, c_custkey) AS id, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS name FROM customer FULL JOIN supplier ON s_suppkey = c_custkey""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows replaced by key or added."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return state.upsert(c, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id")


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM events) SELECT * FROM r WHERE rank <= 4""")
def ledger_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows of each scope."""
    return state.retained(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 4).select("event_id", "user_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT 'hold' AS ledger, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 UNION ALL SELECT 'rejected', count(*) FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""")
def review_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ledgers as one."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = d.where("quality = 0").select(F.lit("hold").alias("ledger")).unionByName(d.where("toxic = 1").select(F.lit("rejected").alias("ledger")))
    return rows.groupBy("ledger").agg(F.count("*").alias("n"))


@query()
def note_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy compaction of benchmark notes by length band (order-dependent; a test holds this query against a plain fold)."""
    n = table(spark, sf_dir, "benchmark").select(
        F.lit("all").alias("scope"), F.when(F.length("text") > 200, "scene_event").otherwise(F.concat(F.lit("band"), F.floor(F.length("text") / 40).cast("string"))).alias("shape"), F.col("item_id").alias("note"),
        F.col("item_id").alias("at"), F.substring("text", 1, 20).alias("title"), F.array_distinct(F.split(F.lower("text"), r"\s+")).alias("slices"), ngrams(F.regexp_replace(F.lower("text"), r"\s+", ""), 2, None).alias("grams"),
    )
    return compaction.compacted(n)


@query("""SELECT conv_id, turn, role, text, strftime(TIMESTAMP '2025-01-01' + to_months(CAST(conv_id % 12 AS INT)), '%Y-%m') AS month_key FROM conversations""")
def reviewed_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages written as monthly CSV with quotes and line breaks, and read back whole."""
    m = table(spark, sf_dir, "conversations").withColumn("month_key", F.date_format(F.add_months(F.lit("2025-01-01").cast("date"), (F.col("conv_id") % 12).cast("int")), "yyyy-MM"))
    path = f"{_shared(spark)}/csv-{uuid.uuid4().hex}"
    m.write.partitionBy("month_key").csv(path, header=True, quoteAll=True, escape='"')
    back = files.csv_rows(spark, path, "conv_id long, turn long, role string, text string, month_key string")
    return back.where("_corrupt_record IS NULL").select("conv_id", "turn", "role", "text", "month_key")


BODY = "'{\"messages\": [{\"role\": \"' || role || '\", \"text\": \"t' || CAST(turn AS STRING) || '\"}]}'"
EXPORT = f"CASE (conv_id + turn) % 8 WHEN 0 THEN {BODY} WHEN 1 THEN '[' || {BODY} || ']' WHEN 2 THEN '{{\"documents\": [' || CAST(turn AS STRING) || ']}}' WHEN 3 THEN '{{' || role WHEN 4 THEN '[{{\"text\": \"' || role || '\"}}]' WHEN 5 THEN '{{\"bundle\": ' || {BODY} || '}}' WHEN 6 THEN '{{\"' || role || '\": 1}}' ELSE CAST(turn AS STRING) END"


@query(f"""WITH e AS (SELECT conv_id, turn, {EXPORT} AS j FROM conversations), v AS (SELECT *, CASE WHEN json_valid(j) THEN j::JSON END AS v FROM e)
  SELECT conv_id, turn, CASE WHEN v IS NULL THEN 'text' WHEN json_extract(v, '$[0].messages') IS NOT NULL THEN 'window_array' WHEN json_extract(v, '$[0].text') IS NOT NULL THEN 'document_array' WHEN json_extract(v, '$.bundle') IS NOT NULL THEN 'bundle'
    WHEN json_extract(v, '$.documents') IS NOT NULL THEN 'documents' WHEN json_extract(v, '$.messages') IS NOT NULL THEN 'messages' WHEN json_type(v) = 'OBJECT' THEN 'object' ELSE 'text' END AS shape FROM v""")
def json_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of exports in JSON, broken JSON is text."""
    e = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(EXPORT).alias("j"))
    return e.select("conv_id", "turn", files.json_shape("j").alias("shape"))


def _shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset."""
    import tempfile

    return (spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='threadloom-')}").rstrip("/")
