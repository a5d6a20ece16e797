"""Queries of snippets: messages are prepared chunks, conversations topic entries, every twentieth customer asks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import snippets
from threadloom.sources.tables import table

from .registry import query

FILE = "'src' || CAST(conv_id % 6 AS STRING) || '_2025-0' || CAST(conv_id % 4 + 1 AS STRING) || '.json'"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100 + t).alias("id"), F.concat(F.lit("window_20250101_msg_"), (F.col("conv_id") % 50 * 6 + t * 5 + 1).cast("string")).alias("source_ref"), F.concat(F.lit("w"), (F.col("conv_id") % 10).cast("string")).alias("window_id"),
        (F.col("conv_id") % 50 * 6 + t * 5).alias("start"), (F.col("conv_id") % 50 * 6 + t * 5 + 7).alias("end"), F.expr(FILE).alias("file"), "text",
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        k.alias("id"), F.concat(F.lit("t"), (k % 7).cast("string")).alias("topic_id"), F.concat(F.lit("w"), (k % 10).cast("string")).alias("window_id"), (k % 9 * 30).alias("start"), (k % 9 * 30 + 12).alias("end"), F.expr(FILE).alias("file")
    )


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("c_custkey"), lambda x: x.cast("string")
    said = {
        "topic": [F.concat(F.lit("t"), s(c % 9))], "window": [F.when(c % 40 == 0, "").otherwise(F.concat(F.lit(" w"), s(c % 13)))], "batch": [F.concat(F.lit("src"), s(c % 7), F.lit(".CSV"))], "month": [F.when(c % 60 == 0, F.concat(F.lit("2025-0"), s(c % 4 + 1))).otherwise("")],
        "ref": [F.concat(F.lit("window_20250101_msg_"), s(c % 300 + 1)), F.lit("window_2025_msg_1")], "term": [F.lower("c_mktsegment"), F.lit("the of, and"), F.concat(F.lit("thing "), F.substring("c_name", 1, 3)), F.lit("x")],
    }
    rows = F.flatten(F.array(*(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for v in vs)) for k, vs in said.items())))
    return table(spark, sf_dir, "customer").where("c_custkey % 20 = 0").select(c.alias("request"), F.explode(rows).alias("x")).select("request", "x.*")


_HINTS = """a AS (SELECT c_custkey AS r, 't' || (c_custkey % 9) AS topic, CASE WHEN c_custkey % 40 = 0 THEN '' ELSE 'w' || (c_custkey % 13) END AS win, 'src' || (c_custkey % 7) AS batch, CASE WHEN c_custkey % 60 = 0 THEN '2025-0' || (c_custkey % 4 + 1) ELSE '' END AS month,
    c_custkey % 300 + 1 AS ref, lower(c_mktsegment) AS m, substring(c_name, 1, 3) AS n3 FROM customer WHERE c_custkey % 20 = 0)"""
_ENTRIES = f"e AS (SELECT conv_id AS id, 't' || (conv_id % 7) AS topic, 'w' || (conv_id % 10) AS win, conv_id % 9 * 30 AS s, conv_id % 9 * 30 + 12 AS z, {FILE} AS file FROM (SELECT DISTINCT conv_id FROM conversations))"


@query(f"""WITH {_HINTS}, {_ENTRIES}, p AS (SELECT r, id, e.topic, e.win, 5.0 * (a.topic = e.topic)::INT + 3 * (a.win = e.win)::INT + contains(file, batch)::INT AS score FROM a, e WHERE (a.topic = e.topic OR a.win = e.win OR contains(file, batch)) AND (month = '' OR contains(file, month))),
  o AS (SELECT *, row_number() OVER (PARTITION BY r, topic, win ORDER BY score DESC, id) AS f FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, topic, id) AS rank FROM o WHERE f = 1) SELECT r AS request, rank, id, CAST(score AS DOUBLE) AS score FROM k WHERE rank <= 8""")
def topic_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best topic entries of each request, by topic, window and batch, inside its months."""
    return snippets.topic_snippets(hints(spark, sf_dir), entries(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def _term(i: int, whole: str, parts: list[str]) -> str:
    """Columns of a term's share in compact text c."""
    total = " + ".join(f"length({p})" for p in parts) or "0"
    held = " + ".join(f"CASE WHEN contains(c, {p}) THEN length({p}) ELSE 0 END" for p in parts) or "0"
    return f"CASE WHEN contains(c, {whole}) THEN 1.0 WHEN {total} > 0 THEN round(({held}) / ({total}), 4) ELSE 0 END AS h{i}"


_BAND = "CASE WHEN h{0} >= 0.95 THEN 6.0 WHEN h{0} >= 0.6 THEN 4.0 WHEN h{0} >= 0.3 THEN 2.5 ELSE 0 END"


@query(rf"""WITH {_HINTS}, {_ENTRIES}, c AS (SELECT conv_id * 100 + turn AS id, conv_id % 50 * 6 + turn * 5 + 1 AS own, 'w' || (conv_id % 10) AS win, conv_id % 50 * 6 + turn * 5 AS s, conv_id % 50 * 6 + turn * 5 + 7 AS z, {FILE} AS file, regexp_replace(lower(text), '[\s\p{{P}}\p{{S}}]+', '', 'g') AS c FROM conversations),
  h AS (SELECT r, id, a.win AS aw, c.win AS cw, ref, own, s, z, file, batch, a.topic AS topic, {_term(1, "m", ["m"])}, {_term(2, "'theofand'", ["'the'", "'and'"])}, {_term(3, "'thing' || lower(n3)", ["'thing'", "lower(n3)"])} FROM a, c),
  p AS (SELECT *, EXISTS (SELECT 1 FROM e WHERE e.topic = h.topic AND e.win = cw AND e.s > 0 AND h.s > 0 AND e.s <= h.z AND h.s <= e.z) AS over FROM h),
  q AS (SELECT r, id, topic, over, CASE WHEN ref = own THEN 10 WHEN (aw = '' OR aw = cw) AND s > 0 AND ref BETWEEN s AND z THEN 7 ELSE 0 END + 2 * (aw = cw)::INT + contains(file, batch)::INT + {_BAND.format(1)} + {_BAND.format(2)} + {_BAND.format(3)} + 8 * over::INT AS score FROM p),
  k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS rank FROM q WHERE score > 0) SELECT r AS request, rank, id, CAST(score AS DOUBLE) AS score, CASE WHEN over THEN topic ELSE '' END AS topic FROM k WHERE rank <= 8""")
def prepared_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight best chunks of each request, by references, windows, batches, terms and topic ranges."""
    out = snippets.prepared_snippets(hints(spark, sf_dir), chunks(spark, sf_dir), entries(spark, sf_dir))
    return out.select("request", F.col("rank").cast("long").alias("rank"), "id", "score", "topic")
