"""Persona rows: ranked texts by tag prefix, counted expressions and quotes, and a pool of scored evidence.

Counts are summed before they are ranked, and evidence is cut to the best of each task before it meets: no bucket is sorted whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import WHITE, clip, first_text, safe_text

#: Beginnings of tags, their bucket and how many texts it keeps; points of evidence.
BUCKETS = {"关系/": "relation", "情绪/": "emotion", "项目/": "project", "技术/": "thinking", "生活/": "thinking"}
KEPT = {"title": 6, "relation": 5, "emotion": 5, "project": 4, "thinking": 4, "fingerprint": 18, "quote": 12}
TAG_POINTS, QUOTE_POINTS, TONE_POINTS, DRY = {"关系/": 6, "情绪/": 5, "生活/": 3}, 4, 2, -3
MARKS, SOUNDS, EVIDENCE = "[？！…~～]", "哈|嘿|哼|呀|啦|欸|诶|呜|喔", 16


def tag_names(c: Column) -> Column:
    """Tags of a text, without their mark."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), f"[{WHITE}]+"), safe_text), lambda x: x.startswith("#"))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^#", "")), lambda x: x != "")


def listed(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), rf"[；;][{WHITE}]*"), safe_text), lambda x: x != "")


def companion_quotes(c: Column) -> Column:
    """Quotes of the companion in a text of quote references."""
    said = F.filter(listed(c), lambda x: x.rlike(rf"(?i)^char[{WHITE}]*:"))
    return F.filter(F.transform(said, lambda x: safe_text(F.regexp_replace(x, rf"(?i)^char[{WHITE}]*:[{WHITE}]*", ""))), lambda x: x != "")


def ranked_texts(rows: DataFrame, scope: str) -> DataFrame:
    """(scope, bucket, rank, text, n): the commonest texts of each bucket of rows (title, tags, expression_fingerprint, quote_refs), equal counts by text."""
    title = safe_text("title")
    bucket = lambda t: F.coalesce(*(F.when(t.startswith(p), F.struct(F.lit(b).alias("bucket"), F.substring(t, len(p) + 1, 10**6).alias("text"))) for p, b in BUCKETS.items()))
    named = lambda name, xs: F.transform(xs, lambda x: F.struct(F.lit(name).alias("bucket"), x.alias("text")))
    long_ = lambda xs: F.filter(xs, lambda x: F.length(x) >= 4)
    titles = F.when((title != "") & ~title.startswith("未命名"), F.array(title)).otherwise(F.array().cast("array<string>"))
    all_ = F.concat(named("title", titles), F.array_compact(F.transform(tag_names(F.col("tags")), bucket)), named("fingerprint", long_(listed(F.col("expression_fingerprint")))), named("quote", long_(companion_quotes(F.col("quote_refs")))))
    counts = rows.select(scope, F.explode(all_).alias("x")).select(scope, "x.bucket", safe_text("x.text").alias("text")).where("text <> ''").groupBy(scope, "bucket", "text").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(scope, "bucket").orderBy(F.desc("n"), "text"))
    most = F.create_map(*(F.lit(x) for kv in KEPT.items() for x in kv))
    return counts.withColumn("rank", rank).where(F.col("rank") <= max(KEPT.values())).where(F.col("rank") <= most[F.col("bucket")]).select(scope, "bucket", "rank", "text", "n")


def evidence_score(tags: Column, quotes: Column, text: Column) -> Column:
    """Points of tags and quotes, for a lively tone, and against rows that only speak of projects."""
    n = lambda p: F.size(F.filter(tags, lambda t: t.startswith(p)))
    dry = (F.size(F.filter(tags, lambda t: t.startswith("项目/") | t.startswith("技术/"))) > 0) & (n("关系/") + n("情绪/") + n("生活/") == 0)
    points = sum((w * n(p) for p, w in TAG_POINTS.items()), QUOTE_POINTS * F.size(quotes))
    return points + F.when(text.rlike(MARKS), TONE_POINTS).otherwise(0) + F.when(text.rlike(SOUNDS), TONE_POINTS).otherwise(0) + F.when(dry, DRY).otherwise(0)


def candidate_pool(rows: DataFrame, scope: str, most: int = EVIDENCE) -> DataFrame:
    """(scope, rank, score, time, title, body, tags, fingerprints, quotes, n_rows): the best evidence of rows (id, title, body, time, tags, expression_fingerprint, quote_refs) that have expressions or quotes.

    Rows of equal title, beginning of the body, expressions and quotes are one piece of evidence, the latest. Equal scores by time, latest first, then id.
    """
    body, tags = clip("body", 108), F.slice(tag_names(F.col("tags")), 1, 5)
    r = rows.select(scope, "id", safe_text("title").alias("title"), first_text("time").alias("time"), body.alias("body"), tags.alias("tags"), listed(F.col("expression_fingerprint")).alias("f_"), companion_quotes(F.col("quote_refs")).alias("q_"))
    r = r.where((F.size("f_") > 0) | (F.size("q_") > 0)).withColumn("key", F.sha2(F.concat_ws("::", "title", F.left("body", F.lit(72)), F.array_join("f_", "|"), F.array_join("q_", "|")), 256))
    kept = r.withColumn("quotes", F.slice("q_", 1, 2)).withColumn("fingerprints", F.slice("f_", 1, 3))
    rest = ["title", "time", "body", "tags", "fingerprints", "quotes"]
    once = kept.groupBy(scope, "key").agg(F.max_by(F.struct("id", *rest), F.struct("time", -F.col("id"))).alias("e"), F.count("*").alias("n_rows")).select(scope, "n_rows", "e.*")
    text = F.concat_ws(" ", F.filter(F.concat(F.array("title", "body"), F.col("quotes")), lambda x: x != ""))
    scored = once.withColumn("score", evidence_score(F.col("tags"), F.col("quotes"), text))
    rank = F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("score"), F.desc("time"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select(scope, "rank", "id", "score", *rest, "n_rows")
