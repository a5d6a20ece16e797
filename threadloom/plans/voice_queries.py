"""Queries of voices, on messages with phrases of the language that the rules know."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import voices
from threadloom.sources.tables import table

from .registry import query

SAID = "CASE (conv_id + turn) % 6 WHEN 0 THEN '用户喜欢' || substring(text, 1, length(text) % 200) WHEN 1 THEN '用户会' || substring(text, 1, 30) WHEN 2 THEN '用户曾在 ' || substring(text, 1, 20) || '？' WHEN 3 THEN '我想你，其他 ' || substring(text, 1, 60) || '！他真的开心。请参考以下是' WHEN 4 THEN '呀 ' || substring(text, 1, 90) ELSE text END"


@query(f"""WITH t AS (SELECT conv_id, turn, role, regexp_replace({SAID}, '^\\s+|\\s+$', '', 'g') AS t FROM conversations) SELECT conv_id, turn, role = 'assistant' AND starts_with(t, '用户') AND length(t) <= 180 AND NOT regexp_matches(t, '[？?]$') AND regexp_matches(t, '{voices.SUMMARY}') AS is_summary FROM t""")
def user_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the assistant that sum the user up."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", voices.user_summary(F.col("role"), F.expr(SAID)).alias("is_summary"))


@query(f"""WITH p AS (SELECT conv_id, string_agg(trim({SAID}), chr(10) ORDER BY turn) AS t, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'the' END AS name FROM conversations GROUP BY conv_id), q AS (SELECT conv_id, name, regexp_replace(t, '其他|其它', '', 'g') AS t FROM p),
  n AS (SELECT conv_id, name, len(regexp_extract_all(t, '我')) AS a, len(regexp_extract_all(t, '[你您]')) AS b, len(regexp_extract_all(t, '[她他它]')) AS c, CASE WHEN name = '' THEN 0 ELSE len(string_split(t, name)) - 1 END AS own FROM q), k AS (SELECT *, (a > 0)::INT + (b > 0)::INT + (c > 0)::INT AS k FROM n)
  SELECT conv_id, a AS first_person, b AS second_person, c AS third_person, CAST(own AS BIGINT) AS own_name, CASE WHEN k >= 3 THEN 'high' WHEN k = 2 THEN 'medium' ELSE 'low' END AS risk,
    array_to_string(list_filter([CASE WHEN k >= 2 THEN 'mixed_pronouns' END, CASE WHEN c > 0 THEN 'third_person_present' END, CASE WHEN b > 0 THEN 'dialogue_perspective_present' END, CASE WHEN own = 0 AND name <> '' THEN 'self_name_missing' END], lambda x: x IS NOT NULL), '|') AS flags FROM k""")
def perspective_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons named in each conversation, and the risk of drift."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.trim(F.expr(SAID)).alias("s")))).alias("x"))
    text, name = F.array_join(F.transform("x", lambda x: x["s"]), "\n"), F.when(F.col("conv_id") % 3 == 0, "").otherwise("the")
    p = c.select("conv_id", text.alias("t"), name.alias("name")).withColumn("p", voices.perspective(F.col("t"), F.col("name")))
    return p.select("conv_id", F.col("p.first").alias("first_person"), F.col("p.second").alias("second_person"), F.col("p.third").alias("third_person"), "p.own_name", "p.risk", F.array_join("p.flags", "|").alias("flags"))


@query(rf"""WITH b AS (SELECT conv_id * 100 + turn AS id, replace({SAID}, '.' || chr(10), '!' || chr(10) || chr(10)) AS t FROM conversations), u AS (SELECT id, unnest(regexp_extract_all(t, '(?s)[^。！？!?…\n]*(?:\n[^。！？!?…\n]+)*[。！？!?…]?')) AS s, generate_subscripts(regexp_extract_all(t, '(?s)[^。！？!?…\n]*(?:\n[^。！？!?…\n]+)*[。！？!?…]?'), 1) AS i FROM b),
  v AS (SELECT id, i, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s FROM u), o AS (SELECT id, arg_min(s, i) AS s, min(i) AS i FROM v WHERE length(s) BETWEEN 16 AND 180 GROUP BY id, regexp_replace(s, '\s+', '', 'g')),
  p AS (SELECT id, s, i, round(least(length(s) / 32, 6) + CASE WHEN regexp_matches(s, '{voices.PERSON}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(s, '{voices.MARK}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(s, '{voices.FEELING}') THEN 4 ELSE 0 END + CASE WHEN regexp_matches(s, '{voices.TONE}') THEN 1.5 ELSE 0 END - CASE WHEN regexp_matches(s, '{voices.ADVICE}') THEN 4 ELSE 0 END, 6) AS points FROM o),
  r AS (SELECT id, s AS sentence, CAST(points AS DOUBLE) AS points, row_number() OVER (PARTITION BY id ORDER BY points DESC, i) AS rank FROM p) SELECT * FROM r WHERE rank <= 8""")
def feeling_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the sentences of each message that carry most feeling."""
    text = F.replace(F.expr(SAID), F.lit(".\n"), F.lit("!\n\n"))
    m = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), text.alias("t"))
    return voices.feeling_sentences(m, "id", "t").withColumn("rank", F.col("rank").cast("long"))
