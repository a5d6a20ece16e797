"""Queries of Markdown notes and persona rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import notes, persona
from threadloom.sources.tables import table

from .registry import query

#: A note of each conversation: a heading a turn, one mark more for assistants, and bullets of its lines.
_NOTE = """'# Note ' || conv_id || chr(10) || 'lead' || chr(10) || string_agg(CASE role WHEN 'user' THEN '## ' WHEN 'assistant' THEN '### ' ELSE '  ####  ' END || 'Turn ' || turn || '  ' || chr(13) || chr(10) || '- ' || replace(text, chr(10), chr(10) || '* '), chr(10) ORDER BY turn)"""


def turn_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text): the notes above."""
    c = table(spark, sf_dir, "conversations")
    mark = F.when(F.col("role") == "user", "## ").when(F.col("role") == "assistant", "### ").otherwise("  ####  ")
    part = F.concat(mark, F.lit("Turn "), F.col("turn").cast("string"), F.lit("  \r\n- "), F.replace("text", F.lit("\n"), F.lit("\n* ")))
    lines = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("p")))).alias("ps"))
    return lines.select("conv_id", F.concat(F.lit("# Note "), F.col("conv_id").cast("string"), F.lit("\nlead\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n")).alias("text"))


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 4 END AS level, len(string_split(text, chr(10))) AS n FROM conversations)
  SELECT conv_id, nth, level, 'Turn ' || turn AS title, coalesce((SELECT max(b.nth) FROM c b WHERE b.conv_id = c.conv_id AND b.nth < c.nth AND b.level < c.level), 0) AS parent,
    CAST(2 + sum(n + 1) OVER (PARTITION BY conv_id ORDER BY nth) - n - 1 AS BIGINT) AS first_line, n AS n_lines FROM c""")
def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the tree of sections of notes."""
    s = notes.sections(turn_notes(spark, sf_dir), "conv_id")
    return s.select("conv_id", "nth", F.col("level").cast("long").alias("level"), "title", "parent", F.col("first_line").cast("long").alias("first_line"), F.size("lines").cast("long").alias("n_lines"))


@query("""SELECT conv_id, '# N' || chr(10) || chr(10) || '## A' || chr(10) || CASE conv_id % 3 WHEN 0 THEN chr(10) || '## B' || chr(10) || chr(10) || '- x' || chr(10) || '- r' || (conv_id % 7) || chr(10) || '## C' || chr(10) || 'end'
    WHEN 1 THEN 'a' || chr(10) || chr(10) || '## B' || chr(10) || chr(10) || '- x' || chr(10) || '- r' || (conv_id % 7) || chr(10) || chr(10) || '## 原文回溯' || chr(10) || '- old' ELSE 'a' || chr(10) || chr(10) || '## B' || chr(10) || chr(10) || '- x' || chr(10) || '- r' || (conv_id % 7) || chr(10) END || chr(10) AS text,
  ['x', 'r' || (conv_id % 7)] AS bullets, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'a' END AS a FROM (SELECT DISTINCT conv_id FROM conversations)""")
def section_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a section replaced, put before the late ones, or at the end; what is read back."""
    k = F.col("conv_id") % 3
    text = F.when(k == 0, "# N\n\n## A\n\n\n\n## B\n- old\nz\n## C\nend  \n").when(k == 1, "# N\n\n## A\na\n## 原文回溯\n- old").otherwise("# N\n\n## A\na\n\n")
    r = F.concat(F.lit("r"), (F.col("conv_id") % 7).cast("string"))
    made = notes.upsert_section(text, "B", F.array(F.lit(" x"), r, F.lit("x"), F.lit("")))
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("text", made)
    return rows.select("conv_id", "text", notes.section_bullets(F.col("text"), "B").alias("bullets"), notes.section_text(F.col("text"), "A").alias("a"))


def linked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): a trace of each part, a memo of each supplier with links by path, by title, to several and to none."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    k, n = F.col("p_partkey"), F.col("s_suppkey")
    c = lambda x: x.cast("string")
    trace = F.concat(F.lit('---\ntype: trace\ntitle: "Trace '), c(F.when(k % 4 == 3, k % 20).otherwise(k)), F.lit("\"\nsource_ref: 'ref_"), c(k % 9), F.lit("'\ntags:\n  - a\n  - \"b c\"\n---\n# t\n"))
    memo = F.concat(F.lit("# Memo "), F.col("s_name"), F.lit("\n\n## 原文回溯\n"), F.when(n % 5 == 0, "none\n").otherwise(F.concat(
        F.lit("- [[traces/p"), c(n), F.lit("|x]] and [[traces\\p"), c(n + 1), F.lit(".MD]]\n* [[no]]\n- [[trace  "), c(n * 4), F.lit("]]\n- [[Trace "), c(n % 20), F.lit("]]\n"))), F.lit("\n## Z\n- [[traces/p0]]"))
    return p.select(F.concat(F.lit("traces/p"), c(k), F.when(k % 2 == 0, ".md").otherwise(".MD")).alias("path"), trace.alias("text")).unionByName(s.select(F.concat(F.lit("memos/s"), c(n), F.lit(".md")).alias("path"), memo.alias("text")))


_LINKS = r"""t AS (SELECT 'traces/p' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.md' ELSE '.MD' END AS trace, 'trace' || CASE WHEN p_partkey % 4 = 3 THEN p_partkey % 20 ELSE p_partkey END AS name, 'ref_' || (p_partkey % 9) AS source_ref FROM part),
  m AS (SELECT s_suppkey AS n, 'memos/s' || s_suppkey || '.md' AS memo, 'Memo ' || s_name AS title FROM supplier), l AS (SELECT memo, title, unnest(CASE WHEN n % 5 = 0 THEN [NULL] ELSE ['traces/p' || n || '.md', 'traces/p' || (n + 1) || '.MD', 'trace  ' || (n * 4) || '.md', 'Trace ' || (n % 20) || '.md'] END) AS target,
    unnest(CASE WHEN n % 5 = 0 THEN [NULL] ELSE [0, 1, 2, 3] END) AS nth FROM m), g AS (SELECT name, count(*) AS c, arg_min(trace, trace) AS trace, arg_min(source_ref, trace) AS source_ref FROM t GROUP BY name),
  j AS (SELECT l.*, t.trace AS t1, t.source_ref AS r1, g.c, g.trace AS t2, g.source_ref AS r2 FROM l LEFT JOIN t ON l.target = t.trace LEFT JOIN g ON lower(replace(regexp_extract(l.target, '([^/]+)\.md$', 1), ' ', '')) = g.name),
  s AS (SELECT *, CASE WHEN target IS NULL THEN 'no_links' WHEN t1 IS NOT NULL THEN 'linked' WHEN c = 1 THEN 'by_title' WHEN c > 1 THEN 'ambiguous' ELSE 'dangling' END AS state FROM j)"""


@query(f"WITH {_LINKS} SELECT memo, title, CAST(nth AS BIGINT) AS nth, target, state, CASE state WHEN 'linked' THEN t1 WHEN 'by_title' THEN t2 END AS trace, CASE state WHEN 'linked' THEN r1 WHEN 'by_title' THEN r2 END AS source_ref FROM s")
def memo_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memos with the traces that they link to; every memo and every link stays, with its state."""
    return notes.link_traces(linked_notes(spark, sf_dir))


def persona_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as persona rows: tags, expressions and quotes by turn and length, the month as scope."""
    t, k, n = F.col("turn"), F.col("conv_id"), F.length("text")
    tags = F.concat(F.when(t % 2 == 0, "#关系/信任 #情绪/安静").when(t % 3 == 0, "#项目/记录 plain").otherwise("#技术/索引"), F.when(n % 3 == 0, " #生活/晚餐").otherwise(""))
    return table(spark, sf_dir, "conversations").select(
        (k % 6).alias("scope"), (k * 100 + t).alias("id"), F.when(n % 11 == 0, "未命名 x").otherwise(F.concat(F.lit(" T"), (n % 5).cast("string"))).alias("title"), F.substring("text", 1, 200).alias("body"), F.concat(F.lit("2025-"), F.lpad((k % 12 + 1).cast("string"), 2, "0")).alias("time"),
        tags.alias("tags"), F.when(n % 2 == 0, F.concat(F.lit("soft voice "), (n % 9).cast("string"), F.lit("； abc；slow talk"))).otherwise("").alias("expression_fingerprint"),
        F.when(n % 4 < 2, F.concat(F.lit("user: no; CHAR : well "), (n % 7).cast("string"), F.lit("…；char:hm"))).otherwise("").alias("quote_refs"),
    )


_PERSONA = """r AS (SELECT conv_id % 6 AS scope, conv_id * 100 + turn AS id, CASE WHEN length(text) % 11 = 0 THEN '未命名 x' ELSE 'T' || (length(text) % 5) END AS title, substring(text, 1, 200) AS body, '2025-' || lpad(CAST(conv_id % 12 + 1 AS VARCHAR), 2, '0') AS time, length(text) AS n,
    list_concat(CASE WHEN turn % 2 = 0 THEN ['关系/信任', '情绪/安静'] WHEN turn % 3 = 0 THEN ['项目/记录'] ELSE ['技术/索引'] END, CASE WHEN length(text) % 3 = 0 THEN ['生活/晚餐'] ELSE [] END) AS tags,
    CASE WHEN length(text) % 2 = 0 THEN ['soft voice ' || (length(text) % 9), 'abc', 'slow talk'] ELSE [] END AS f, CASE WHEN length(text) % 4 < 2 THEN ['well ' || (length(text) % 7) || '…', 'hm'] ELSE [] END AS q FROM conversations)"""


@query(f"""WITH {_PERSONA}, x AS (SELECT scope, 'title' AS bucket, title AS text FROM r WHERE NOT starts_with(title, '未命名') UNION ALL SELECT scope, 'fingerprint', unnest(list_filter(f, lambda v: length(v) >= 4)) FROM r UNION ALL SELECT scope, 'quote', unnest(list_filter(q, lambda v: length(v) >= 4)) FROM r
    UNION ALL SELECT scope, CASE split_part(t, '/', 1) WHEN '关系' THEN 'relation' WHEN '情绪' THEN 'emotion' WHEN '项目' THEN 'project' ELSE 'thinking' END, split_part(t, '/', 2) FROM (SELECT scope, unnest(tags) AS t FROM r)),
  c AS (SELECT scope, bucket, text, count(*) AS n, row_number() OVER (PARTITION BY scope, bucket ORDER BY count(*) DESC, text) AS rank FROM x GROUP BY scope, bucket, text)
  SELECT scope, bucket, rank, text, n FROM c WHERE rank <= CASE bucket WHEN 'title' THEN 6 WHEN 'relation' THEN 5 WHEN 'emotion' THEN 5 WHEN 'fingerprint' THEN 18 WHEN 'quote' THEN 12 ELSE 4 END""")
def persona_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest titles, tag parts, expressions and quotes of each scope."""
    out = persona.ranked_texts(persona_rows(spark, sf_dir), "scope")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(rf"""WITH {_PERSONA}, b AS (SELECT *, regexp_replace(trim(body, chr(32) || chr(9) || chr(10) || chr(13)), '\s+', ' ', 'g') AS flat FROM r WHERE len(f) + len(q) > 0), c AS (SELECT *, CASE WHEN length(flat) > 108 THEN rtrim(substring(flat, 1, 107)) || '…' ELSE flat END AS clipped FROM b),
  k AS (SELECT *, title || '::' || substring(clipped, 1, 72) || '::' || array_to_string(f, '|') || '::' || array_to_string(q, '|') AS key, count(*) OVER w AS n_rows, row_number() OVER (w ORDER BY time DESC, id) AS first FROM c WINDOW w AS (PARTITION BY scope, title || '::' || substring(clipped, 1, 72) || '::' || array_to_string(f, '|') || '::' || array_to_string(q, '|'))),
  s AS (SELECT *, 6 * len(list_filter(tags, lambda t: starts_with(t, '关系/'))) + 5 * len(list_filter(tags, lambda t: starts_with(t, '情绪/'))) + 3 * len(list_filter(tags, lambda t: starts_with(t, '生活/'))) + 4 * len(q) + CASE WHEN regexp_matches(clipped || array_to_string(q, ' '), '[？！…~～]') THEN 2 ELSE 0 END
    - CASE WHEN len(list_filter(tags, lambda t: starts_with(t, '关系/') OR starts_with(t, '情绪/') OR starts_with(t, '生活/'))) = 0 THEN 3 ELSE 0 END AS score FROM k WHERE first = 1),
  o AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, time DESC, id) AS rank FROM s) SELECT scope, rank, id, CAST(score AS BIGINT) AS score, clipped AS body, n_rows FROM o WHERE rank <= 16""")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best evidence of each scope, with how many rows say the same."""
    out = persona.candidate_pool(persona_rows(spark, sf_dir), "scope")
    return out.select("scope", F.col("rank").cast("long").alias("rank"), "id", F.col("score").cast("long").alias("score"), "body", "n_rows")
