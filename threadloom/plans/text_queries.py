"""Queries of the scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import ids, text
from threadloom.operators.scenes import LOOSE
from threadloom.operators.shape import BOOSTS, KEYWORDS, PLAIN_SIGNALS, memo_shape, shape
from threadloom.sources.tables import table

from .registry import query


W = text.WHITE


@query(rf"""WITH t AS (SELECT conv_id, turn, chr(12288) || '# Head' || chr(10) || text || chr(160) || chr(9) AS t FROM conversations), f AS (SELECT *, regexp_replace(regexp_replace(t, '[{W}]+', ' ', 'g'), '^[{W}]+|[{W}]+$', '', 'g') AS flat, regexp_replace(t, '^[{W}]+|[{W}]+$', '', 'g') AS trimmed FROM t),
  n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(replace(t, '[object Object]', ''), '[*_`>#]+', ' ', 'g'), '[{W}]+', ' ', 'g'), '^ | $', '', 'g') AS note, regexp_replace(regexp_replace(regexp_replace(trimmed, '(?m)^#[^\n]*', ' ', 'g'), '[{W}]+', ' ', 'g'), '^ | $', '', 'g') AS bare FROM f)
  SELECT conv_id, turn, trimmed, regexp_replace(lower(trimmed), '[{W}]+', '', 'g') AS compacted, length(regexp_replace(lower(trimmed), '[{W}\p{{P}}\p{{S}}]+', '', 'g')) AS n_word_chars,
    CASE WHEN length(flat) > 80 THEN regexp_replace(substring(flat, 1, 79), '[{W}]+$', '') || '…' ELSE flat END AS clipped, CASE WHEN length(trimmed) > 60 THEN regexp_replace(substring(trimmed, 1, 59), '[{W}]+$', '') || '…' ELSE trimmed END AS block,
    CASE WHEN length(note) > 72 THEN substring(note, 1, 71) || '…' ELSE note END AS note, CASE WHEN length(flat) > 140 THEN substring(flat, 1, 140) || '...' ELSE flat END AS preview, CASE WHEN length(bare) > 100 THEN substring(bare, 1, 100) || '...' ELSE bare END AS excerpt FROM n""")
def text_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trimming with wide blanks, compact forms, and the five ways to cut a text."""
    t = F.concat(F.lit("　# Head\n"), F.col("text"), F.lit("\u00a0\t"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.safe_text(t).alias("trimmed"), text.compact(t).alias("compacted"), F.length(text.compact_words(t)).cast("long").alias("n_word_chars"), text.clip(t, 80).alias("clipped"),
        text.clip_block(t, 60).alias("block"), text.clip_note(t).alias("note"), text.preview(t).alias("preview"), text.excerpt(t, 100).alias("excerpt"),
    )


@query(r"""SELECT p_partkey, coalesce(nullif(substring(regexp_replace(regexp_replace(regexp_replace(p_type || ' / ' || p_name, '[\s/\\]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), ''), 'unnamed') AS segment,
  coalesce(nullif(trim(p_brand), ''), p_name) AS label FROM part""")
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path-safe names and first non-blank of aliases."""
    return table(spark, sf_dir, "part").select("p_partkey", text.path_segment(F.concat_ws(" / ", "p_type", "p_name")).alias("segment"), text.first_text("p_brand", "p_name").alias("label"))


@query(r"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[,.\n]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS xs FROM conversations)
  SELECT conv_id, turn, len(xs) AS n_tokens, len(list_distinct(xs)) AS n_exact, len(list_distinct(list_transform(xs, lambda x: regexp_replace(lower(x), '\s+', '', 'g')))) AS n_compact, coalesce(xs[1], '') AS head FROM t""")
def token_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, and their two identities."""
    xs = text.tokens("text", r"[,.\n]")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", xs.alias("xs")).select(
        "conv_id", "turn", F.size("xs").cast("long").alias("n_tokens"), F.size(text.distinct_exact(F.col("xs"), None)).cast("long").alias("n_exact"),
        F.size(text.distinct_compact(F.col("xs"), None)).cast("long").alias("n_compact"), F.coalesce(F.get("xs", F.lit(0)), F.lit("")).alias("head"),
    )


@query(r"""WITH g AS (SELECT item_id, regexp_replace(lower(text), '\s+', '', 'g') AS c FROM benchmark),
  n AS (SELECT item_id, list_distinct(list_transform(range(1, length(c)), lambda i: substring(c, i, 2))) AS grams FROM g)
  SELECT a.item_id AS a_id, a.item_id + 1 AS b_id, len(a.grams) AS n_grams,
    round(CASE WHEN len(a.grams) > 0 AND len(b.grams) > 0 THEN 2.0 * len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams)) ELSE 0 END, 6) AS dice
  FROM n a JOIN n b ON b.item_id = a.item_id + 1""")
def neighbour_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bigram sets and their Dice similarity, each item with the next."""
    n = table(spark, sf_dir, "benchmark").select("item_id", text.ngrams(text.compact("text"), 2, None).alias("grams"))
    a, b = n.select(F.col("item_id").alias("a_id"), F.col("grams").alias("x")), n.select((F.col("item_id") - 1).alias("a_id"), F.col("grams").alias("y"))
    return a.join(b, "a_id").select("a_id", (F.col("a_id") + 1).alias("b_id"), F.size("x").cast("long").alias("n_grams"), F.round(text.dice(F.col("x"), F.col("y")), 6).alias("dice"))


@query(r"""WITH t AS (SELECT o_orderkey, 'status = ' || o_orderstatus || ' | priority= ' || o_orderpriority || '; plain | total=' || o_orderkey AS s FROM orders)
  SELECT o_orderkey, len(regexp_extract_all(s, '([^|；。\n]+?)\s*=\s*([^|；。\n]+)')) AS n_pairs,
  list_aggregate(list_transform(regexp_extract_all(s, '([^|；。\n]+?)\s*=\s*([^|；。\n]+)', 1), lambda x: trim(x)), 'string_agg', ',') AS keys,
  list_aggregate(list_transform(regexp_extract_all(s, '([^|；。\n]+?)\s*=\s*([^|；。\n]+)', 2), lambda x: trim(x)), 'string_agg', ',') AS found FROM t""")
def key_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: key = value pairs in text."""
    s = F.concat(F.lit("status = "), "o_orderstatus", F.lit(" | priority= "), "o_orderpriority", F.lit("; plain | total="), F.col("o_orderkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.key_values(s).alias("kv")).select(
        "o_orderkey", F.size("kv").cast("long").alias("n_pairs"), F.array_join("kv.key", ",").alias("keys"), F.array_join("kv.value", ",").alias("found")
    )


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(string_split('[w' || conv_id || '] ' || role || ': ' || text, chr(10))) AS line FROM conversations)
  SELECT conv_id, turn, CASE WHEN regexp_matches(line, '^\[([^\]]+)\]\s+(user|assistant|tool):\s*(.*)$') THEN regexp_extract(line, '^\[([^\]]+)\]\s+(user|assistant|tool):', 2) ELSE 'text' END AS line_role,
  count(*) AS n_lines, CAST(sum(length(CASE WHEN regexp_matches(line, '^\[([^\]]+)\]\s+(user|assistant|tool):\s*(.*)$') THEN regexp_replace(regexp_extract(line, '^\[([^\]]+)\]\s+(user|assistant|tool):\s*(.*)$', 3), '^\s+|\s+$', '', 'g') ELSE regexp_replace(line, '^\s+|\s+$', '', 'g') END)) AS BIGINT) AS n_chars
  FROM l WHERE regexp_replace(line, '\s+', '', 'g') <> '' GROUP BY ALL""")
def chat_line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of rendered messages parsed again; a message's later lines, and system lines, have role text."""
    line = F.concat(F.lit("[w"), F.col("conv_id").cast("string"), F.lit("] "), "role", F.lit(": "), "text")
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split(line, "\n")).alias("line")).withColumn("p", text.chat_line("line"))
    return lines.where("p.content <> ''").groupBy("conv_id", "turn", F.col("p.role").alias("line_role")).agg(F.count("*").alias("n_lines"), F.sum(F.length("p.content")).alias("n_chars"))


@query("""SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(floor(epoch(ts)) AS BIGINT) AS from_millis, CAST(floor(epoch(ts)) AS BIGINT) AS from_micros, CAST(0 AS BIGINT) AS unknown FROM events""")
def epoch_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seconds from seconds, milliseconds and microseconds."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("event_id", text.epoch_seconds(F.floor(F.col("us") / 1e6)).alias("seconds"), text.epoch_seconds(F.floor(F.col("us") / 1e3)).alias("from_millis"), text.epoch_seconds("us").alias("from_micros"), text.epoch_seconds(F.lit("soon")).alias("unknown"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS padded, strftime(o_orderdate, '%Y-%m') || '-01' AS month_only, strftime(o_orderdate, '%Y-%m') AS month_key, 'unchanged' AS other FROM orders WHERE year(o_orderdate) >= 2000
  UNION ALL SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '/' || month(o_orderdate) || '/' || day(o_orderdate), CAST(year(o_orderdate) AS VARCHAR) || '.' || month(o_orderdate), '', 'unchanged' FROM orders WHERE year(o_orderdate) < 2000""")
def date_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date literals with padding, missing days, and month keys."""
    d = F.col("o_orderdate").cast("timestamp_ntz")
    parts = [F.year(d).cast("string"), F.month(d).cast("string"), F.dayofmonth(d).cast("string")]
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.date_literal(F.concat_ws("/", *parts)).alias("padded"), text.date_literal(F.concat_ws(".", *parts[:2])).alias("month_only"),
        text.month_key(F.concat(F.lit("reviewed_"), F.date_format(d, "yyyy-MM"), F.lit(".csv"))).alias("month_key"), text.date_literal(F.lit("unchanged")).alias("other"),
    )


@query(r"""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN v = '' THEN 'text' WHEN regexp_matches(v, '^-?\d+(\.\d+)?$') THEN 'number'
    WHEN regexp_matches(v, '^20\d{2}-\d{1,2}-\d{1,2}$') THEN 'date' WHEN (v LIKE '{%' AND v LIKE '%}') OR (v LIKE '[%' AND v LIKE '%]') THEN 'json' WHEN lower(v) IN ('true', 'false') THEN 'boolean' ELSE 'text' END AS kind
  FROM (SELECT unnest([event_type, CAST(user_id AS VARCHAR), strftime(ts, '%Y-%m-%d'), props, CASE WHEN value > 0 THEN 'true' ELSE 'False' END]) AS v FROM events)) GROUP BY kind""")
def value_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kinds of values."""
    v = F.array("event_type", F.col("user_id").cast("string"), F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd"), "props", F.when(F.col("value") > 0, "true").otherwise("False"))
    return table(spark, sf_dir, "events").select(F.explode(v).alias("v")).groupBy(text.value_type("v").alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, turn, 'sha256:' || sha256('{"index":' || (turn + 1) || ',"missing":null,"role":"' || role || '","window":' || conv_id || '}') AS row_digest,
  'occ_' || substring(sha256(conv_id || '|' || turn || '|' || text), 1, 16) AS occurrence_id FROM conversations""")
def canonical_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """canonical JSON digests and short ids."""
    whole = F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "text")
    body = ids.canonical_json(window=F.col("conv_id"), index=F.col("turn") + 1, role=F.col("role"), missing=F.lit(None).cast("string"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ids.digest(body).alias("row_digest"), ids.short_id("occ", whole).alias("occurrence_id"))


@query("""SELECT doc_id, length(text) + len(list_filter(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]'), lambda x: true)) AS utf16_units FROM documents""")
def utf16_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lengths in UTF-16 units."""
    return table(spark, sf_dir, "documents").select("doc_id", text.utf16_length("text").alias("utf16_units"))


REF = "CASE (conv_id + turn) % 5 WHEN 0 THEN 'window_' || lpad(CAST(conv_id AS STRING), 8, '0') || '_msg_' || CAST(turn + 1 AS STRING) WHEN 1 THEN ' window_' || CAST(20250000 + conv_id AS STRING) || '_msg_' || lpad(CAST(turn AS STRING), 4, '0') WHEN 2 THEN 'window_' || CAST(conv_id AS STRING) || '_msg_1' WHEN 3 THEN 'window_20250101_' || role || '_msg_2' ELSE role END"


@query(rf"""WITH t AS (SELECT conv_id, turn, trim({REF}) AS r FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(r, '^(window_\d{{8}})_msg_(\d+)$') THEN regexp_extract(r, '^(window_\d{{8}})_msg_', 1) END AS window_ref, CASE WHEN regexp_matches(r, '^(window_\d{{8}})_msg_(\d+)$') THEN CAST(regexp_extract(r, '_msg_(\d+)$', 1) AS BIGINT) END AS msg_index FROM t""")
def source_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """references to a window and a message; others are null."""
    parsed = table(spark, sf_dir, "conversations").withColumn("r", text.source_ref(F.expr(REF)))
    return parsed.select("conv_id", "turn", F.col("r.window").alias("window_ref"), "r.msg_index")


_GRAMS = "CASE WHEN length({0}) >= {1} THEN list_transform(range(1, length({0}) - {1} + 2), lambda i: substring({0}, i, {1})) ELSE [] END"
_FOUND = rf"""list_distinct(list_concat(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9_]+'), lambda x: length(x) >= 2), flatten(list_transform(regexp_extract_all({{1}}, '\p{{{{Han}}}}{{{{2,}}}}'), lambda x: list_concat(CASE WHEN length(x) <= 8 THEN [x] ELSE [] END, {_GRAMS.format("x", 2)}, {_GRAMS.format("x", 3)}, {_GRAMS.format("x", 4)})))))"""


@query(rf"""WITH b AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '记录事件的状态, ' || substring(text, 1, 12) || '状态情况' ELSE text END AS term, lag(text, 1, '') OVER (ORDER BY item_id) || ' 事件状态 ' || CASE WHEN item_id % 2 = 0 THEN substring(text, 1, length(text) // 2) ELSE 'a' END AS corpus FROM benchmark),
  p AS (SELECT *, regexp_replace(lower(corpus), '[{W}\p{{P}}\p{{S}}]+', '', 'g') AS c, regexp_replace(lower(term), '[{W}\p{{P}}\p{{S}}]+', '', 'g') AS w,
    list_filter(list_transform(string_split_regex(lower(term), '{text.BETWEEN.replace("'", "''")}'), lambda x: regexp_replace(x, '[{W}\p{{P}}\p{{S}}]+', '', 'g')), lambda x: length(x) >= 3) AS seg FROM b),
  g AS (SELECT *, {_FOUND.format("term", "w")} AS m0, {_FOUND.format("corpus", "c")} AS t0, coalesce(round(list_sum(list_transform(list_filter(seg, lambda x: contains(c, x)), lambda x: length(x))) / nullif(list_sum(list_transform(seg, lambda x: length(x))), 0), 4), 0) AS share FROM p),
  s AS (SELECT *, CASE WHEN len(m0) > 0 THEN m0 ELSE list_distinct({_GRAMS.format("w", 2)}) END AS m, CASE WHEN len(t0) > 0 THEN t0 ELSE list_distinct({_GRAMS.format("c", 2)}) END AS t FROM g)
  SELECT item_id, CAST(CASE WHEN w = '' OR c = '' THEN 0 WHEN contains(c, w) THEN 1 WHEN len(list_filter(seg, lambda x: length(x) >= 5 AND contains(c, x))) > 0 THEN greatest(share, 0.72) WHEN len(m) = 0 OR len(t) = 0 THEN 0 ELSE greatest(round(len(list_intersect(m, t)) / len(m), 4), share) END AS DOUBLE) AS share FROM s""")
def term_corpus_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how much of each item a corpus (the item before, some Han text, and half of the item or nothing) holds."""
    b = table(spark, sf_dir, "benchmark")
    before = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("before"))
    corpus = F.concat(F.coalesce("before", F.lit("")), F.lit(" 事件状态 "), F.when(F.col("item_id") % 2 == 0, F.expr("substring(text, 1, length(text) div 2)")).otherwise("a"))
    term = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("记录事件的状态, "), F.left("text", F.lit(12)), F.lit("状态情况"))).otherwise(F.col("text"))
    return b.join(before, "item_id", "left").select("item_id", text.corpus_share(term, corpus).alias("share"))


def _shape_sql() -> str:
    one = lambda w: f"CASE WHEN s = '{w}' THEN 8 WHEN contains(s, '{w}') THEN 4 ELSE 0 END"
    sums = ", ".join(f"sum({' + '.join(one(w) for w in words)}) AS {k}" for k, words in SHAPES.items())
    best = f"greatest({', '.join(SHAPES)})"
    case = " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in SHAPES)
    return f"""WITH s AS (SELECT doc_id, lower(unnest(string_split_regex(text, '\\s+'))) AS s FROM documents), p AS (SELECT doc_id, {sums} FROM s GROUP BY doc_id)
      SELECT doc_id, CASE WHEN {best} < 9 THEN 'scene_event' {case} END AS shape FROM p"""


#: Shapes for the table at hand, whose words are not those of the built-in lists; the scoring is the same.
SHAPES = {"mail": ["@", "mail"], "license": ["license", "apache", "copyright"], "secret": ["key", "token", "password"], "markup": ["http", "<", ">"]}


@query(_shape_sql())
def memory_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword points with a threshold, ties by order."""
    assert len(KEYWORDS) == 7
    return table(spark, sf_dir, "documents").select("doc_id", shape(F.split("text", r"\s+"), SHAPES).alias("shape"))


TITLE = "CASE (conv_id + turn) % 7 WHEN 0 THEN '第一次 ' || substring(text, 1, 8) WHEN 1 THEN '阿明' WHEN 2 THEN '晚安/' || role WHEN 3 THEN '信' WHEN 4 THEN '关系' ELSE substring(text, 1, 20) END"
KIND = "CASE WHEN conv_id % 11 = 0 THEN '长期主线' WHEN conv_id % 11 = 1 THEN 'Persona' ELSE role END"
BODY = "CASE length(text) % 5 WHEN 0 THEN '计划，打卡 ' || substring(text, 1, 30) WHEN 1 THEN '写下日记（花）' WHEN 2 THEN 'the Protocol of ' || role ELSE substring(text, 1, 60) END"
TAG = "CASE turn % 4 WHEN 0 THEN '关系/共生' WHEN 1 THEN '#方法/训练' WHEN 2 THEN '昵称' ELSE role END"


def _memo_sql() -> str:
    quote = lambda xs: ", ".join(f"'{x}'" for x in xs)
    hit = lambda w: f"CASE WHEN lower(s) = '{w.lower()}' THEN 8 WHEN contains(lower(s), '{w.lower()}') THEN 4 ELSE 0 END"
    terms = rf"list_filter(list_transform(string_split_regex(s, '{LOOSE.replace(chr(39), chr(39) * 2)}'), lambda x: trim(x)), lambda x: length(x) >= 2)"
    sums = ", ".join(f"sum({' + '.join(map(hit, words))} + 3 * len(list_filter(t, lambda x: x IN ({quote(words)})))) AS {k}" for k, words in KEYWORDS.items())
    boosted = ", ".join(f"coalesce(any_value(p.{k}), 0) + CASE WHEN regexp_matches(any_value(m.merged), '{BOOSTS[k][1]}') THEN {BOOSTS[k][0]} ELSE 0 END" + (" + CASE WHEN regexp_matches(any_value(m.title), '^阿[一-龥]{1,2}$') THEN 8 ELSE 0 END" if k == "preference_profile" else "") + f" AS {k}" for k in KEYWORDS)
    best = f"greatest({', '.join(KEYWORDS)})"
    first = " ".join(f"WHEN {k} = {best} THEN '{k}'" for k in KEYWORDS)
    return rf"""WITH m AS (SELECT conv_id, turn, trim({TITLE}) AS title, {KIND} AS kind, regexp_replace({BODY}, '^\s+|\s+$', '', 'g') AS body, {TAG} AS tag FROM conversations), n AS (SELECT *, title || ' ' || tag || '  ' || body AS merged FROM m),
      g AS (SELECT conv_id, turn, unnest(list_filter([title, kind, body, tag], lambda x: x <> '' AND x NOT IN ({quote(PLAIN_SIGNALS)}))) AS s FROM n), t AS (SELECT *, {terms} AS t FROM g), p AS (SELECT conv_id, turn, {sums} FROM t GROUP BY conv_id, turn),
      b AS (SELECT m.conv_id, m.turn, any_value(m.kind) AS kind, {boosted} FROM n m LEFT JOIN p ON m.conv_id = p.conv_id AND m.turn = p.turn GROUP BY m.conv_id, m.turn)
      SELECT conv_id, turn, CASE WHEN kind = '长期主线' THEN 'project_line' WHEN kind = 'Persona' THEN 'self_definition' WHEN {best} < 9 THEN 'scene_event' {first} END AS shape, CAST(CASE WHEN kind IN ('长期主线', 'Persona') THEN 0 ELSE {best} END AS BIGINT) AS points FROM b"""


@query(_memo_sql())
def memo_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shapes of memos by the fixed keywords, terms and rules; a kind that names one decides."""
    none = F.array().cast("array<string>")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(TITLE).alias("title"), F.expr(KIND).alias("memo_kind"), F.lit("").alias("query"), F.lit(None).cast("string").alias("context"), F.expr(BODY).alias("snapshot"), F.array(F.expr(TAG)).alias("tags"), *(none.alias(k) for k in ("topics", "scene_handles", "facts", "activation_triggers", "source_titles")))
    return c.withColumn("x", memo_shape()).select("conv_id", "turn", "x.shape", "x.points")


@query("""WITH h AS (SELECT p_partkey, hex(encode(p_name)) AS x FROM part)
  SELECT p_partkey, CAST(list_reduce(list_concat([2166136261::HUGEINT], list_transform(range(1, length(x) // 2 + 1), lambda i: (strpos('0123456789ABCDEF', substr(x, 2 * i - 1, 1)) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i, 1)) - 17)::HUGEINT)), lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS BIGINT) AS fnv FROM h""")
def fnv_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FNV-1a of names."""
    return table(spark, sf_dir, "part").select("p_partkey", ids.fnv1a32(F.col("p_name")).alias("fnv"))
