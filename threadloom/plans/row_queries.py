"""Queries of row normalising, row predicates, row relevance and fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import compact_words, term_score
from threadloom.operators import rows
from threadloom.sources.tables import table

from .registry import query


def one_of(values: list[str | None], key: str) -> Column:
    """The value at ``key`` modulo their number: fixed fields beside the tables' own."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


#: Inputs of both sides, made of the tables' columns; the SQL of a query works its rule out on them.
LAYER, CARD = "CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN 'Persona' WHEN 2 THEN 'SQL' ELSE lower(lang) END", "CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN '' ELSE source END"


@query(f"""SELECT doc_id, CASE WHEN lower({LAYER}) IN ('persona', 'sql', 'case') THEN lower({LAYER}) WHEN trim({CARD}) <> '' THEN 'sql' ELSE 'unknown' END AS layer FROM documents""")
def reviewed_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer of a reviewed row."""
    return table(spark, sf_dir, "documents").select("doc_id", rows.reviewed_layer(F.expr(LAYER), F.lit(""), F.expr(CARD)).alias("layer"))


ANCHOR = "CASE p_partkey % 6 WHEN 0 THEN p_type WHEN 1 THEN p_brand || '重要事件' WHEN 2 THEN ' Thing ' WHEN 3 THEN '人物' || p_name WHEN 4 THEN '规则' ELSE substring(p_type, 1, p_size % 2) || 'Person' END"
_LOOSE = " ".join(f"WHEN a = '{name}' OR contains(a, '{other}') THEN '{name}'" for name, other in rows.ANCHORS.items())
_STRICT = " ".join(f"WHEN a IN ('{name}', '{rows.ANCHORS[name]}') THEN '{name}'" for name in ("person", "thing", "event", "rule"))


@query(f"""WITH t AS (SELECT p_partkey, lower(trim({ANCHOR})) AS a FROM part) SELECT p_partkey, CASE {_LOOSE} ELSE 'unknown' END AS loose, CASE {_STRICT} ELSE '' END AS strict FROM t""")
def anchor_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: both variants of the anchor type."""
    said = F.expr(ANCHOR)
    return table(spark, sf_dir, "part").select("p_partkey", rows.anchor_type(said).alias("loose"), rows.exact_anchor_type(said).alias("strict"))


ENTRY_NAME = "CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_name || ' ' END"


@query(f"""WITH t AS (SELECT p_partkey, lower(trim({ANCHOR})) AS a, trim({ENTRY_NAME}) AS n FROM part), k AS (SELECT *, CASE {_STRICT} ELSE '' END AS kind FROM t)
  SELECT p_partkey, CASE WHEN kind <> '' AND n <> '' THEN 'accepted' ELSE 'rejected' END AS state, CASE WHEN kind <> '' AND n <> '' THEN kind || '::' || n END AS entry_key FROM k""")
def entry_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry needs one of four types and a name; both ledgers stay together."""
    kind, name = rows.exact_anchor_type(F.expr(ANCHOR)), rows.safe_text(F.expr(ENTRY_NAME))
    good = (kind != "") & (name != "")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(good, "accepted").otherwise("rejected").alias("state"), F.when(good, F.concat(kind, F.lit("::"), name)).alias("entry_key"))


@query("""SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1995-03', '1996-12') OR o_orderkey % 7 = 0""")
def month_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows any of whose columns carries a wanted month."""
    day = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy/M/d")
    refs = F.when(F.col("o_orderkey") % 7 == 0, "window_x 1995年3月 rest").otherwise("window_19950301_w_msg_001")
    return table(spark, sf_dir, "orders").where(rows.in_months([day, refs, F.lit(None)], ["1995-03", "1996-12"])).select("o_orderkey")


@query("""SELECT p_partkey, p_name FROM part WHERE contains(lower(p_partkey || ' ' || p_name || ' ' || p_type || ' ' || p_brand), 'brand#1') ORDER BY p_partkey LIMIT 20""")
def root_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty roots, in the index's order, whose four fields hold a needle."""
    hay = F.lower(F.concat_ws(" ", F.col("p_partkey").cast("string"), "p_name", "p_type", "p_brand"))
    return table(spark, sf_dir, "part").where(hay.contains("Brand#1".lower())).orderBy("p_partkey").limit(20).select("p_partkey", "p_name")


NAMED = "CASE o_orderkey % 7 WHEN 0 THEN substring(CAST(o_orderdate AS STRING), 1, 10) WHEN 1 THEN '感 觉' || o_orderpriority WHEN 2 THEN substring(CAST(o_orderdate AS STRING), 1, 4) || '年5月' WHEN 3 THEN substring(CAST(o_orderdate AS STRING), 6, 1) || '月3日' WHEN 4 THEN ' ' WHEN 5 THEN 'Order ' || substring(CAST(o_orderdate AS STRING), 1, 10) ELSE o_orderpriority END"
_GENERIC = " OR ".join(f"starts_with(lower(regexp_replace(n, '\\s+', '', 'g')), '{w}')" for w in rows.GENERIC)


@query(rf"""WITH t AS (SELECT o_orderkey, trim({NAMED}) AS n FROM orders), d AS (SELECT *, regexp_matches(n, '{rows.PLAIN_DATE}') AS plain_date FROM t) SELECT o_orderkey, plain_date, n = '' OR plain_date OR {_GENERIC} AS generic FROM d""")
def generic_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are dates only, and names that say nothing."""
    name = F.expr(NAMED)
    return table(spark, sf_dir, "orders").select("o_orderkey", rows.is_plain_date(name).alias("plain_date"), rows.is_generic(name).alias("generic"))


FILE = "CASE p_partkey % 6 WHEN 0 THEN '/Users/' || p_brand || '/' || p_name WHEN 1 THEN 'C:' || chr(92) || p_type || chr(92) || p_name || '.txt' WHEN 2 THEN ' ' || p_name || '.md' WHEN 3 THEN p_type || '/sub/' WHEN 4 THEN repeat('/', p_size) ELSE p_brand || ':' || chr(92) END"


@query(rf"""WITH t AS (SELECT p_partkey, trim({FILE}) AS f FROM part) SELECT p_partkey, CASE WHEN contains(f, '/') OR contains(f, chr(92)) THEN coalesce(list_extract(list_filter(string_split_regex(f, '[\\/]+'), lambda x: x <> ''), -1), 'local_source') ELSE f END AS label FROM t""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files without their folders."""
    return table(spark, sf_dir, "part").select("p_partkey", rows.source_label(F.expr(FILE)).alias("label"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || '.000Z' WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.') || right('000' || (epoch_us(ts) // 1000 % 1000), 3) || 'Z' ELSE '' END AS iso FROM events""")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seconds or milliseconds as ISO times."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.floor(us / 1_000_000)).when(k == 1, F.floor(us / 1000)).when(k == 2, -5).otherwise(0).cast("double")
    return table(spark, sf_dir, "events").select("event_id", rows.iso_time(raw).alias("iso"))


@query("""SELECT event_id, event_type || ' one|two' AS user_quotes, 'hm' AS char_quotes, 'loose' || CASE WHEN user_id % 2 = 0 THEN '|other says' ELSE '' END || '|user: ' || event_type || chr(10) || 'next' AS other_quotes FROM events""")
def quote_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: quote references by who said them, repeats by compact form left out."""
    said = F.concat(F.lit("User: "), F.col("event_type"), F.lit(" one；bot：hm; user:two ;  ; USER： Two; loose；assistant: H m"), F.when(F.col("user_id") % 2 == 0, "; someone: other says").otherwise(""), F.lit("; user: "), F.col("event_type"), F.lit("\nnext"))
    q = table(spark, sf_dir, "events").select("event_id", rows.quote_lists(said).alias("q"))
    return q.select("event_id", *(F.array_join(f"q.{k}", "|").alias(f"{k}_quotes") for k in ("user", "char", "other")))


@query("""WITH l AS (SELECT conv_id, turn, role, trim(text, chr(32) || chr(9) || chr(10) || chr(13)) AS t FROM conversations)
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth, 'w' || conv_id AS window_title, t AS text, role FROM l""".replace("SELECT conv_id, row_number()", "SELECT * EXCLUDE (role) FROM (SELECT conv_id, row_number()") + ") WHERE role = 'assistant' AND text <> ''")
def assistant_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what assistants say in slices of header lines and continued lines."""
    c = table(spark, sf_dir, "conversations")
    line = F.concat(F.lit("[w"), F.col("conv_id").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), rows.safe_text("text"))
    slices = c.select("conv_id", "turn", line.alias("line")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return rows.utterances(slices, "conv_id", "text")


TERMS = ["the house", "oftion,entin!", "qu"]
POINTS = "CASE WHEN {0} >= 0.95 THEN 5.0 WHEN {0} >= 0.6 THEN 3.0 WHEN {0} >= 0.3 THEN 1.5 ELSE 0.0 END"


@query(r"""WITH c AS (SELECT conv_id, turn, regexp_replace(lower(text), '[\s\p{P}\p{S}]+', '', 'g') AS t FROM conversations),
  s AS (SELECT conv_id, turn, CASE WHEN contains(t, 'thehouse') THEN 1.0 ELSE round((3.0 * contains(t, 'the')::INT + 5 * contains(t, 'house')::INT) / 8, 4) END AS a,
    CASE WHEN contains(t, 'oftionentin') THEN 1.0 ELSE round((6.0 * contains(t, 'oftion')::INT + 5 * contains(t, 'entin')::INT) / 11, 4) END AS b, CASE WHEN contains(t, 'qu') THEN 1.0 ELSE 0.0 END AS c FROM c)
  SELECT conv_id, turn, CAST(%s + %s + %s + least(4, (a >= 0.3)::INT + (b >= 0.3)::INT + (c >= 0.3)::INT) AS DOUBLE) AS points FROM s""" % tuple(POINTS.format(x) for x in "abc"))  # fmt: skip
def term_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query terms against chunks, in banded points."""
    corpus = compact_words("text")
    points = rows.banded_points([term_score(t, corpus) for t in TERMS])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", points.cast("double").alias("points"))


@query("""WITH d AS (SELECT doc_id, lower(text) AS t, lang, source, doc_id % 2 = 0 AS q, doc_id % 3 = 0 AS f, doc_id % 5 = 0 AS r, doc_id % 7 = 0 AS e FROM documents)
  SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN 8 WHEN contains(t, 'en') THEN 4 ELSE 0 END + CASE WHEN contains(t, 'the ') THEN 4 ELSE 0 END + 3 * r::INT + 3 * e::INT + 2 * q::INT + f::INT AS BIGINT) AS persona_points,
    CAST(3 * contains(t, 'en')::INT + 3 * contains(t, 'the ')::INT + q::INT AS BIGINT) AS reviewed_points, CAST(2 * contains(t, 'en')::INT + 2 * contains(t, 'the ')::INT AS BIGINT) AS card_points FROM d""")
def row_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relevance of persona rows, reviewed rows and cards to query terms."""
    k, terms = F.col("doc_id"), ["En", "the "]
    tags = F.array_compact(F.array(F.when(k % 5 == 0, "关系/x"), F.when(k % 7 == 0, "情绪/y"), F.lit("z")))
    persona = rows.persona_points(terms, F.array("lang"), F.col("text"), tags, k % 2 == 0, k % 3 == 0)
    reviewed = rows.held_points(terms, F.col("text"), 3) + (k % 2 == 0).cast("int")
    out = {"persona_points": persona, "reviewed_points": reviewed, "card_points": rows.held_points(terms, F.col("text"), 2)}
    return table(spark, sf_dir, "documents").select("doc_id", *(c.cast("long").alias(n) for n, c in out.items()))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END, l_partkey, l_linenumber) AS rank FROM lineitem""")
def fact_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a root, stable ones first, then by key."""
    from pyspark.sql import Window

    stable_first = F.when(F.col("l_returnflag") == "A", 0).otherwise(1)
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(stable_first, "l_partkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rank.cast("long").alias("rank"))


@query("""WITH o AS (SELECT o_orderkey AS card, o_orderstatus AS family, o_orderpriority AS kind, o_totalprice AS p FROM orders), r AS (SELECT DISTINCT * FROM (SELECT family, kind FROM o UNION ALL SELECT '', kind FROM o UNION ALL SELECT family, '' FROM o UNION ALL SELECT 'X', kind FROM o UNION ALL SELECT 'X', 'none' UNION ALL SELECT '', '')),
  m AS (SELECT r.family, r.kind, card, row_number() OVER (PARTITION BY r.family, r.kind ORDER BY p DESC, card) AS rank FROM r JOIN o ON (r.family = '' OR o.family = r.family) AND (r.kind = '' OR o.kind = r.kind)),
  t AS (SELECT kind, card, row_number() OVER (PARTITION BY kind ORDER BY p DESC, card) AS rank FROM o)
  SELECT family, kind, card, rank, 'exact' AS tier FROM m WHERE rank <= 8 UNION ALL SELECT r.family, r.kind, card, rank, 'type' FROM r JOIN t ON t.kind = r.kind WHERE rank <= 8 AND NOT EXISTS (SELECT 1 FROM m WHERE m.family = r.family AND m.kind = r.kind)""")
def candidate_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight dearest cards of the same family and type, blank ones fitting any, or else of the type alone."""
    o = table(spark, sf_dir, "orders")
    cards = o.select(F.col("o_orderkey").alias("card"), F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("p"))
    blank, none, x = F.lit(""), F.lit("none"), F.lit("X")
    asked = cards.select("family", "kind").distinct()
    parts = [(blank, F.col("kind")), (F.col("family"), blank), (x, F.col("kind")), (x, none), (blank, blank)]
    for a, b in parts:
        asked = asked.unionByName(cards.select(a.alias("family"), b.alias("kind")).distinct())
    return rows.exact_or_type(cards, asked.distinct(), "family", "kind", [F.desc("p"), F.col("card")], 8).select("family", "kind", "card", F.col("rank").cast("long").alias("rank"), "tier")


@query(r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(text, '[.!?\n ]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM conversations)
  SELECT conv_id, turn, CASE WHEN len(s) = 0 THEN '' ELSE array_to_string(list_reduce(list_transform(s, lambda x: [x]), lambda acc, x: CASE WHEN len(acc) >= 6 OR len(list_filter(acc, lambda y: contains(y, x[1]) OR contains(x[1], y))) > 0 THEN acc ELSE list_concat(acc, x) END), '|') END AS kept FROM s""")
def uncovered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six words none of which holds another."""
    words = F.split("text", r"[.!?\n ]+")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(rows.uncovered(words), "|").alias("kept"))


@query("""SELECT user_id, event_type, CAST(floor(value / 100) AS BIGINT) AS row_no, min(event_id) AS event_id FROM events GROUP BY ALL""")
def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each composite key, the first."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.floor(F.col("value") / 100).cast("long").alias("row_no"), "event_id")
    return rows.first_by_key(e, ["user_id", "event_type", "row_no"], "event_id")


@query("""SELECT l_orderkey, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS candidates, bool_or(o_orderkey IS NOT NULL) AS there FROM lineitem LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def span_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with their occurrences, and the index from a span to the candidates that cite it."""
    seen = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rows.span_sources(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), seen, "l_orderkey", "l_suppkey")


RULED = "text || CASE WHEN conv_id % 4 = 0 THEN '，如果你察觉到了' WHEN length(text) % 5 = 0 THEN '我希望 你' WHEN turn % 3 = 1 THEN '；保留独立性' ELSE '' END"


@query(f"""SELECT conv_id, turn, role = 'user' AND ({' OR '.join(f"contains({RULED}, '{w}')" for w in rows.RULE_LINES)}) AS is_rule FROM conversations""")
def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: lines of users that state a rule."""
    said = F.expr(RULED)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("role") == "user") & said.rlike("|".join(rows.RULE_LINES))).alias("is_rule"))


TRIM = "trim({0}, chr(32) || chr(9) || chr(10) || chr(13))"


@query(f"""WITH m AS (SELECT conv_id, turn, role, text, conv_id % 5 AS k FROM conversations)
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'assistant' ELSE role END AS role,
    CASE k WHEN 0 THEN {TRIM.format("text || chr(10) || chr(10) || 'more'")} WHEN 1 THEN 'A' WHEN 2 THEN {TRIM.format("text")} WHEN 3 THEN '' ELSE {TRIM.format("text")} END AS content,
    CAST(CASE k WHEN 1 THEN 1735689600 + turn WHEN 2 THEN 1735689600 ELSE 0 END AS BIGINT) AS ts,
    CASE WHEN k = 1 THEN 'w' || conv_id ELSE '' END AS window_id, CASE WHEN k = 2 THEN 'win' ELSE '' END AS window_title, CAST(CASE WHEN k = 2 THEN turn ELSE 0 END AS BIGINT) AS msg_index FROM m""")
def message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of messages that go by several names: parts, content before text, content's text, blank parts, ``message``."""
    text, role, turn = F.col("text"), F.col("role"), F.col("turn")
    made = [
        F.struct(F.struct(role.alias("role")).alias("author"), F.struct(F.array(text, F.lit(None), F.lit("more")).alias("parts"), F.lit("no").alias("text")).alias("content"), F.lit("not this").alias("text")),
        F.struct(role.alias("role"), F.lit("A").alias("content"), F.lit("B").alias("text"), ((F.lit(1735689600) + turn) * 1000).alias("ts"), F.concat(F.lit("　w"), F.col("conv_id").cast("string"), F.lit("\u00a0")).alias("sourceWindowId")),
        F.struct(role.alias("role"), F.struct(text.alias("text")).alias("content"), F.lit("2025-01-01T00:00:00Z").alias("time"), F.struct(F.lit("win").alias("source_window_title"), turn.cast("string").alias("sourceMsgIndex")).alias("metadata")),
        F.struct(role.alias("role"), F.struct(F.array(F.lit(" "), F.lit("　")).alias("parts")).alias("content"), text.alias("text")),
        F.struct(F.lit("").alias("role"), F.lit("").alias("content"), text.alias("message"), F.lit(-3).alias("source_msg_index")),
    ]
    raw = F.to_json(made[4])
    for k in range(4):
        raw = F.when(F.col("conv_id") % 5 == k, F.to_json(made[k])).otherwise(raw)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *(c.alias(k) for k, c in rows.message(raw).items()))


@query("""WITH m AS (SELECT conv_id, string_agg('[w' || conv_id || '] ' || role || ': ' || trim(text, chr(32) || chr(9) || chr(10) || chr(13)), chr(10) ORDER BY turn) FILTER (trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '') AS t FROM conversations GROUP BY conv_id)
  SELECT 'raw_text' AS kind, CAST(item_id AS VARCHAR) AS id, length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) AS char_count FROM benchmark WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''
  UNION ALL SELECT 'text', CAST(doc_id AS VARCHAR), length(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''
  UNION ALL SELECT 'chat_bundle', CAST(conv_id AS VARCHAR), length(t) FROM m WHERE t IS NOT NULL""")
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw texts, documents and bundles of messages as one table of documents; blank ones go."""
    raw = table(spark, sf_dir, "benchmark").select(F.lit("raw_text").alias("kind"), F.col("item_id").cast("string").alias("id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.lit("text").alias("kind"), F.col("doc_id").cast("string").alias("id"), "text")
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("id"), "turn", "role", "text", F.concat(F.lit("w"), F.col("conv_id").cast("string")).alias("window_title"))
    return rows.as_documents(raw, docs, rows.bundle_texts(said, "id", "turn")).select("kind", "id", "char_count")


FILE_NAME = "source || CASE doc_id % 5 WHEN 0 THEN '.json' WHEN 1 THEN '.v2.JSON' WHEN 2 THEN '.md' WHEN 3 THEN '.json.txt' ELSE '' END"
FILE_TEXT = "CASE WHEN doc_id % 3 = 0 THEN '{\"n\": ' || CAST(n_chars AS STRING) || ', \"lang\": \"' || lang || '\"}' WHEN doc_id % 3 = 1 THEN '{' || source ELSE CAST(n_chars AS STRING) END"


@query(rf"""WITH f AS (SELECT {FILE_NAME} AS file, {FILE_TEXT} AS value FROM documents), x AS (SELECT *, lower(regexp_extract(file, '\.([^.]+)$', 1)) AS ext FROM f)
  SELECT file, CASE WHEN ext = 'json' AND json_valid(value) THEN 'json' WHEN ext = 'md' THEN 'document' ELSE 'raw_text' END AS kind, count(*) AS n FROM x GROUP BY 1, 2""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a file is by its name; JSON that cannot be read falls back to raw text."""
    file, value = F.expr(FILE_NAME), F.expr(FILE_TEXT)
    return table(spark, sf_dir, "documents").select(file.alias("file"), rows.file_kind(file, value).alias("kind")).groupBy("file", "kind").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_custkey AS bundle, count(*) FILTER (o_orderstatus = 'F') AS accepted_rows, count(*) FILTER (o_orderstatus = 'P') AS rejected_rows, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 200000) AS hold_rows, count(*) FILTER (o_totalprice < 2000) = 0 AS sound FROM orders GROUP BY o_custkey)
  SELECT *, CASE WHEN NOT sound THEN 'invalid_bundle' WHEN accepted_rows + rejected_rows + hold_rows > 0 THEN 'valid_bundle' ELSE 'valid_empty_bundle' END AS status,
    CASE WHEN NOT sound THEN 'blocked_by_contract_errors' WHEN accepted_rows + rejected_rows + hold_rows = 0 THEN 'nothing_to_project' WHEN rejected_rows + hold_rows > 0 THEN 'ready_with_review_ledgers' ELSE 'ready' END AS readiness FROM b""")
def bundle_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a bundle's ledgers, its status, and what can be done with it."""
    s, price = F.col("o_orderstatus"), F.col("o_totalprice")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("bundle")).agg(
        F.count_if(s == "F").alias("accepted_rows"), F.count_if(s == "P").alias("rejected_rows"), F.count_if((s == "O") & (price > 200000)).alias("hold_rows"), (F.count_if(price < 2000) == 0).alias("sound"),
    )
    status, readiness = rows.readiness(F.col("accepted_rows"), F.col("rejected_rows") + F.col("hold_rows"), F.col("sound"))
    return counts.select("*", status.alias("status"), readiness.alias("readiness"))
