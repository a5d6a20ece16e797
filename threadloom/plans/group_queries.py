"""Queries of groupings, folds, windows and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators import chunking, growth, ranking, timeline
from threadloom.sources.tables import table

from .registry import query


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("msg_index", F.col("turn") + 1)


@query("SELECT conv_id, CAST(min(turn + 1) AS BIGINT) AS start_msg_index, CAST(max(turn + 1) AS BIGINT) AS end_msg_index, count(*) AS message_count FROM conversations GROUP BY conv_id")
def timeline_window_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range of message numbers and count of each window."""
    return timeline.window_ranges(messages(spark, sf_dir), "conv_id", "msg_index")


@query("SELECT event_id, user_id, row_number() OVER (ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, CASE WHEN event_type = 'error' THEN 0 ELSE floor(epoch(ts)) END, event_id) AS position FROM events")
def timeline_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sequence over all windows; errors count as rows of unknown time and come last."""
    seconds = F.when(F.col("event_type") == "error", 0).otherwise(F.unix_timestamp(F.col("ts").cast("timestamp")))
    rows = table(spark, sf_dir, "events").withColumn("seconds", seconds.cast("long"))
    return timeline.merged_timeline(rows, "seconds", "event_id").select("event_id", "user_id", "position")


@query("""WITH p AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS i, count(*) AS n FROM events GROUP BY ALL)
  SELECT user_id, CAST(sum(n) AS BIGINT) AS n_rows, count(*) FILTER (i >= 1) AS n_numbers, count(*) FILTER (n > 1) AS n_duplicates, CAST(coalesce(sum(n) FILTER (i < 1), 0) AS BIGINT) AS n_invalid, coalesce(max(i) = count(*) FILTER (i >= 1), false) AS complete FROM p GROUP BY user_id""")
def message_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Census of numbered rows per window."""
    rows = table(spark, sf_dir, "events").select("user_id", F.floor("value").alias("i"))
    return timeline.census(rows, "user_id", "i").withColumn("complete", F.coalesce("complete", F.lit(False)))


@query("""WITH s AS (SELECT user_id, CAST(floor(value) AS BIGINT) - lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events),
  k AS (SELECT user_id, count(*) FILTER (step < 0) AS back, count(*) FILTER (step = 0) AS same, count(*) FILTER (step > 1) AS gaps FROM s GROUP BY user_id)
  SELECT user_id, CASE WHEN back > 0 THEN 'disorder' WHEN same > 0 THEN 'duplicate' WHEN gaps > 0 THEN 'gap' ELSE 'exact' END AS status, gaps FROM k""")
def window_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps, duplicates and disorder."""
    return timeline.contiguity(table(spark, sf_dir, "events").withColumn("i", F.floor("value")), "user_id", "i", "event_id")


SLICES = r"""l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+', '', 'g') <> '') AS ls FROM documents),
  e AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM l),
  r AS (SELECT doc_id, i, 1 AS g, length(line) + 1 AS used, length(line) AS n FROM e WHERE i = 1
    UNION ALL SELECT e.doc_id, e.i, CASE WHEN r.used + length(line) + 1 > 2200 THEN g + 1 ELSE g END, CASE WHEN r.used + length(line) + 1 > 2200 THEN length(line) + 1 ELSE r.used + length(line) + 1 END, length(line)
    FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1),
  s AS (SELECT doc_id, CAST(g AS BIGINT) AS slice_no, count(*) AS n_lines, CAST(sum(n + 1) - 1 AS BIGINT) AS char_count FROM r GROUP BY doc_id, g)"""


@query(f"""WITH RECURSIVE {SLICES} SELECT *, CAST(coalesce(sum(char_count) OVER (PARTITION BY doc_id ORDER BY slice_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM s""")
def chunk_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy slices of 2200 characters with cumulative offsets."""
    return chunking.slices(table(spark, sf_dir, "documents"), "doc_id", 2200)


PARAGRAPHS = SLICES.replace("string_split(text, chr(10))", "string_split_regex(replace(text, '.' || chr(10), '.' || chr(10) || ' ' || chr(10)), '\\n\\s*\\n')").replace("length(line) + 1", "length(line) + 2").replace("sum(n + 1) - 1", "sum(n + 2) - 2").replace("unnest(ls) AS line", "regexp_replace(unnest(ls), '^\\s+|\\s+$', '', 'g') AS line").replace("2200", "900")


@query(f"""WITH RECURSIVE {PARAGRAPHS} SELECT *, CAST(coalesce(sum(char_count) OVER (PARTITION BY doc_id ORDER BY slice_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM s""")
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy slices of 900 characters by paragraphs."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.replace("text", F.lit(".\n"), F.lit(".\n \n")))
    return chunking.slices(d, "doc_id", 900, paragraphs=True)


@query(f"""WITH RECURSIVE {SLICES},
  b AS (SELECT doc_id, slice_no, 1 AS b, 1 AS items, char_count AS used, char_count FROM s WHERE slice_no = 1
    UNION ALL SELECT s.doc_id, s.slice_no, CASE WHEN items >= 2 OR used + s.char_count > 4000 THEN b + 1 ELSE b END, CASE WHEN items >= 2 OR used + s.char_count > 4000 THEN 1 ELSE items + 1 END,
      CASE WHEN items >= 2 OR used + s.char_count > 4000 THEN s.char_count ELSE used + s.char_count END, s.char_count FROM b JOIN s ON s.doc_id = b.doc_id AND s.slice_no = b.slice_no + 1)
  SELECT doc_id, CAST(b AS BIGINT) AS batch_no, count(*) AS n_slices, CAST(sum(char_count) AS BIGINT) AS batch_chars, min(slice_no) AS first_slice FROM b GROUP BY doc_id, b""")
def chunk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of at most two slices and 4000 characters."""
    return chunking.batches(chunking.slices(table(spark, sf_dir, "documents"), "doc_id", 2200), "doc_id", 2, 4000)


@query("SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def count_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1."""
    return messages(spark, sf_dir).groupBy("role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(r"SELECT w AS word, count(*) AS n FROM (SELECT unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents) WHERE length(w) >= 3 GROUP BY w ORDER BY n DESC, w LIMIT 20")
def ranked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the twenty commonest words, ties by text (a top-k report)."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where(F.length("word") >= 3)
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(20)


@query("""SELECT o_orderpriority || '::' || o_orderstatus AS key, strftime(min(o_orderdate), '%Y-%m-%d') AS first_seen, strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_windows FROM orders GROUP BY ALL""")
def growth_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: groups by type and title with their dates."""
    day = lambda c: F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").groupBy(F.concat_ws("::", "o_orderpriority", "o_orderstatus").alias("key")).agg(
        day(F.min("o_orderdate")).alias("first_seen"), day(F.max("o_orderdate")).alias("last_seen"), F.count("*").alias("n_rows"), F.countDistinct("o_custkey").alias("n_windows")
    )


PLACED = """g AS (SELECT o_custkey AS root, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS n_batches, count(DISTINCT o_orderkey) AS n_windows, count(*) AS n_rows, count(DISTINCT o_orderkey) FILTER (o_orderstatus = 'F') AS n_facts FROM orders GROUP BY ALL),
  c AS (SELECT g.*, c_mktsegment <> 'MACHINERY' AS trunk, c_acctbal >= 0 AS good_name FROM g JOIN customer ON c_custkey = root),
  p AS (SELECT *, n_batches >= 2 OR (n_windows >= 2 AND n_rows >= 2) AS spread, n_facts > 0 AS kept FROM c),
  d AS (SELECT root, n_batches, n_facts, CASE WHEN trunk AND spread AND kept AND good_name THEN 'promote' WHEN NOT trunk OR (NOT spread AND NOT kept) THEN 'archive' ELSE 'observe' END AS action,
    CASE WHEN trunk AND spread AND kept AND good_name THEN 'high' WHEN NOT trunk OR (NOT spread AND NOT kept) THEN 'low' WHEN spread OR kept THEN 'middle' ELSE 'low' END AS confidence FROM p)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM")
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("root")).agg(
        F.countDistinct(month).alias("n_batches"), F.countDistinct("o_orderkey").alias("n_windows"), F.count("*").alias("n_rows"), F.countDistinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))).alias("n_facts")
    )
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("root"), (F.col("c_mktsegment") != "MACHINERY").alias("trunk"), (F.col("c_acctbal") >= 0).alias("good_name"))
    return growth.placement(g.join(c, "root"))


@query(f"WITH {PLACED} SELECT * FROM d")
def growth_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence per root and its placement."""
    return _placed(spark, sf_dir).select("root", "n_batches", "n_facts", "action", "confidence")


@query(f"WITH {PLACED} SELECT count(*) AS groups, count(*) FILTER (action = 'promote') AS promoted, count(*) FILTER (action = 'observe') AS observed, count(*) FILTER (action = 'archive') AS archived FROM d")
def growth_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    n = lambda a: F.count_if(F.col("action") == a)
    return _placed(spark, sf_dir).agg(F.count("*").alias("groups"), n("promote").alias("promoted"), n("observe").alias("observed"), n("archive").alias("archived"))


@query("""WITH RECURSIVE b AS (SELECT o_custkey AS root, strftime(o_orderdate, '%Y-%m') AS "at", list_sort(list_distinct(list(o_orderpriority))) AS facts FROM orders GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY "at") AS i FROM b),
  f AS (SELECT root, i, "at", list_slice(facts, 1, 6) AS known, 0 AS conflicts FROM n WHERE i = 1
    UNION ALL SELECT n.root, n.i, n."at", CASE WHEN NOT list_has_any(n.facts, f.known) THEN f.known ELSE list_slice(list_concat(f.known, list_filter(n.facts, lambda x: NOT list_contains(f.known, x))), 1, 8) END, f.conflicts + CASE WHEN NOT list_has_any(n.facts, f.known) THEN 1 ELSE 0 END
    FROM f JOIN n ON n.root = f.root AND n.i = f.i + 1)
  SELECT root, max(i) AS version_count, max(i) - 1 AS branch_count, max(conflicts) > 0 AS conflict_hint, arg_max(array_to_string(known, '|'), i) AS facts, min("at") AS first_at, max("at") AS last_at, CASE WHEN max(i) > 1 THEN 'updated' ELSE 'stable' END AS evolution FROM f GROUP BY root""")
def growth_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches folded in order into versioned roots."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("root"), F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM").alias("at"), F.col("o_orderpriority").alias("fact"))
    r = growth.roots(rows)
    return r.select("root", F.col("version_count").cast("long").alias("version_count"), F.col("branch_count").cast("long").alias("branch_count"), "conflict_hint", F.array_join("facts", "|").alias("facts"), "first_at", "last_at", "evolution")


@query("""SELECT l_returnflag || '::' || l_linestatus AS key, count(DISTINCT l_suppkey) AS n_facts, count(DISTINCT l_orderkey) AS n_slices, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen, strftime(max(l_shipdate), '%Y-%m-%d') AS last_seen FROM lineitem GROUP BY ALL""")
def grouped_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7, T8."""
    day = lambda c: F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd")
    return table(spark, sf_dir, "lineitem").groupBy(F.concat_ws("::", "l_returnflag", "l_linestatus").alias("key")).agg(
        F.countDistinct("l_suppkey").alias("n_facts"), F.countDistinct("l_orderkey").alias("n_slices"), day(F.min("l_shipdate")).alias("first_seen"), day(F.max("l_shipdate")).alias("last_seen")
    )


@query("""SELECT l_orderkey AS root, count(*) AS entry_count, count(DISTINCT l_returnflag || l_linestatus) > 1 AS ambiguous, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS first_flag, strftime(min(l_shipdate), '%Y-%m-%d') AS first_seen, bool_or(l_discount > 0.05) AS conflict_hint,
  list_aggregate(list_sort(list_distinct(list(CAST(l_suppkey AS VARCHAR)))), 'string_agg', '|') AS sources FROM lineitem GROUP BY l_orderkey""")
def reviewed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by root key and their merged entry."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("root")).agg(
        F.count("*").alias("entry_count"), (F.countDistinct(F.concat("l_returnflag", "l_linestatus")) > 1).alias("ambiguous"), F.min_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("first_flag"),
        F.date_format(F.min("l_shipdate").cast("timestamp_ntz"), "yyyy-MM-dd").alias("first_seen"), F.bool_or(F.col("l_discount") > 0.05).alias("conflict_hint"),
        F.array_join(F.sort_array(F.collect_set(F.col("l_suppkey").cast("string"))), "|").alias("sources"),
    )


@query("""WITH k AS (SELECT p_brand FROM part WHERE p_size >= 10 GROUP BY p_brand HAVING count(DISTINCT p_type) > 1) SELECT p_partkey, p_brand IN (SELECT p_brand FROM k) AS conflict_hint FROM part""")
def fact_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with two stable values flag every fact of that key."""
    p = table(spark, sf_dir, "part")
    keys = p.where("p_size >= 10").groupBy("p_brand").agg(F.countDistinct("p_type").alias("n")).where("n > 1").select("p_brand", F.lit(True).alias("hit"))
    return p.join(keys, "p_brand", "left").select("p_partkey", F.coalesce("hit", F.lit(False)).alias("conflict_hint"))


@query("""SELECT s_nationkey AS family, count(*) AS n_members, count(*) FILTER (s_acctbal >= 0) AS n_sql, count(*) FILTER (s_acctbal < 0) AS n_persona, arg_min(s_name, s_suppkey) AS title,
  coalesce(string_agg(CAST(s_suppkey AS VARCHAR), ',' ORDER BY s_suppkey) FILTER (s_acctbal < 0), '') AS persona_members FROM supplier GROUP BY s_nationkey""")
def family_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families with counts and members by layer."""
    low = F.col("s_acctbal") < 0
    return table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("family")).agg(
        F.count("*").alias("n_members"), F.count_if(~low).alias("n_sql"), F.count_if(low).alias("n_persona"), F.min_by("s_name", "s_suppkey").alias("title"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(low, F.col("s_suppkey")))), lambda x: x.cast("string")), ",").alias("persona_members"),
    )


@query("""SELECT event_type AS kind, CAST(user_id % 7 AS BIGINT) AS effect, count(*) AS n_rows, count(DISTINCT user_id) AS n_windows FROM events GROUP BY ALL""")
def merged_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints merged by kind and effect."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind"), (F.col("user_id") % 7).alias("effect")).agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_windows"))


@query("""SELECT source, count(*) AS n_rows, count(toxic) AS n_labelled, count(*) FILTER (toxic = 1) AS n_toxic, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source ORDER BY n_rows DESC, source LIMIT 20""")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest sources with their layers (a top-k report)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    per = d.groupBy("source").agg(F.count("*").alias("n_rows"), F.count("toxic").alias("n_labelled"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    return per.orderBy(F.desc("n_rows"), "source").limit(20)


@query("""SELECT coalesce(m, 'total') AS month_key, coalesce(s, 'all') AS layer, n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ROLLUP (1, 2))""")
def monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly histograms with totals."""
    m = F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM").alias("m")
    r = table(spark, sf_dir, "orders").select(m, F.col("o_orderstatus").alias("s")).rollup("m", "s").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("m", F.lit("total")).alias("month_key"), F.coalesce("s", F.lit("all")).alias("layer"), "n")


@query("""WITH w AS (SELECT l_orderkey, CASE WHEN l_linenumber <= 2 THEN l_shipmode ELSE l_shipmode END AS cue, CASE WHEN l_linenumber <= 2 THEN 2 ELSE 1 END AS p FROM (SELECT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmode FROM lineitem)),
  s AS (SELECT l_orderkey, cue, sum(p) AS points FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY points DESC, cue) AS rank FROM s)
  SELECT l_orderkey, cue, CAST(points AS BIGINT) AS points, rank FROM r WHERE rank <= 2""")
def weighted_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted cues, the best two of each cluster."""
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("cue"), F.when(F.col("l_linenumber") <= 2, 2).otherwise(1).alias("p"))
    s = w.groupBy("l_orderkey", "cue").agg(F.sum("p").alias("points"))
    return ranking.top_k(s, ["l_orderkey"], [F.desc("points"), F.col("cue")], 2).where("selected").select("l_orderkey", "cue", "points", F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) SELECT l_suppkey, count(*) FILTER (rank <= 5) AS selected, count(*) FILTER (rank > 5) AS discarded, max(l_orderkey) FILTER (rank = 1) AS best FROM r GROUP BY l_suppkey""")
def topk_with_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each group and a report of the rest."""
    t = ranking.top_k(table(spark, sf_dir, "lineitem"), ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5)
    return t.groupBy("l_suppkey").agg(F.count_if("selected").alias("selected"), F.count_if(~F.col("selected")).alias("discarded"), F.max(F.when(F.col("rank") == 1, F.col("l_orderkey"))).alias("best"))


@query("""WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS turn FROM customer) SELECT c_custkey, c_mktsegment, turn FROM r WHERE list_position(['BUILDING', 'AUTOMOBILE', 'MACHINERY'], c_mktsegment) > 0 ORDER BY turn, list_position(['BUILDING', 'AUTOMOBILE', 'MACHINERY'], c_mktsegment) LIMIT 8""")
def stratified_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight roots in turn over kinds."""
    r = ranking.round_robin(table(spark, sf_dir, "customer"), "c_mktsegment", ["BUILDING", "AUTOMOBILE", "MACHINERY"], [F.desc("c_acctbal"), F.col("c_custkey")], 8)
    return r.select("c_custkey", "c_mktsegment", F.col("turn").cast("long").alias("turn"))


@query("""WITH c AS (SELECT o_custkey AS q, CAST(month(o_orderdate) AS BIGINT) AS item, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderstatus = 'O' THEN 1 ELSE 2 END AS tier, o_orderkey AS score FROM orders),
  b AS (SELECT q, item, tier, score, row_number() OVER (PARTITION BY q, item ORDER BY tier, score DESC) AS k FROM c), r AS (SELECT q, item, tier, score, row_number() OVER (PARTITION BY q ORDER BY tier, score DESC, item) AS rank FROM b WHERE k = 1) SELECT * FROM r WHERE rank <= 6""")
def recall_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers filled up to six items."""
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    c = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.month(F.col("o_orderdate").cast("timestamp_ntz")).cast("long").alias("item"), tier.alias("tier"), F.col("o_orderkey").alias("score"))
    return ranking.cascade(c, "q", "item", 6).select("q", "item", "tier", "score", F.col("rank").cast("long").alias("rank"))


@query(r"""SELECT conv_id, arg_max(name, turn) AS name FROM (SELECT conv_id, turn, regexp_extract(text, '^(\S+)', 1) AS name FROM conversations WHERE role = 'assistant') WHERE name <> '' GROUP BY conv_id""")
def latest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hit wins."""
    rows = messages(spark, sf_dir).where("role = 'assistant'").select("conv_id", "turn", F.regexp_extract("text", r"^(\S+)", 1).alias("name"))
    return ranking.latest(rows, "conv_id", "name", "turn")


@query(r"""SELECT conv_id, turn, CASE WHEN role = 'assistant' AND length(text) <= 400 AND NOT regexp_matches(text, '[？?]$') AND regexp_matches(text, '(the|and|of)') THEN 'memory' WHEN role = 'user' AND regexp_matches(text, '(with|from|that)') THEN 'rule' ELSE 'other' END AS kind FROM conversations""")
def sentence_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicates of lines worth keeping, as an ordered case."""
    memory = (F.col("role") == "assistant") & (F.length("text") <= 400) & ~F.col("text").rlike("[？?]$") & F.col("text").rlike("(the|and|of)")
    return messages(spark, sf_dir).select("conv_id", "turn", F.when(memory, "memory").when((F.col("role") == "user") & F.col("text").rlike("(with|from|that)"), "rule").otherwise("other").alias("kind"))


@query("""SELECT o_custkey, o_orderkey, CAST(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 200000 AS BOOLEAN) AS over_budget FROM orders""")
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running offsets within a group."""
    before = F.sum("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, -1))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.coalesce(before, F.lit(0.0)) > 200000).alias("over_budget"))


_GROWTH = "CASE o_orderpriority WHEN '1-URGENT' THEN '人物' WHEN '2-HIGH' THEN 'Event ' WHEN '5-LOW' THEN '规则' ELSE o_orderpriority END"
_TITLE = "CASE WHEN o_orderkey % 3 = 0 THEN 'Root  ' ELSE 'root' END || CAST(o_custkey % 40 AS STRING)"


def growth_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 360), "yyyy/M/d"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_GROWTH).alias("kind"), F.expr(_TITLE).alias("title"), time.alias("time"), F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM").alias("batch"))


_GROUPED = f"""r AS (SELECT o_orderkey AS id, CASE lower(trim({_GROWTH})) WHEN '人物' THEN 'person' WHEN '规则' THEN 'rule' ELSE lower(trim({_GROWTH})) END AS type_key, {_TITLE} AS title, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate + INTERVAL 30 YEAR, '%Y-%m-%d') END AS day, strftime(o_orderdate, '%Y-%m') AS batch FROM orders),
  k AS (SELECT *, type_key || '::' || lower(replace(title, ' ', '')) AS key FROM r)"""


@query(f"""WITH {_GROUPED} SELECT key, type_key, arg_min(title, id) AS title, coalesce(min(day), '') AS first_seen, coalesce(max(day), '') AS last_seen, min(batch) AS first_batch, count(*) AS n_rows, count(DISTINCT batch) AS n_batches FROM k GROUP BY key, type_key""")
def growth_group_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: groups by type and compact title, with dates in one form (thirty years on, as dates begin with 2000)."""
    return growth.grouped_rows(growth_input(spark, sf_dir))[0]


@query(f"WITH {_GROUPED} SELECT key, id FROM k")
def growth_group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: the rows of each group."""
    return growth.grouped_rows(growth_input(spark, sf_dir))[1]


@query("""WITH r AS (SELECT strftime(o_orderdate, '%Y-%m') AS m, CASE o_orderstatus WHEN 'F' THEN 'persona' WHEN 'O' THEN 'sql' ELSE 'unknown' END AS layer, CASE WHEN o_orderkey % 3 = 0 THEN 'volatile' ELSE o_orderpriority END AS state, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'n' || (o_custkey % 30) END AS name, o_orderkey AS place FROM orders),
  p AS (SELECT coalesce(m, 'total') AS month_key, count(*) AS rows, count(*) FILTER (layer = 'persona') AS persona, count(*) FILTER (layer = 'sql') AS sql, 0 AS "case", count(*) FILTER (layer = 'unknown') AS unknown FROM r GROUP BY ROLLUP (m)),
  e AS (SELECT m, string_agg(state || '=' || n, ',' ORDER BY state) AS evolution FROM (SELECT m, state, count(*) AS n FROM r WHERE layer = 'sql' GROUP BY m, state) GROUP BY m),
  n AS (SELECT m, name, row_number() OVER (PARTITION BY m ORDER BY min(place), name) AS k FROM r WHERE layer = 'sql' AND name <> '' GROUP BY m, name), l AS (SELECT m, string_agg(name, '|' ORDER BY k) AS names FROM n WHERE k <= 12 GROUP BY m)
  SELECT month_key, rows AS n_rows, persona, sql AS n_sql, unknown, coalesce(evolution, '') AS evolution, coalesce(names, '') AS names FROM p LEFT JOIN e ON e.m = month_key LEFT JOIN l ON l.m = month_key""")
def reviewed_month_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months with their layers, states and names, and the total."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM").alias("month_key"), F.when(F.col("o_orderstatus") == "F", "Persona").when(F.col("o_orderstatus") == "O", "sql").otherwise("other").alias("layer"),
        F.when(k % 3 == 0, " ").otherwise(F.col("o_orderpriority")).alias("evolution_status"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("n"), (F.col("o_custkey") % 30).cast("string"))).alias("name"), k.alias("place"),
    )
    pairs = F.array_join(F.transform("evolution", lambda x: F.concat(x["state"], F.lit("="), x["n"].cast("string"))), ",")
    out = growth.reviewed_months(rows)
    return out.select("month_key", F.col("rows").alias("n_rows"), "persona", F.col("sql").alias("n_sql"), "unknown", F.coalesce(pairs, F.lit("")).alias("evolution"), F.coalesce(F.array_join("names", "|"), F.lit("")).alias("names"))


@query("""WITH r AS (SELECT source AS key, CASE WHEN lang = 'en' THEN 'persona' WHEN lang = 'de' THEN 'sql' ELSE lang END AS layer, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lpad(CAST(n_chars AS VARCHAR), 9, '0') END AS t FROM documents)
  SELECT key, count(*) FILTER (layer = 'persona') AS persona_rows, count(*) FILTER (layer = 'sql') AS sql_rows, count(*) AS total_rows, coalesce(min(t), '') AS first_time, coalesce(max(t), '') AS last_time, (SELECT count(*) FROM r) AS all_rows, (SELECT count(DISTINCT key) FROM r) AS all_groups FROM r GROUP BY key ORDER BY total_rows DESC, key LIMIT 20""")
def source_group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty largest groups of sources with layers and times (a top-k report)."""
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("source").alias("key"), F.when(F.col("lang") == "en", "Persona").when(F.col("lang") == "de", " SQL ").otherwise(F.col("lang")).alias("layer"), F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.lpad(F.col("n_chars").cast("string"), 9, "0")).alias("time"))
    return growth.source_groups(rows)


def bundle_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations by pairs as bundles of two windows; one bundle in seven has a gap, one a repeat, one a turn before its time, one mixed windows, one a message without a window, one without a number."""
    c = table(spark, sf_dir, "conversations")
    b, k, t = F.expr("conv_id div 2"), F.expr("(conv_id div 2) % 7"), F.col("turn")
    index = F.when((k == 1) & (t >= 2), t + 2).when((k == 2) & (t == 2), t).when((k == 3) & (t == 1), t + 2).when((k == 6) & (t == 0), F.lit(None)).otherwise(t + 1)
    at = F.when(k == 4, t * 2 + F.col("conv_id") % 2).otherwise(F.col("conv_id") % 2 * 1000 + t)
    window = F.when((k == 5) & (t == 0), " ").otherwise(F.concat(F.lit("w"), F.col("conv_id").cast("string")))
    return c.select(b.alias("bundle"), window.alias("win"), index.cast("long").alias("i"), at.alias("at_"))


_BUNDLES = """m AS (SELECT conv_id // 2 AS bundle, CASE WHEN (conv_id // 2) % 7 = 5 AND turn = 0 THEN ' ' ELSE 'w' || conv_id END AS w, CASE WHEN (conv_id // 2) % 7 = 1 AND turn >= 2 THEN turn + 2 WHEN (conv_id // 2) % 7 = 2 AND turn = 2 THEN turn WHEN (conv_id // 2) % 7 = 3 AND turn = 1 THEN turn + 2 WHEN (conv_id // 2) % 7 = 6 AND turn = 0 THEN NULL ELSE turn + 1 END AS i,
    CASE WHEN (conv_id // 2) % 7 = 4 THEN turn * 2 + conv_id % 2 ELSE conv_id % 2 * 1000 + turn END AS pos FROM conversations),
  x AS (SELECT *, i - lag(i) OVER (PARTITION BY bundle, w ORDER BY pos) AS step, coalesce(lag(w) OVER (PARTITION BY bundle ORDER BY pos) <> w, true)::INT AS t FROM m),
  s AS (SELECT bundle, CASE WHEN count(*) FILTER (trim(w) = '') > 0 THEN 'missing_window' WHEN count(*) FILTER (i IS NULL) > 0 THEN 'missing_index' WHEN sum(t) > count(DISTINCT w) THEN 'mixed_window' WHEN count(*) FILTER (step < 0) > 0 THEN 'disorder' WHEN count(*) FILTER (step = 0) > 0 THEN 'duplicate' WHEN count(*) FILTER (step > 1) > 0 THEN 'gap' ELSE 'exact' END AS status FROM x GROUP BY bundle)"""


@query(f"WITH {_BUNDLES} SELECT * FROM s")
def bundle_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a bundle from exact chunks."""
    return timeline.exact_chunks(bundle_messages(spark, sf_dir), "bundle", "win", "i", "at_", 3)[0]


@query(f"WITH {_BUNDLES}, g AS (SELECT m.*, min(i) OVER (PARTITION BY bundle, w) AS f FROM m WHERE bundle IN (SELECT bundle FROM s WHERE status = 'exact')) SELECT bundle, w AS win, (i - f) // 3 + 1 AS chunk_no, min(i) AS start_msg_index, max(i) AS end_msg_index, count(*) AS message_count FROM g GROUP BY 1, 2, 3")
def exact_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of three messages, each of one window."""
    return timeline.exact_chunks(bundle_messages(spark, sf_dir), "bundle", "win", "i", "at_", 3)[1]
