"""Queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import ngrams
from threadloom.operators import relations
from threadloom.sources.tables import table

from .registry import query

MEMBERS = """m AS (SELECT DISTINCT * FROM (SELECT l_suppkey AS root, 'windows' AS kind, l_orderkey AS member FROM lineitem UNION ALL SELECT l_suppkey, 'topics', l_partkey FROM lineitem
  UNION ALL SELECT l_suppkey, 'personas', CAST(epoch(l_shipdate) AS BIGINT) * 10 + l_linenumber FROM lineitem)),
  e AS (SELECT a.root AS from_root, b.root AS to_root, least(count(*) FILTER (a.kind = 'windows'), 8) AS w, least(count(*) FILTER (a.kind = 'topics'), 8) AS t, least(count(*) FILTER (a.kind = 'personas'), 8) AS p
    FROM m a JOIN m b ON a.kind = b.kind AND a.member = b.member AND a.root < b.root GROUP BY ALL),
  k AS (SELECT *, 3 * w + 2 * t + p AS score FROM e WHERE greatest(w, t, p) >= 2 OR (w >= 1 AND t + p >= 1) OR 3 * w + 2 * t + p >= 4)"""


def _edges(spark: SparkSession, sf_dir: str, best: int | None = None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    kind = lambda k, c: li.select(F.col("l_suppkey").alias("root"), F.lit(k).alias("kind"), c.cast("long").alias("member"))
    day = F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) * 10 + F.col("l_linenumber")
    return relations.overlap_edges(kind("windows", F.col("l_orderkey")).unionByName(kind("topics", F.col("l_partkey"))).unionByName(kind("personas", day)), best)


@query(f"""WITH {MEMBERS} SELECT from_root, to_root, CAST(w AS BIGINT) AS windows, CAST(t AS BIGINT) AS topics, CAST(p AS BIGINT) AS personas, CAST(score AS BIGINT) AS score,
  CASE WHEN 3 * w >= 2 * t AND 3 * w >= p THEN 'shared_window' WHEN 2 * t >= p THEN 'shared_topic' ELSE 'shared_persona_ref' END AS relation FROM k""")
def overlap_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between roots that share windows, topics or personas."""
    e = _edges(spark, sf_dir)
    return e.select("from_root", "to_root", *(F.col(c).cast("long").alias(c) for c in ("windows", "topics", "personas", "score")), "relation")


@query(f"""WITH {MEMBERS}, b AS (SELECT from_root AS root, to_root AS other, score FROM k UNION ALL SELECT to_root, from_root, score FROM k),
  r AS (SELECT root, other, CAST(score AS BIGINT) AS score, row_number() OVER (PARTITION BY root ORDER BY score DESC, other) AS rank FROM b) SELECT * FROM r WHERE rank <= 12""")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twelve edges of each root."""
    a = relations.adjacency(_edges(spark, sf_dir, 12))
    return a.select("root", "other", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""SELECT o_orderkey, count(*) AS n_slices, strftime(min(l_shipdate), '%Y-%m-%d') AS first_at, strftime(max(l_shipdate), '%Y-%m-%d') AS last_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def entry_slice_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries joined to their slices for dates."""
    day = lambda c: F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd")
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(s, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("n_slices"), day(F.min("l_shipdate")).alias("first_at"), day(F.max("l_shipdate")).alias("last_at"))


@query("""SELECT c_custkey FROM customer WHERE (c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) OR c_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def semi_any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that meet the other side in any key, without those that are linked already."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    linked = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.any_key(c, s, ["c_nationkey", "c_custkey"], "c_custkey").join(linked, "c_custkey", "left_anti").select("c_custkey")


RANGES = """a AS (SELECT conv_id, min(turn) + 1 AS s, max(turn) + 1 AS e, role AS id FROM conversations GROUP BY conv_id, role), b AS (SELECT conv_id, turn // 2 AS id, min(turn) + 1 AS s, max(turn) + 1 AS e FROM conversations GROUP BY conv_id, turn // 2)"""


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, sf_dir, "conversations").withColumn("i", F.col("turn") + 1)
    span = [F.min("i").alias("start"), F.max("i").alias("end")]
    return m.groupBy("conv_id", F.col("role").alias("id")).agg(*span), m.groupBy("conv_id", F.floor(F.col("turn") / 2).alias("id")).agg(*span)


@query(f"WITH {RANGES} SELECT a.conv_id, a.id AS a_id, CAST(min(b.id) AS BIGINT) AS b_id FROM a JOIN b ON a.conv_id = b.conv_id AND a.s <= b.e AND b.s <= a.e GROUP BY ALL")
def range_overlap_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic ranges and the first chunk they overlap in their window."""
    return relations.overlaps(*_ranges(spark, sf_dir), on="conv_id", first=True)


@query(f"WITH {RANGES} SELECT a.conv_id, a.id AS a_id, CAST(b.id AS BIGINT) AS b_id FROM a JOIN b ON a.conv_id = b.conv_id AND a.s <= b.e + 2 AND b.s <= a.e + 2")
def range_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges within a padding of two."""
    return relations.overlaps(*_ranges(spark, sf_dir), on="conv_id", pad=2)


@query(f"WITH {RANGES} SELECT c.conv_id, c.turn, count(*) AS n_chunks FROM conversations c JOIN a ON a.conv_id = c.conv_id AND c.turn + 1 BETWEEN a.s AND a.e GROUP BY ALL")
def point_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages inside ranges."""
    a, _ = _ranges(spark, sf_dir)
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return m.join(a, "conv_id").where((F.col("turn") + 1).between(F.col("start"), F.col("end"))).groupBy("conv_id", "turn").agg(F.count("*").alias("n_chunks"))


@query("""SELECT p_partkey, CAST(8 * CAST(p_size IN (1, 5, 9) AS INT) + 10 * CAST(p_brand IN ('Brand#11', 'Brand#23') AS INT) + 6 * CAST(p_type LIKE '%STEEL%' AS INT) AS BIGINT) AS points FROM part
  WHERE p_size IN (1, 5, 9) OR p_brand IN ('Brand#11', 'Brand#23') OR p_type LIKE '%STEEL%'""")
def signal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows scored against small sets of signals."""
    points = F.when(F.col("p_size").isin(1, 5, 9), 8).otherwise(0) + F.when(F.col("p_brand").isin("Brand#11", "Brand#23"), 10).otherwise(0) + F.when(F.col("p_type").contains("STEEL"), 6).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", points.cast("long").alias("points")).where("points > 0")


@query("""SELECT 'document_without_label' AS rule, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT 'customer_without_order', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def referential_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a target, both ways."""
    d, lb = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    return (
        count(relations.missing(d, lb, "doc_id", "doc_id"), "document_without_label").unionByName(count(relations.missing(lb, d, "doc_id", "doc_id"), "label_without_document"))
        .unionByName(count(relations.missing(c, o, "k", "k"), "customer_without_order"))
    )


@query("""SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN s_nationkey ELSE c_nationkey END AS nation, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS name, s_suppkey IS NOT NULL AS overridden FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def override_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given merges win over computed ones."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return relations.overridden(c, s, "c_custkey", ["nation", "name"])


@query(r"""WITH n AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[\s,.]+'), lambda x: length(x) >= 4)) AS terms, length(text) // 40 AS band FROM benchmark), t AS (SELECT item_id, band, unnest(terms) AS term FROM n),
  s AS (SELECT a.item_id AS a_id, b.item_id AS b_id, round(0.18 * least(count(*), 6) + CASE WHEN any_value(a.band) = any_value(b.band) THEN 0.9 ELSE 0 END, 4) AS score FROM t a JOIN t b ON a.term = b.term AND a.item_id <> b.item_id GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS rank FROM s WHERE score >= 0.3) SELECT * FROM r WHERE rank <= 3""")
def nearby_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest rows among those that share a term."""
    terms = F.array_distinct(F.filter(F.split(F.lower("text"), r"[\s,.]+"), lambda x: F.length(x) >= 4))
    n = table(spark, sf_dir, "benchmark").select("item_id", terms.alias("terms"), F.floor(F.length("text") / 40).alias("band"))
    score = F.round(0.18 * F.least(F.col("n_shared"), F.lit(6)) + F.when(F.col("a.band") == F.col("b.band"), 0.9).otherwise(0.0), 4)
    return relations.nearest(n, "item_id", "terms", score, 0.3, 3).select("a_id", "b_id", "score", F.col("rank").cast("long").alias("rank"))


_MEMOS = r"""d AS (SELECT item_id, lower(text) AS t, substring(text, 1, 20) AS title, 'f' || (item_id % 3) AS family, 's' || (length(text) // 40) AS memory_shape FROM benchmark),
  v AS (SELECT item_id, 'terms' AS kind, unnest(list_filter(string_split_regex(t, '[\s,.]+'), lambda x: length(x) >= 5)) AS v FROM d UNION SELECT item_id, 'triggers', unnest(list_filter(string_split_regex(t, '[\s,.]+'), lambda x: length(x) = 4)) FROM d
    UNION SELECT item_id, 'bigrams', unnest(list_transform(range(1, least(length(t), 31)), lambda i: substring(t, i, 2))) FROM d),
  n AS (SELECT a.item_id AS x, b.item_id AS y, count(*) FILTER (kind = 'terms') AS te, count(*) FILTER (kind = 'triggers') AS tr, count(*) FILTER (kind = 'bigrams') AS bi FROM v a JOIN v b USING (kind, v) WHERE a.item_id <> b.item_id GROUP BY a.item_id, b.item_id),
  p AS (SELECT x, y, a.family = b.family AS f, a.memory_shape = b.memory_shape AS m, te, tr, bi, b.title FROM n JOIN d a ON a.item_id = x JOIN d b ON b.item_id = y)"""


def memos(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    words = F.split(t, r"[\s,.]+")
    return table(spark, sf_dir, "benchmark").select(
        "item_id", F.left("text", F.lit(20)).alias("title"), F.concat(F.lit("f"), (F.col("item_id") % 3).cast("string")).alias("family"), F.concat(F.lit("s"), F.floor(F.length("text") / 40).cast("string")).alias("memory_shape"),
        F.filter(words, lambda x: F.length(x) >= 5).alias("terms"), F.filter(words, lambda x: F.length(x) == 4).alias("triggers"), ngrams(F.left(t, F.lit(31)), 2, None).alias("bigrams"), *(F.array().cast("array<string>").alias(c) for c in ("slices", "refs", "scenes", "topics")),
    )


@query(f"""WITH {_MEMOS}, s AS (SELECT *, round(0.5 * f::INT + 1.4 * m::INT + 0.9 * least(te, 3) + 0.18 * least(bi, 10) + 1.2 * least(tr, 2), 4) AS score FROM p), r AS (SELECT x AS a_id, y AS b_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY x ORDER BY score DESC, title, y) AS rank FROM s WHERE score >= 2.2) SELECT * FROM r WHERE rank <= 3""")
def memo_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest memos of each, by the weights of nearby links."""
    return relations.affinity(memos(spark, sf_dir), "item_id", *relations.NEARBY).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_MEMOS}, s AS (SELECT *, round(0.4 * f::INT + 0.9 * m::INT + 0.18 * least(te, 6) + 0.08 * least(bi, 8) + 0.75 * least(tr, 3), 4) AS score FROM p), r AS (SELECT x AS a_id, y AS b_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY x ORDER BY score DESC, title, y) AS rank FROM s WHERE score >= 1.5) SELECT * FROM r WHERE rank <= 5""")
def memo_compaction_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the second formula, by which memos are compacted: the five nearest with 1.5 points."""
    return relations.affinity(memos(spark, sf_dir), "item_id", *relations.COMPACT, least=1.5, most=5).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""")
def scope_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scopes with what each layer holds; the layers are counted before they meet."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.countDistinct("c_custkey").alias("customers"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.countDistinct("s_suppkey").alias("suppliers"))
    return n.join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").select("n_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


@query("""WITH r AS (SELECT conv_id, turn, text FROM conversations), c AS (SELECT conv_id, count(DISTINCT turn) AS n FROM r GROUP BY conv_id)
  SELECT r.conv_id, r.turn, CASE WHEN n < 3 THEN 'census_incomplete' WHEN role = 'user' THEN 'exact' WHEN role = 'assistant' THEN 'role_mismatch' ELSE 'role_other' END AS status FROM conversations r JOIN c USING (conv_id)""")
def lineage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact's message in the census, and the role that it should have."""
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    n = m.groupBy("conv_id").agg(F.countDistinct("turn").alias("n"))
    status = F.when(F.col("n") < 3, "census_incomplete").when(F.col("role") == "user", "exact").when(F.col("role") == "assistant", "role_mismatch").otherwise("role_other")
    return m.join(n, "conv_id").select("conv_id", "turn", status.alias("status"))


@query("""SELECT conv_id, coalesce(string_agg(DISTINCT role, '|' ORDER BY role), '') AS roles, count(*) AS n_spans, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS primary_spans FROM conversations GROUP BY conv_id""")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each window."""
    m = table(spark, sf_dir, "conversations")
    return m.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_set("role")), "|").alias("roles"), F.count("*").alias("n_spans"), F.count_if(F.col("role") == "user").alias("primary_spans"))
