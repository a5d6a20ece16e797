"""Reply trees to training conversations: iterative self-joins, branch ranking, one formatted text per chosen path.

``reply_paths`` works on a table of messages (tree_id, node, parent, role, text, score). Ancestors are found by
pointer doubling, a self-join on (tree_id, node) for each power of two, so a thread of a thousand replies takes
ten joins instead of a thousand; only ids travel through these joins, texts are joined once at the end.

Defined results: a null role or text is empty; messages whose tree_id is null are left out (``as_tree`` wraps its ids); a parent that does not exist makes a root; repeated (tree_id, node)
rows keep the least (parent, role, text); equal scores go to the longer, then to the smaller leaf; an empty table gives
an empty result; other columns of the input are ignored whatever their names. Messages on a cycle reach no root and
form no path. A formatted conversation is one string, so the messages of one chosen path meet in one row by nature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, table

#: Fixed values of the template: a turn is ``[turn ROLE]TEXT[/turn]``, an assistant's is followed by ``</s>``.
BOS, EOS, OPEN, SHUT, CLOSE = "<s>", "</s>", "[turn ", "]", "[/turn]"
#: Characters that control strings are made of, and what stands for them inside roles and texts; the order matters.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("[", "&lsqb;"), ("]", "&rsqb;"))
TURN = r"\[turn ([^\[\]]*)\]([^\[\]<]*)\[/turn\]"


def escaped(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def reply_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best root-to-leaf paths of each root: tree_id, root, leaf, branch_rank, branch_score, node, depth.

    A branch's score is the mean score of its messages.
    """
    m = messages.select(
        "tree_id", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    ).where("node IS NOT NULL").groupBy("tree_id", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    up = m.select("tree_id", F.col("node").alias("parent"), F.lit(True).alias("there"))
    at = kept(
        m.join(up, ["tree_id", "parent"], "left").select(
            "tree_id", "node", F.when(F.col("there"), F.col("parent")).alias("anc"),
            F.lit(1).cast("long").alias("depth"), "score", F.col("node").alias("top_node"),
        )
    )
    most = at.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    hops = []  # hops[k]: each node's ancestor 2**k steps up
    for _ in range(max(1, math.ceil(math.log2(max(2, most))))):  # a cycle never ends by itself, a tree ends with its depth
        if hops and at.where("anc IS NOT NULL").isEmpty():
            break
        hops.append(at.where("anc IS NOT NULL").select("tree_id", "node", "anc"))
        far = at.select(
            "tree_id", F.col("node").alias("anc"), F.col("anc").alias("far"), F.col("depth").alias("more"),
            F.col("score").alias("plus"), F.col("top_node").alias("far_top"),
        )
        further = at.join(far, ["tree_id", "anc"]).select(  # nodes that have met their root take no further part
            "tree_id", "node", F.col("far").alias("anc"), (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("score") + F.col("plus")).alias("score"), F.col("far_top").alias("top_node"),
        )
        at = kept(at.where("anc IS NULL").unionByName(further))
    done = at.where("anc IS NULL")
    inner = hops[0].select("tree_id", F.col("anc").alias("node")).distinct()
    order = Window.partitionBy("tree_id", "root").orderBy(F.desc("branch_score"), F.desc("leaf_depth"), "leaf")
    chosen = (
        done.join(inner, ["tree_id", "node"], "left_anti")
        .select("tree_id", F.col("top_node").alias("root"), F.col("node").alias("leaf"), F.col("depth").alias("leaf_depth"), (F.col("score") / F.col("depth")).alias("branch_score"))
        .withColumn("branch_rank", F.row_number().over(order)).where(F.col("branch_rank") <= top)
    )
    on_path = kept(chosen.select("tree_id", "root", "leaf", "branch_rank", "branch_score", F.col("leaf").alias("node"), F.col("leaf_depth").alias("depth")))
    for k, hop in enumerate(hops):
        above = on_path.join(hop, ["tree_id", "node"]).select(
            "tree_id", "root", "leaf", "branch_rank", "branch_score", F.col("anc").alias("node"), (F.col("depth") - 2**k).alias("depth")
        )
        on_path = kept(on_path.unionByName(above))
    return on_path


def format_paths(paths: DataFrame, messages: DataFrame) -> DataFrame:
    """One row per path: its keys, ``formatted``, and ``loss_spans`` (code points, end exclusive) over the assistants' texts."""
    texts = messages.where("node IS NOT NULL").select(
        "tree_id", "node", F.col("parent").alias("parent_"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).groupBy("tree_id", "node").agg(F.min(F.struct("parent_", "role", "text")).alias("m")).select("tree_id", "node", "m.role", "m.text")
    keys = ["tree_id", "root", "leaf"]
    learnt = F.col("role") == "assistant"
    head, body = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SHUT)), escaped(F.col("text"))
    before = Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        paths.join(texts, ["tree_id", "node"])
        .withColumn("head", F.length(head)).withColumn("body", F.length(body))
        .withColumn("piece", F.concat(head, body, F.lit(CLOSE), F.when(learnt, F.lit(EOS)).otherwise(F.lit(""))))
        .withColumn("at", F.lit(len(BOS)) + F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)))
        .withColumn("span", F.when(learnt, F.struct((F.col("at") + F.col("head")).alias("start"), (F.col("at") + F.col("head") + F.col("body")).alias("end"))))
    )
    turns = F.array_sort(F.collect_list(F.struct("depth", "piece", "span")))
    return pieces.groupBy(*keys, "branch_rank", "branch_score").agg(turns.alias("turns")).select(
        *keys, "branch_rank", "branch_score",
        F.concat(F.lit(BOS), F.array_join("turns.piece", "")).alias("formatted"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``roles``, ``texts`` and ``loss_text``, all parsed from the formatted text and its spans."""
    part = lambda k: F.transform(F.regexp_extract_all("formatted", F.lit(TURN), F.lit(k)), unescaped)
    cut = lambda s: unescaped(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return formatted.withColumns({"roles": part(1), "texts": part(2), "loss_text": F.array_join(F.transform("loss_spans", cut), "")})


def as_tree(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as trees: each row replies to the one before; equal turns stand by role, then text.

    One conversation's turns are numbered in one task, which sorts ids and roles by way of spilling; they meet in one row
    at the end anyway. The tree_id is a struct around conv_id, so that rows without one form a conversation too (a null key joins nothing).
    """
    rows = conversations.select(F.struct("conv_id").alias("tree_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = F.row_number().over(Window.partitionBy("tree_id").orderBy("turn", "role", "text"))
    return rows.select("tree_id", n.cast("long").alias("node"), "role", "text").select(
        "tree_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").alias("score")
    )


def op2_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = as_tree(rows)
    out = read_back(format_paths(reply_paths(messages), messages))
    turns = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n"))), "")
    return out.select(
        F.col("tree_id.conv_id").alias("conv_id"), F.size("roles").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(text) + 4 * (length(text) - length(replace(text, '&', ''))) + 3 * (length(text) - length(replace(replace(text, '<', ''), '>', '')))
    + 5 * (length(text) - length(replace(replace(text, '[', ''), ']', '')))
    + length(role) + 4 * (length(role) - length(replace(role, '&', ''))) + 3 * (length(role) - length(replace(replace(role, '<', ''), '>', '')))
    + 5 * (length(role) - length(replace(replace(role, '[', ''), ']', '')))
    + 14 + CASE WHEN role = 'assistant' THEN 4 ELSE 0 END AS piece FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(piece) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
