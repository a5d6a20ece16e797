"""Scores, classes and hints from text and small sets of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import compact, compact_words, safe_text

#: Names that decisions go by.
DECISIONS = {"new": ("new", "create"), "update": ("update", "patch", "revise"), "rewrite": ("rewrite", "rewrite_card"), "merge": ("merge", "merge_into"), "skip": ("skip", "hold"), "delete": ("delete", "archive")}
#: What keys of services and private absolute paths look like.
KEY_LIKE = r"sk-[A-Za-z0-9_-]{20,}"
PRIVATE_PATH = r"""/(?:Users|home|srv)/[^\s"'`]+|[A-Za-z]:[\\/][^\s"'`]+|\\\\[^\\\s"'`]+\\[^\\\s"'`]+"""
#: Weights of the six kinds of evidence and of an equal window, and what a kind needs to count as support.
EVIDENCE = {"name": 0.14, "stable": 0.18, "atomic": 0.24, "family": 0.18, "hint": 0.08, "related": 0.06}
WINDOW_MATCH, SUPPORT = 0.18, 0.18


def decision(c: Column | str) -> Column:
    """The decision that an alias stands for; another word stays, nothing is ``touch``."""
    t = F.lower(safe_text(c))
    out = F.when(t == "", "touch").otherwise(t)
    for name, aliases in DECISIONS.items():
        out = F.when(t.isin(*aliases), name).otherwise(out)
    return out


def privacy_hit(c: Column | str) -> Column:
    """Why a text must not leave: a key, else a private path, else null."""
    t = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.when(t.rlike(KEY_LIKE), "secret_like_api_key").when(t.rlike(PRIVATE_PATH), "absolute_private_path")


def needle_score(text: Column, needles: list[str]) -> Column:
    """Needles of three letters and more weigh two, shorter ones one."""
    whole = compact_words(text)
    return sum((F.when(whole.contains(n), 2 if len(n) >= 3 else 1).otherwise(0) for n in needles), F.lit(0))


def semantic_key(c: Column | str) -> Column:
    """Lower-case words without roles, short numbers and marks."""
    t = F.lower(safe_text(c))
    for pattern in (r"\b(user|assistant|tool|chat|bundle)\b", r"\b\d{1,3}\b", r"[·:：,，、;；.。!?！？\"'“”‘’()\[\]{}<>《》【】/\\_-]+", r"\s+"):
        t = F.regexp_replace(t, pattern, " ")
    return safe_text(t)


def alignment(kinds: dict[str, Column], window: Column, shadows: Column) -> tuple[Column, Column, Column]:
    """Score of an evidence item, how many kinds support it, and its class."""
    score = F.round(F.least(F.lit(1.0), sum((w * kinds[k] for k, w in EVIDENCE.items()), F.lit(0.0)) + F.when(window, WINDOW_MATCH).otherwise(0.0)), 4)
    hits = sum(((kinds[k] >= SUPPORT).cast("int") for k in EVIDENCE), F.lit(0)) + window.cast("int")
    aligned = ((score >= 0.4) & (hits >= 2)) | (score >= 0.55) | (window & (score >= 0.32) & (hits >= 2))
    partial = ((score >= 0.22) & (hits >= 1)) | (score >= 0.3) | (window & (hits >= 1))
    return score, hits, F.when(shadows == 0, "no_shadow").when(aligned, "aligned").when(partial, "partial").otherwise("weak")


def chunk_plan(is_chat: Column, chars: Column) -> dict[str, Column]:
    """Sizes that a source is best cut with, by its kind and length."""
    by_size = lambda a, b, c: F.when(chars > 18000, a).when(chars > 9000, b).otherwise(c)
    target = F.when(is_chat, by_size(2400, 2200, 1800)).otherwise(by_size(3200, 2800, 2200))
    slices = F.when(is_chat, 2).otherwise(1)
    return {"target_chars": target, "max_slices": slices, "max_chars": target * slices + 600, "estimated_slices": F.when(chars > 0, F.greatest(F.lit(1), F.ceil(chars / target))).otherwise(0)}


def affix_matches(names: DataFrame, tokens: DataFrame, most: int = 4) -> DataFrame:
    """Names (id, name) that equal a token (token_id, token), or begin or end with it with 1 to ``most`` letters more.

    Both cases are met by equal keys: every name gives itself and its cuts. Names and their cuts are never broadcast, whatever Spark takes their size for.
    """
    whole = compact("name")
    cuts = F.array_distinct(F.flatten(F.array(
        F.array(whole), F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.left(whole, F.greatest(F.length(whole) - k, F.lit(0)))),
        F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.right(whole, F.greatest(F.length(whole) - k, F.lit(0)))),
    )))
    spelled = names.select(whole.alias("name")).distinct()  # names that are spelled alike are cut and looked up once
    whole_cuts = spelled.select("name", F.explode(F.filter(cuts, lambda x: F.length(x) >= 2)).alias("key"))
    met = whole_cuts.hint("merge").join(tokens.select("token_id", compact("token").alias("key")), "key").select("name", "token_id").distinct()
    return names.select("id", whole.alias("name")).hint("merge").join(met, "name").select("id", "token_id").distinct()


def with_fallback(rows: DataFrame, scope: str, rank: str) -> DataFrame:
    """Rows of the best source (least rank) that each scope has."""
    best = rows.groupBy(F.col(scope).alias("scope_")).agg(F.min(rank).alias("best_"))  # partial minima travel, not a scope's rows
    return rows.join(best, F.col(scope).eqNullSafe(F.col("scope_")) & (F.col(rank) == F.col("best_")), "left_semi")


def numbered_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Equal names get ``_002``, ``_003`` and so on in order, the first stays; past 999 there is none left (null)."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("file_name", F.when(n == 1, F.col(name)).when(n <= 999, F.concat(F.col(name), F.lit("_"), F.lpad(n.cast("string"), 3, "0"))))
