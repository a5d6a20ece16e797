"""Review of roots, notes and bundles: evidence items with weights, slots of lines, noise filters, inspection of bundles, pending tasks, families and leaf profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.nested import walk
from threadloom.functions.text import clip_note, compact, compact_words, distinct_exact, first_text, let, safe_text
from threadloom.sources.shared import held, spread

from .contract import read_normalised
from .recall import PLAIN_TAGS, kind_of, person_like
from .signals import semantic_key

#: Weights of evidence, for rules and for other roots; a person-like reference and a person tag of a rule weigh less.
WEIGHTS = {
    "root_name": (0.76, 1.0), "stable_fact": (0.84, 0.92), "atomic_fingerprint": (0.58, 0.82), "atomic_fact": (0.98, 1.06), "atomic_key": (0.8, 0.48), "atomic_title": (0.56, 0.42), "atomic_tag": (0.44, 0.28),
    "update_summary": (0.46, 0.62), "family_anchor": (0.64, 0.76), "linked_persona": (0.62, 0.8), "linked_persona_tag": (0.22, 0.36), "linked_persona_tag_semantic": (0.34, 0.14), "type_hint": (0.46, 0.4), "type_hint_tag": (0.4, 0.34),
    "type_hint_tag_semantic": (0.36, 0.2), "leaf_hint": (0.18, 0.4), "leaf_hint_tag": (0.14, 0.34), "leaf_hint_tag_semantic": (0.1, 0.18), "related_root": (0.58, 0.58),
}
PERSON_FAMILY, PERSON_PERSONA, PERSON_TAG = 0.18, 0.16, 0.08
#: Slots of lines about the user and of rules, first that fits; triggers that say nothing.
USER_SLOTS = [("称呼|名字|起名|多个名字|用作账号昵称|笔名", "名字与别名"), ("同事|家人|父亲|母亲|弟弟|妹妹", "关系与周边"), ("工作|协作|项目|写作|整理|故事|剧情", "工作与协作")]
RULE_SLOTS = [("写日记|更新人设|记忆|窗口|受限|带到新的对话框", "记忆治理"), ("故事|剧情|整理|协助|干活|写作", "协作与写作")]
USER_REST, RULE_REST = "偏好与价值观", "互动方式"
PLAIN_TRIGGERS = ["人物", "事物", "偏好与价值观", "特性与功能", "事件", "回顾"]
SCALE = "最软|最硬|日常|工作|顶回去"
JOINED = r"跨窗口时间拼接\s*\d+\s*窗口\s*\d+"


def _slot(c: Column, slots: list[tuple[str, str]], rest: str) -> Column:
    out = F.lit(rest)
    for pattern, name in reversed(slots):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def user_slot(c: Column) -> Column:
    return _slot(F.coalesce(c, F.lit("")), USER_SLOTS, USER_REST)


def rule_slot(c: Column) -> Column:
    return _slot(F.coalesce(c, F.lit("")), RULE_SLOTS, RULE_REST)


def noisy_trigger(c: Column) -> Column:
    """Triggers that lead nowhere: blank or up to two letters, names of types, points of a scale, speakers, numbers, names of slices and bundles."""
    t = safe_text(c)
    scale = (t.contains("→") & t.rlike(SCALE)) | t.rlike(rf"^({SCALE})\s*[：:]")
    form = t.rlike(r"(?i)^(user|assistant|tool)$") | t.rlike(r"^\d{1,3}$") | t.rlike(r"(?i)^slice\s*\d+$") | t.rlike(r"(?i)^chat\s+bundle\b") | (~t.rlike(f"^{JOINED}$") & t.rlike(r"__\d{3,}$"))
    return (t == "") | t.isin(PLAIN_TRIGGERS) | scale | (F.length(t) <= 2) | form


def noisy_handle(c: Column) -> Column:
    """Scene handles that are transcripts or joined windows."""
    t = safe_text(c)
    return (t == "") | ((F.length(t) > 88) & t.rlike(r"(?i)\b(user|assistant|tool):")) | t.rlike(r"(跨窗口时间拼接\s+\d+\s+窗口\s+\d{3}\s*){2,}")


def clean_triggers(rows: DataFrame, id_: str, values: str, most: int = 10) -> DataFrame:
    """(id, nth, trigger): the first triggers of each row that are no noise, cut to 84 letters, once for each semantic key."""
    spoken = lambda t: (F.length(t) > 60) & t.rlike(r"(?i)\b(user|assistant|tool):")
    told = lambda t: F.struct(t.alias("trigger"), semantic_key(t).alias("key"), (~noisy_trigger(t) & ~spoken(t)).alias("good"))
    each = rows.select(id_, F.posexplode(F.transform(values, lambda raw: let(clip_note(raw, 84), told))).alias("at", "x")).select(id_, "at", "x.*").where("good AND key <> ''")
    once = each.groupBy(id_, "key").agg(F.min_by("trigger", "at").alias("trigger"), F.min("at").alias("at"))
    nth = F.row_number().over(Window.partitionBy(id_).orderBy("at"))
    return once.withColumn("nth", nth).where(F.col("nth") <= most).select(id_, "nth", "trigger")


def is_tree_export(c: Column) -> Column:
    """Raw exports whose conversations are ``mapping`` trees: such files are refused, not parsed."""
    v = F.try_parse_json(c)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.conversations", "array<variant>"), F.array(v))
    tree = lambda x: F.coalesce(F.try_variant_get(x, "$.mapping", "map<string,variant>").isNotNull() | F.try_variant_get(x, "$.mapping", "array<variant>").isNotNull(), F.lit(False))
    return v.isNotNull() & F.coalesce(F.exists(items, tree), F.lit(False))


def tag_meanings(c: Column) -> Column:
    parts = F.transform(F.split(F.regexp_replace(safe_text(c), "^#+", ""), "/"), compact_words)
    return F.filter(parts, lambda x: (F.length(x) >= 2) & ~x.isin(PLAIN_TAGS))


def evidence_items(roots: DataFrame, facts: DataFrame, stable: DataFrame, families: DataFrame, personas: DataFrame, updates: DataFrame, type_hints: DataFrame, leaf_hints: DataFrame, related: DataFrame) -> DataFrame:
    """(root, kind, text, weight, place): what speaks for a root, blank texts left out.

    Inputs as for query terms, facts with ``fact_role``, hints as (root, place, tag, effect), related roots as (root, place, title). Rules weigh by a column of their own.
    """
    kinds = roots.select("root", (kind_of("anchor_type") == "rule").alias("rule"))
    weight = lambda kind: F.when(F.col("rule"), WEIGHTS[kind][0]).otherwise(WEIGHTS[kind][1])
    one = lambda kind, c, w=None: F.array(F.struct(F.lit(kind).alias("kind"), safe_text(c).alias("text"), (weight(kind) if w is None else w).alias("weight")))
    none = F.array().cast("array<struct<kind:string,text:string,weight:double>>")
    tags = F.coalesce("tags", F.array().cast("array<string>"))

    def tagged(kind: str, each: str | None, xs: Column, w=None) -> Column:
        whole = F.transform(F.filter(xs, lambda t: safe_text(t).contains("/")), lambda t: F.struct(F.lit(each).alias("kind"), safe_text(t).alias("text"), (weight(each) if w is None else w(t)).alias("weight"))) if each else none
        return F.concat(whole, F.flatten(F.transform(xs, lambda t: F.transform(tag_meanings(t), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("text"), weight(kind).alias("weight"))))))

    def hint(kind: str) -> Column:
        return F.concat(one(kind, "effect"), F.when(safe_text("tag").contains("/"), one(f"{kind}_tag", "tag")).otherwise(none), tagged(f"{kind}_tag_semantic", None, F.array(F.coalesce("tag", F.lit("")))))

    sketch = F.lower(safe_text("fact_role")) == "fingerprint_candidate"
    fact = F.concat(F.when(sketch, one("atomic_fingerprint", "fact_value")).otherwise(one("atomic_fact", "fact_value")), one("atomic_key", F.replace(safe_text("fact_key"), F.lit("_"), F.lit(" "))), one("atomic_title", "title"), tagged("atomic_tag", None, tags))
    person = lambda c, w, kind, t=None: F.when(F.col("rule") & person_like(F.col(c), t), w).otherwise(weight(kind))
    persona = F.concat(
        one("linked_persona", "title", person("title", PERSON_PERSONA, "linked_persona", tags)),
        tagged("linked_persona_tag_semantic", "linked_persona_tag", tags, lambda t: F.when(F.col("rule") & safe_text(t).startswith("#人物"), PERSON_TAG).otherwise(weight("linked_persona_tag"))),
    )
    parts = [
        (roots.drop("anchor_type").withColumn("place", F.lit(0)), one("root_name", "canonical_name")), (stable, one("stable_fact", "text")), (facts, fact), (updates, one("update_summary", "summary")),
        (families, one("family_anchor", "title", person("title", PERSON_FAMILY, "family_anchor"))), (personas, persona), (type_hints, hint("type_hint")), (leaf_hints, hint("leaf_hint")), (related, one("related_root", "title")),
    ]
    kinds = held(kinds)
    found = [spread(df, "root").join(kinds, "root").select("root", F.col("place").cast("long").alias("place"), F.inline(xs)) for df, xs in parts]
    return reduce(DataFrame.unionByName, found).where("text <> ''").select("root", "kind", "text", F.col("weight").cast("double").alias("weight"), "place")


def inspected(bundles: DataFrame, id_: str, json: str, old_field: str = "old_import_policy", samples: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of bundles: (id, status, readiness, accepted, rejected, hold, spans, bounded_spans, cards_without_refs, complete); (id, ledger, reason, n); and the first rows of each ledger."""
    read = held(read_normalised(bundles, id_, json, old_field)[0].select(id_, "ok", "json"))
    v = F.try_parse_json("json")
    size = lambda k: F.coalesce(F.size(F.try_variant_get(v, f"$.{k}", "array<variant>")), F.lit(0)).cast("long")
    told = read.select(id_, "ok", *(size(k).alias(n) for k, n in (("warm_cards", "accepted"), ("rejected_ledger", "rejected"), ("hold_ledger", "hold"), ("source_spans", "spans"))))
    nodes = held(walk(read, id_, "json").where(F.col("shape").isin("$.source_spans[]", "$.warm_cards[]", "$.rejected_ledger[]", "$.hold_ledger[]")))
    get = lambda p, t="string": F.try_variant_get("value", f"$.{p}", t)
    bounded = nodes.where((F.col("shape") == "$.source_spans[]") & (get("bounds.start", "double") >= 0) & (get("bounds.end", "double") > get("bounds.start", "double"))).groupBy(id_).agg(F.count("*").alias("bounded_spans"))
    refs = lambda k: F.coalesce(F.size(get(f"source_refs.{k}", "array<string>")), F.lit(0)) == 0
    bare = nodes.where((F.col("shape") == "$.warm_cards[]") & (refs("source_span_ids") | refs("source_occurrence_ids"))).groupBy(id_).agg(F.count("*").alias("cards_without_refs"))
    rows, ledgers = F.col("accepted"), F.col("rejected") + F.col("hold")
    status = F.when(~F.col("ok"), "invalid_bundle").when(rows + ledgers > 0, "valid_bundle").otherwise("valid_empty_bundle")
    ready = F.when(~F.col("ok"), "blocked_by_contract_errors").when(rows + ledgers == 0, "nothing_to_project").when(ledgers > 0, "ready_with_review_ledgers").otherwise("ready")
    out = told.join(bounded, id_, "left").join(bare, id_, "left").fillna(0, ["bounded_spans", "cards_without_refs"])
    out = out.select(id_, status.alias("status"), ready.alias("readiness"), "accepted", "rejected", "hold", "spans", "bounded_spans", "cards_without_refs", (F.col("ok") & (F.col("cards_without_refs") == 0)).alias("complete"))
    ledger = nodes.where(F.col("shape").isin("$.rejected_ledger[]", "$.hold_ledger[]")).select(id_, F.regexp_extract("shape", r"^\$\.(\w+)_ledger", 1).alias("ledger"), "place", first_text(get("reason"), F.lit("unknown")).alias("reason"), safe_text(get("ledger_id")).alias("ledger_id"), safe_text(get("title")).alias("title"))
    reasons = ledger.groupBy(id_, "ledger", "reason").agg(F.count("*").alias("n"))
    return out, reasons, ledger.where(F.col("place") < samples).select(id_, "ledger", F.col("place").cast("long").alias("place"), "reason", "ledger_id", "title")


def next_tasks(tasks: DataFrame, packet: str) -> DataFrame:
    """(packet, next_task, next_status, last_applied): the first pending task of each packet (scope, task, place, status, applied_at), else the first submitted one; the one applied last, the first of equals."""
    first = lambda s: F.min_by("task", F.when(F.col("status") == s, F.col("place")))
    applied = F.max_by("task", F.when(F.coalesce("applied_at", F.lit("")) != "", F.struct("applied_at", -F.col("place"))))
    per = tasks.groupBy(packet).agg(first("pending").alias("p"), first("submitted").alias("s"), applied.alias("last_applied"))
    return per.select(packet, F.coalesce("p", "s").alias("next_task"), F.when(F.col("p").isNotNull(), "pending").when(F.col("s").isNotNull(), "submitted").alias("next_status"), "last_applied")


def families(rows: DataFrame, most_files: int = 12) -> DataFrame:
    """(key, family_id, kind, anchor_id, title, reason, persona_count, sql_count, layers, source_files) of reviewed rows (place, family_id, family_kind, family_anchor_id, family_title, family_reason, layer, source_file).

    A family is its id, else its title in compact form; rows with neither have none. Attributes are the first that are not blank, in order; layers and files are ordered without repeats.
    """
    title = compact("family_title")
    key = F.when(safe_text("family_id") != "", safe_text("family_id")).when(title != "", F.concat(F.lit("family_title::"), title))
    first = lambda c: F.coalesce(F.min_by(safe_text(c), F.when(safe_text(c) != "", F.col("place"))), F.lit(""))
    ordered = lambda c, n: F.slice(distinct_exact(F.transform(F.array_sort(F.collect_set(F.struct("first_", c))), lambda x: x[c]), None), 1, n)
    keyed = rows.withColumn("key", key).where("key IS NOT NULL")
    facts = keyed.groupBy("key").agg(
        first("family_id").alias("family_id"), first_text(first("family_kind"), F.lit("persona_sql_family")).alias("kind"), first("family_anchor_id").alias("anchor_id"), first("family_title").alias("title"), first("family_reason").alias("reason"),
        F.count_if(F.col("layer") == "persona").alias("persona_count"), F.count_if(F.col("layer") == "sql").alias("sql_count"),
    )
    lists = [keyed.groupBy("key", c).agg(F.min("place").alias("first_")).groupBy("key").agg(ordered(c, n).alias(f"{c}s")) for c, n in (("layer", 6), ("source_file", most_files))]
    return facts.join(lists[0], "key").join(lists[1], "key")


def linked_personas(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """(asked, member columns): persona rows of the families that are asked for (asked, family_id, family_title), each (family, file, row, reference) once; the first by place."""
    wanted = refs.select("asked", first_text("family_id", "family_title").alias("key")).where("key <> ''").distinct()
    members = rows.where("layer = 'persona'").withColumn("key", first_text("family_id", "family_title")).where("key <> ''")
    rest = [c for c in rows.columns if c not in ("family_id", "source_file", "row_no", "source_ref")]
    row = ["family_id", "source_file", "row_no", "source_ref"]
    once = members.groupBy("key", *row).agg(F.min_by(F.struct(*rest), "place").alias("r"))  # a family comes down to its members before it meets who asks
    best = wanted.join(once, "key").groupBy("asked", *row).agg(F.min_by("r", "r.place").alias("r"))
    return best.select("asked", "family_id", "source_file", "row_no", "source_ref", *(F.col(f"r.{c}").alias(c) for c in rest))


def merged_leaves(previous: DataFrame, incoming: DataFrame, replace: bool = False, most: int = 24) -> DataFrame:
    """Leaf profiles (bot, display_name, persona_summary, style_notes, memory_notes, prompt_fragments) after a write: the new scalars where they are not blank, and lists after the old ones (or in their place), without repeats, ``most`` of each. Others stay."""
    old = previous.select("bot", *(F.col(c).alias(f"{c}_") for c in previous.columns if c != "bot"))
    both = old.join(incoming.withColumn("written_", F.lit(True)), "bot", "full").withColumn("written_", F.coalesce("written_", F.lit(False)))
    texts, lists = ("display_name", "persona_summary"), ("style_notes", "memory_notes", "prompt_fragments")
    none = F.array().cast("array<string>")
    kept = lambda c: F.when(F.lit(replace) & F.col("written_"), F.coalesce(c, none)).otherwise(F.concat(F.coalesce(f"{c}_", none), F.coalesce(c, none)))
    return both.select("bot", *(first_text(c, f"{c}_").alias(c) for c in texts), *(F.slice(distinct_exact(kept(c), None), 1, most).alias(c) for c in lists))


def without_drafts(cards: DataFrame, kind: str = "") -> tuple[DataFrame, DataFrame]:
    """Cards that stay when drafts (of one type, or of all) are cleared, and (n_cleared)."""
    draft = F.coalesce((F.lower(safe_text("status")) == "draft") & (F.lit(kind == "") | (first_text("card_type", F.lit("memo")) == kind)), F.lit(False))
    return cards.where(~draft), cards.agg(F.count_if(draft).alias("n_cleared"))
