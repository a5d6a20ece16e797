"""Row normalising, row predicates and row relevance: small column expressions that scans and rankings share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import WHITE, compact, distinct_compact, epoch_seconds, first_text, let, safe_text

#: Names of the anchor types, and names that say nothing.
ANCHORS = {"person": "人物", "thing": "事物", "event": "事件", "rule": "规则", "time": "时间"}
GENERIC = ["感觉", "感受", "重要", "修改", "变化", "记录", "事件", "关系", "规则", "偏好", "状态", "情况", "内容", "信息", "想法", "问题", "体验", "东西"]
PLAIN_DATE = r"^(\d{4}[-/.年]\d{1,2}([-./月]\d{1,2}日?)?|\d{4}年\d{1,2}月(\d{1,2}日)?|\d{1,2}月\d{1,2}日)$"
#: Who speaks for the companion in quote references.
COMPANION = ["char", "assistant", "bot", "companion"]
#: Sentences of a user that state a rule.
RULE_LINES = ["我希望你", "我不会对你进行主观塑造", "如果你察觉", "在我们对话框结束之前", "保留独立性", "提示我交流即将受限"]
MONTH = r"(\d{4})[-/.年](\d{1,2})"


def reviewed_layer(explicit: Column, *card_columns: Column) -> Column:
    """The layer that a row names; ``sql`` if it has none but a card column; else ``unknown``."""
    said = F.lower(explicit)
    return F.when(said.isin("persona", "sql", "case"), said).when(first_text(*card_columns) != "", "sql").otherwise("unknown")


def anchor_type(c: Column | str) -> Column:
    """The loose variant: a type's own name, or any text that holds its other name."""
    t, out = F.lower(safe_text(c)), F.lit("unknown")
    for name, other in reversed(ANCHORS.items()):
        out = F.when((t == name) | t.contains(other), name).otherwise(out)
    return out


def exact_anchor_type(c: Column | str) -> Column:
    """The strict variant: equal to a name of one of four types, or empty."""
    t, out = F.lower(safe_text(c)), F.lit("")
    for name in ("rule", "event", "thing", "person"):
        out = F.when(t.isin(name, ANCHORS[name]), name).otherwise(out)
    return out


def is_plain_date(c: Column | str) -> Column:
    return safe_text(c).rlike(PLAIN_DATE)


def is_generic(c: Column | str) -> Column:
    """Blank, a plain date, or a text that begins with a word that says nothing."""
    t = compact(c)
    begins = F.lit(False)
    for w in GENERIC:
        begins = begins | t.startswith(w)
    return (t == "") | is_plain_date(c) | begins


def first_month(c: Column | str) -> Column:
    """``YYYY-MM`` of the first month in a text, or null."""
    t = safe_text(c)
    n = F.regexp_extract(t, MONTH, 2)
    return F.when(n != "", F.concat(F.regexp_extract(t, MONTH, 1), F.lit("-"), F.lpad(n, 2, "0")))


def in_months(columns: list[Column], months: list[str]) -> Column:
    """Whether any column's first month is wanted; without wanted months every row is in."""
    if not months:
        return F.lit(True)
    return F.coalesce(F.arrays_overlap(F.array_compact(F.array(*(first_month(c) for c in columns))), F.array(*map(F.lit, months))), F.lit(False))


def is_path_like(t: Column) -> Column:
    return t.contains("/") | t.contains("\\") | t.rlike(r"^[A-Za-z]:[\\/]")


def source_label(c: Column | str) -> Column:
    """A source's name without its folders; ``local_source`` if nothing else is left."""
    t = safe_text(c)
    parts = F.filter(F.split(t, r"[\\/]+"), lambda x: x != "")
    return F.when(is_path_like(t), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("local_source"))).otherwise(t)


def iso_time(c: Column) -> Column:
    """Seconds, or milliseconds above 10**12, as an ISO time; empty for what is no positive number."""
    ms = F.when(c > 1e12, c).otherwise(c * 1000).cast("long")
    utc = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())  # shown as UTC whatever the session's zone
    return F.when(c > 0, F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))).otherwise(F.lit(""))


def quote_lists(c: Column | str) -> Column:
    """Quote references ``role: text; ...`` as a struct of three ordered lists without repeats: ``user``, ``char`` (of the companion) and ``other``."""
    parts = F.filter(F.transform(F.split(safe_text(c), rf"[；;][{WHITE}]*"), safe_text), lambda p: p != "")
    form = rf"^([^:：]{{1,20}})[:：][{WHITE}]*([^\n\r\x{{2028}}\x{{2029}}]+)$"  # on one line
    role = lambda p: compact(F.regexp_extract(p, form, 1))
    who = lambda r: F.when(r == "user", "user").when(r.isin(*COMPANION), "char").otherwise("other")
    said = lambda p: F.when(p.rlike(form), safe_text(F.regexp_extract(p, form, 2))).otherwise(p)
    told = F.transform(parts, lambda p: F.struct(who(role(p)).alias("who"), said(p).alias("text")))
    once = lambda xs, k: distinct_compact(F.transform(F.filter(xs, lambda x: x["who"] == k), lambda x: x["text"]), None).alias(k)
    return let(told, lambda xs: F.struct(*(once(xs, k) for k in ("user", "char", "other"))))  # roles are told once for all three


def quotes(c: Column | str) -> dict[str, Column]:
    """The lists of ``quote_lists`` one by one."""
    return {k: quote_lists(c)[k] for k in ("user", "char", "other")}


def utterances(rows: DataFrame, key: str, text: str, speaker: str = "assistant") -> DataFrame:
    """(key, nth, window_title, text): what a speaker says in slices of lines ``[window] role: text``, continued lines included.

    A line belongs to the last header before it, which is a running count within its slice.
    """
    head = r"(?i)^\[([^\]]+)\]\s*(assistant|user|system)\s*:\s*(.*)$"
    lines = rows.select(key, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("at", "line"))
    by = Window.partitionBy(key).orderBy("at")
    is_head = F.col("line").rlike(head)
    numbered = lines.withColumn("nth", F.sum(is_head.cast("long")).over(by)).where("nth > 0").withColumn("head", is_head)
    said = F.when(F.col("head"), safe_text(F.regexp_extract("line", head, 3))).otherwise(F.col("line"))
    groups = numbered.groupBy(key, "nth").agg(
        F.max(F.when(F.col("head"), F.struct(safe_text(F.regexp_extract("line", head, 1)).alias("title"), F.lower(F.regexp_extract("line", head, 2)).alias("role")))).alias("h"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", said.alias("said")))), lambda x: x["said"]), "\n").alias("text"),
    )
    return groups.where(F.col("h.role") == speaker).select(key, "nth", F.col("h.title").alias("window_title"), safe_text("text").alias("text")).where("text <> ''")


def banded_points(scores: list[Column]) -> Column:
    """5, 3 or 1.5 points for a score of 0.95, 0.6 or 0.3, and one more for each such term, four at most."""
    points = sum((F.when(s >= 0.95, 5.0).when(s >= 0.6, 3.0).when(s >= 0.3, 1.5).otherwise(0.0) for s in scores), F.lit(0.0))
    return points + F.least(F.lit(4), sum(((s >= 0.3).cast("int") for s in scores), F.lit(0)))


def persona_points(terms: list[str], labels: Column, text: Column, tags: Column, has_quotes: Column, has_fingerprint: Column) -> Column:
    """8 for a term that is a label of the row, else 4 if the text has it; 3 each for tags of relations and feelings, 2 for quotes, 1 for a fingerprint."""
    known = F.transform(labels, compact)
    one = lambda t: F.when(F.array_contains(known, "".join(t.lower().split())), 8).when(F.lower(text).contains(t.lower()), 4).otherwise(0)
    tagged = lambda p: F.when(F.exists(tags, lambda x: x.startswith(p)), 3).otherwise(0)
    return sum(map(one, terms), F.lit(0)) + tagged("关系/") + tagged("情绪/") + F.when(has_quotes, 2).otherwise(0) + F.when(has_fingerprint, 1).otherwise(0)


def held_points(terms: list[str], text: Column, weight: int) -> Column:
    """``weight`` for each term that a row's text has: 3 for reviewed rows, 2 for cards and drafts."""
    return sum((F.when(F.lower(text).contains(t.lower()), weight).otherwise(0) for t in terms), F.lit(0))


def uncovered(xs: Column, most: int = 6) -> Column:
    """Ordered texts none of which holds another that stands there: what covers, or is covered by, an earlier one is left out."""
    step = lambda acc, x: F.when((F.size(acc) >= most) | (x == "") | F.exists(acc, lambda y: y.contains(x) | x.contains(y)), acc).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.transform(xs, safe_text), F.array().cast("array<string>"), step)


def exact_or_type(cards: DataFrame, requests: DataFrame, family: str, kind: str, order: list, most: int) -> DataFrame:
    """For each request (family, kind): its first ``most`` cards of the same family and kind, or, if there are none, of the kind. A blank family or kind fits any.

    Cards are cut to ``most`` for each key before they meet a request, so a large kind costs no more than a small one. ``family`` and ``kind`` stay as they are
    asked for; a card's own are in ``card_family`` and ``card_kind``.
    """
    own = cards.withColumnRenamed(family, "card_family").withColumnRenamed(kind, "card_kind")
    rank = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    top = lambda keys: own.withColumn("rank", rank(keys)).where(F.col("rank") <= most)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    meet = lambda asked, keys: asked.join(top([f"card_{n}" for n in keys]), [F.col(c) == F.col(f"card_{n}") for n, c in keys.items()])
    both, of_kind, of_family = {"family": family, "kind": kind}, {"kind": kind}, {"family": family}
    exact = meet(requests.where(~blank(family) & ~blank(kind)), both).unionByName(meet(requests.where(blank(family) & ~blank(kind)), of_kind)).unionByName(meet(requests.where(~blank(family) & blank(kind)), of_family))
    first = own.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # ``most`` rows
    exact = exact.unionByName(requests.where(blank(family) & blank(kind)).withColumn("any_", F.lit(1)).join(F.broadcast(first.withColumn("any_", F.lit(1))), "any_").drop("any_").select(*exact.columns)).withColumn("tier", F.lit("exact"))
    met = exact.select(F.col(family).alias("f_"), F.col(kind).alias("k_")).distinct()
    rest = requests.join(met, requests[family].eqNullSafe(met["f_"]) & requests[kind].eqNullSafe(met["k_"]), "left_anti")
    return exact.unionByName(meet(rest, of_kind).withColumn("tier", F.lit("type")).select(*exact.columns))


def first_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row of each composite key, the first in order; partial minima travel, not the rows of a hot key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def span_sources(spans: DataFrame, occurrences: DataFrame, key: str, candidate: str) -> DataFrame:
    """Each span key with whether its occurrence is there, and the sorted ids of the candidates that cite it."""
    ids = spans.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(candidate).cast("string"))), ",").alias("candidates"))
    return ids.join(occurrences.select(key, F.lit(True).alias("there")).distinct(), key, "left").withColumn("there", F.coalesce("there", F.lit(False)))


def message(raw: Column) -> dict[str, Column]:
    """The seven fields of a message in JSON, each by the first of its names that is there and not empty, then trimmed.

    Content is the parts joined by line breaks if there is a list of parts, else its text, the content itself if that is a text, ``text``, ``message``.
    Times are seconds from numbers of any scale or from ISO texts; numbers of messages below 1 are 0.
    """
    v = F.try_parse_json(raw)
    at = lambda *paths: safe_text(F.coalesce(*(F.nullif(F.try_variant_get(v, p, "string"), F.lit("")) for p in paths), F.lit("")))
    both = lambda a, b: at(f"$.{a}", f"$.{b}", f"$.metadata.{a}", f"$.metadata.{b}")
    parts = F.transform(F.try_variant_get(v, "$.content.parts", "array<string>"), lambda x: F.coalesce(x, F.lit("")))
    inner = F.try_variant_get(v, "$.content", "map<string,variant>").isNull()
    own = F.when(inner, F.nullif(F.try_variant_get(v, "$.content", "string"), F.lit("")))
    content = F.coalesce(F.array_join(parts, "\n"), F.nullif(F.try_variant_get(v, "$.content.text", "string"), F.lit("")), own, at("$.text", "$.message"))
    role = at("$.role", "$.author.role")
    time = at("$.create_time", "$.ts", "$.timestamp", "$.time", "$.metadata.timestamp", "$.metadata.timestamp_")
    seconds = epoch_seconds(time)
    nth = F.floor(F.coalesce(both("source_msg_index", "sourceMsgIndex").try_cast("double"), F.lit(0.0))).cast("long")
    return {
        "role": F.when(role == "", "assistant").otherwise(role), "content": safe_text(content),
        "ts": F.when(seconds > 0, seconds).otherwise(F.greatest(F.lit(0), F.coalesce(F.floor(F.unix_micros(F.try_to_timestamp(time)) / 1_000_000), F.lit(0)))).cast("long"),
        "window_id": both("source_window_id", "sourceWindowId"), "window_title": both("source_window_title", "sourceWindowTitle"), "msg_index": F.greatest(nth, F.lit(0)),
    }


def bundle_texts(messages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): the messages (role, text, window_title) of each bundle as lines, blank ones left out."""
    said = messages.withColumn("said", safe_text("text")).where("said <> ''")
    line = F.concat(F.when(F.col("window_title") != "", F.concat(F.lit("["), F.col("window_title"), F.lit("] "))).otherwise(""), first_text("role", F.lit("unknown")), F.lit(": "), F.col("said"))
    lines = said.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("lines"))
    return lines.select(key, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def as_documents(raw: DataFrame, documents: DataFrame, bundles: DataFrame) -> DataFrame:
    """Three inputs (kind, id, text; bundles without kind) as one table with character counts, without blank texts."""
    all_ = raw.unionByName(documents).unionByName(bundles.withColumn("kind", F.lit("chat_bundle")))
    return all_.withColumn("text", safe_text("text")).where("text <> ''").withColumn("char_count", F.length("text").cast("long"))


def file_kind(name: Column, text: Column) -> Column:
    """``json`` for readable JSON of that extension, ``document`` for Markdown, else ``raw_text``."""
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when((extension == "json") & F.try_parse_json(text).isNotNull(), "json").when(extension == "md", "document").otherwise("raw_text")


def readiness(accepted: Column, ledgers: Column, sound: Column) -> tuple[Column, Column]:
    """Status of a bundle, and whether projections can be made of it."""
    empty = accepted + ledgers == 0
    status = F.when(~sound, "invalid_bundle").when(empty, "valid_empty_bundle").otherwise("valid_bundle")
    return status, F.when(~sound, "blocked_by_contract_errors").when(empty, "nothing_to_project").when(ledgers > 0, "ready_with_review_ledgers").otherwise("ready")
