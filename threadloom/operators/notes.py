"""Markdown notes: a tree of sections from running windows over lines, sections taken out and put in, front matter, links to other notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import WHITE, distinct_exact, first_text, safe_text

#: Sections before which new ones are put, the section of links, and of whom a shape is assumed.
LATE, TRACES, SHAPE = ["关联线索", "原文回溯"], "原文回溯", ("scene_event", "事件切片")
BULLETS, QUOTES = 12, 6
W = f"[{WHITE}]"


def sections(notes: DataFrame, id_: str, text: str = "text") -> DataFrame:
    """(id, nth, level, title, parent, first_line, lines): the sections of notes in order, headings of two marks and more.

    A line belongs to the last heading above it, which is a running count; a section's parent is the last one above it with fewer marks (0: none).
    """
    line = F.replace(F.col("raw_"), F.lit("\r"), F.lit(""))
    rows = notes.select(id_, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("at_", "raw_")).withColumn("line_", line)
    head = rf"^{W}*(##+){W}*(.+?){W}*$"
    by = Window.partitionBy(id_).orderBy("at_")
    rows = rows.withColumn("head_", F.col("line_").rlike(head)).withColumn("nth", F.sum(F.col("head_").cast("long")).over(by)).where("nth > 0")
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("head_"), F.struct("at_", "line_")))), lambda x: x["line_"])
    found = rows.groupBy(id_, "nth").agg(F.min("at_").alias("first_line"), F.max(F.when(F.col("head_"), F.col("line_"))).alias("h_"), body.alias("lines"))
    found = found.withColumn("level", F.length(F.regexp_extract("h_", head, 1))).withColumn("title", safe_text(F.regexp_extract("h_", head, 2))).drop("h_")
    before = Window.partitionBy(id_).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    above = F.filter(F.collect_list(F.struct("nth", "level")).over(before), lambda x: x["level"] < F.col("level"))
    return found.withColumn("parent", F.coalesce(F.array_max(F.transform(above, lambda x: x["nth"])), F.lit(0).cast("long"))).select(id_, "nth", "level", "title", "parent", "first_line", "lines")


def bullet(c: Column) -> Column:
    """A line without its list mark or number."""
    return safe_text(F.regexp_replace(F.regexp_replace(c, rf"^{W}*[-*]{W}*", ""), rf"^{W}*\d+[.)]{W}*", ""))


def quoted_fragments(c: Column, most: int = QUOTES) -> Column:
    """What stands between quotation marks of any kind, on one line: the first ``most``, without repeats."""
    found = F.regexp_extract_all(c, F.lit(r"[\"“”『』「」]([^\n\r\x{2028}\x{2029}]+?)[\"“”『』「」]"), F.lit(1))
    return distinct_exact(F.slice(F.filter(F.transform(found, safe_text), lambda x: x != ""), 1, most), None)


def cues(notes: DataFrame, id_: str) -> DataFrame:
    """(id, nth, kind, scene, cues, quotes): what sections say about a voice: scales of temperature (8 lines), phrases not to say (12), scenes (6 lines, 4 quotes)."""
    s = sections(notes, id_)
    lines = F.filter(F.transform("lines", safe_text), lambda x: x != "")
    s = s.withColumn("lines", lines).where((F.col("title") != "") & (F.size("lines") > 0))
    key, body = F.regexp_replace(F.lower("title"), f"{W}+", ""), F.array_join("lines", "\n")
    kind = F.when(key.contains("温度标尺"), "temperature_scale").when(key.contains("禁用句"), "hard_no_say").otherwise("scenario_cue")
    said = F.filter(F.transform("lines", bullet), lambda x: x != "")
    most = lambda a, b, c: F.when(F.col("kind") == "temperature_scale", a).when(F.col("kind") == "hard_no_say", b).otherwise(c)
    s = s.withColumn("kind", kind).withColumn("said", said).withColumn("body", body)
    quotes = F.when(F.col("kind") == "temperature_scale", quoted_fragments(F.col("body"), 8)).when(F.col("kind") == "hard_no_say", F.array().cast("array<string>")).otherwise(quoted_fragments(F.col("body"), 4))
    return s.select(id_, "nth", "kind", F.col("title").alias("scene"), F.slice("said", F.lit(1), most(8, 12, 6)).alias("cues"), quotes.alias("quotes"))


def _cut(text: Column, heading: Column) -> tuple[Column, Column, Column]:
    """Where ``## heading`` begins (0: nowhere), where its body begins (0: nowhere) and where the next heading of two marks begins."""
    start = F.position(F.concat(F.lit("## "), heading), text)
    nl = F.position(F.lit("\n"), text, start)
    body = F.when((start > 0) & (nl > 0), nl + 1).otherwise(0)
    after = F.regexp_instr(F.substr(text, body), F.lit(rf"(?m)^##{W}+"))
    end = F.when(body == 0, F.length(text) + 1).when(after > 0, body + after - 1).otherwise(F.length(text) + 1)
    return start, body, end


def section_text(c: Column, heading: str) -> Column:
    """The trimmed body of the first section of that heading, up to the next heading of two marks; empty without one."""
    text = F.coalesce(c, F.lit(""))
    start, body, end = _cut(text, F.lit(heading))
    return F.when((start > 0) & (body > 0), safe_text(F.substr(text, body, end - body))).otherwise("")


def section_bullets(c: Column, heading: str) -> Column:
    items = F.transform(F.split(section_text(c, heading), "\n"), lambda x: safe_text(F.regexp_extract(x, rf"^{W}*-{W}+(.+?){W}*$", 1)))
    return F.filter(items, lambda x: x != "")


def upsert_section(c: Column, heading: str, values: Column) -> Column:
    """The note with the section of that heading replaced by bullets (twelve at most, without repeats), put before the late sections if it is new, or left out if there are none."""
    right = lambda t: F.regexp_replace(t, f"{W}+$", "")
    left = lambda t: F.regexp_replace(t, f"^{W}+", "")
    text, items = right(F.coalesce(c, F.lit(""))), F.slice(distinct_exact(values, None), 1, BULLETS)
    block = F.when(F.size(items) > 0, F.concat(F.lit(f"## {heading}\n\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))).otherwise("")
    start, _, end = _cut(text, F.lit(heading))
    swapped = F.concat(right(F.left(text, start - 1)), F.lit("\n\n"), block, left(F.substr(text, end)))
    replaced = F.concat(safe_text(F.regexp_replace(swapped, r"\n{3,}", "\n\n")), F.lit("\n"))
    late = F.regexp_instr(text, F.lit(rf"(?m)^##{W}+({'|'.join(LATE)}){W}*$"))
    put = F.concat(right(F.left(text, late - 1)), F.lit("\n\n"), block, F.lit("\n"), left(F.substr(text, late)), F.lit("\n"))
    return F.when(start > 0, replaced).when(block == "", F.concat(text, F.lit("\n"))).when(late > 0, put).otherwise(F.concat(text, F.lit("\n\n"), block, F.lit("\n")))


def _unquoted(c: Column) -> Column:
    return safe_text(F.regexp_replace(c, "^[\"']|[\"']$", ""))


def front_scalar(c: Column, key: str, fallback: str = "") -> Column:
    """A value of the front matter, without quotes."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?m)^---[\s\S]*?^{W}*{key}:{W}*([^\n]+?){W}*$", 1)
    return first_text(_unquoted(found), F.lit(fallback))


def front_array(c: Column, key: str) -> Column:
    """The items of a list in the front matter."""
    block = F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?m)^---[\s\S]*?^{W}*{key}:[ \t]*\n([\s\S]*?)(?=^{W}*[A-Za-z0-9_]+:{W}|^---{W}*$)", 1)
    items = F.transform(F.split(block, "\n"), lambda x: _unquoted(F.regexp_extract(x, rf"^{W}*-{W}+(.+?){W}*$", 1)))
    return F.filter(items, lambda x: x != "")


def title_of(c: Column, fallback: Column) -> Column:
    """The front matter's title, else the first heading of one mark, else the file's name."""
    return first_text(front_scalar(c, "title"), F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?m)^#{W}+([^\n]+?){W}*$", 1), fallback)


def wiki_links(c: Column) -> Column:
    """(target, alias) of ``[[target|alias]]``; targets are paths with ``/`` that end in ``.md``."""
    pattern = F.lit(r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]")
    target = lambda t: F.replace(F.when(F.lower(t).endswith(".md"), t).otherwise(F.concat(t, F.lit(".md"))), F.lit("\\"), F.lit("/"))
    both = F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("t"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("a"))
    return F.filter(F.transform(both, lambda x: F.struct(target(safe_text(x["t"])).alias("target"), safe_text(x["a"]).alias("alias"))), lambda x: x["target"] != ".md")


def link_traces(notes: DataFrame, memo_dir: str = "memos", trace_dir: str = "traces", heading: str = TRACES) -> DataFrame:
    """(memo, title, nth, target, state, trace, source_ref): memos with each link of their section of traces, or with none.

    ``linked``: the target is a trace's path; ``by_title``: no such path, but its name is the one title of a trace (white space and case aside); ``ambiguous``: of several; ``dangling``: of none;
    ``no_links``: the memo has none. Every memo stays.
    """
    at = lambda d: F.col("path").startswith(f"{d}/")
    own = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    memos = notes.where(at(memo_dir)).select(F.col("path").alias("memo"), title_of(F.col("text"), own).alias("title"), F.posexplode_outer(F.flatten(F.transform(section_bullets(F.col("text"), heading), wiki_links))).alias("nth", "link"))
    memos = memos.select("memo", "title", F.col("nth").cast("long").alias("nth"), F.col("link.target").alias("target"))
    key = lambda c: F.regexp_replace(F.lower(c), f"{W}+", "")
    traces = notes.where(at(trace_dir)).select(F.col("path").alias("trace"), key(title_of(F.col("text"), own)).alias("name"), front_scalar(F.col("text"), "source_ref").alias("source_ref"))
    named = traces.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct("trace", "source_ref")).alias("t"))
    by_path = traces.select(F.col("trace").alias("target"), "trace", "source_ref").dropDuplicates(["target"])
    out = memos.join(by_path, "target", "left").withColumn("name", key(F.regexp_extract("target", r"([^/]+)\.md$", 1))).join(named, "name", "left")
    state = F.when(F.col("target").isNull(), "no_links").when(F.col("trace").isNotNull(), "linked").when(F.col("n") == 1, "by_title").when(F.col("n") > 1, "ambiguous").otherwise("dangling")
    pick = lambda c: F.when(state == "linked", F.col(c)).when(state == "by_title", F.col(f"t.{c}"))
    return out.select("memo", "title", "nth", "target", state.alias("state"), pick("trace").alias("trace"), pick("source_ref").alias("source_ref"))


def memo_evidence(links: DataFrame) -> DataFrame:
    """(memo, n_linked, n_open, source_refs): what the links of each memo prove, refs in order and without repeats."""
    told = links.groupBy("memo").agg(
        F.count_if(F.col("state").isin("linked", "by_title")).alias("n_linked"), F.count_if(F.col("state").isin("dangling", "ambiguous")).alias("n_open"),
        F.transform(F.array_sort(F.collect_list(F.when(F.coalesce("source_ref", F.lit("")) != "", F.struct("nth", "source_ref")))), lambda x: x["source_ref"]).alias("refs"),
    )
    return told.select("memo", "n_linked", "n_open", F.array_distinct("refs").alias("source_refs"))
