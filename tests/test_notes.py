"""Notes: sections and upserts against plain string work on random notes; front matter, links and voices by hand."""

import random
import re

from pyspark.sql import functions as F

from threadloom.operators import notes

LINES = ["## A", "## B", "### C", " ## D  ", "##E", "# T", "text", "- one", " - two  ", "* x", "", "", "## 原文回溯", "1. n\r", "##　wide", "---"]


def plain_sections(text):
    out = []
    for i, raw in enumerate(text.split("\n")):
        line = raw.replace("\r", "")
        m = re.match(r"^\s*(##+)\s*(.+?)\s*$", line)
        if m:
            level = len(m[1])
            parent = max((k for k, o in enumerate(out, 1) if o[0] < level), default=0)
            out.append((level, m[2].strip(), parent, i, []))
        elif out:
            out[-1][4].append(line)
    return out


def plain_section(text, heading):
    start = text.find(f"## {heading}")
    at = text.find("\n", start)
    if start < 0 or at < 0:
        return ""
    rest = text[at + 1 :]
    after = re.search(r"^##\s+", rest, re.M)
    return (rest[: after.start()] if after else rest).strip()


def plain_upsert(raw, heading, values):
    text, items = raw.rstrip(), list(dict.fromkeys(v.strip() for v in values if v.strip()))[:12]
    block = f"## {heading}\n\n" + "\n".join(f"- {v}" for v in items) + "\n" if items else ""
    start = text.find(f"## {heading}")
    if start >= 0:
        at = text.find("\n", start)
        after = re.search(r"^##\s+", text[at + 1 :], re.M) if at >= 0 else None
        end = at + 1 + after.start() if after else len(text)
        return re.sub(r"\n{3,}", "\n\n", f"{text[:start].rstrip()}\n\n{block}{text[end:].lstrip()}").strip() + "\n"
    if not block:
        return text + "\n"
    late = re.search(r"^##\s+(关联线索|原文回溯)\s*$", text, re.M)
    return f"{text[: late.start()].rstrip()}\n\n{block}\n{text[late.start() :].lstrip()}\n" if late else f"{text}\n\n{block}\n"


def test_sections_and_upserts_of_random_notes(spark):
    rng = random.Random(9)
    texts = ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(14))) for _ in range(400)] + [None, "", "## B", "## B\n"]
    values = [[rng.choice([" v", "w", "", "v ", "u"]) for _ in range(rng.randrange(4))] for _ in texts]
    df = spark.createDataFrame(list(zip(range(len(texts)), texts, values, strict=True)), "id long, text string, v array<string>")
    got = {}
    for r in notes.sections(df, "id").orderBy("id", "nth").collect():
        got.setdefault(r["id"], []).append((r["level"], r["title"], r["parent"], r["first_line"], r["lines"]))
    assert got == {i: s for i, t in enumerate(texts) if (s := plain_sections(t or ""))}
    made = df.select("id", "v", notes.upsert_section(F.col("text"), "B", F.col("v")).alias("now"), notes.section_text(F.col("text"), "B").alias("before"), "text").checkpoint()
    for r in made.collect():
        raw = r["text"] or ""
        assert r["before"] == plain_section(raw, "B"), repr(raw)
        assert r["now"] == plain_upsert(raw, "B", r["v"]), repr(raw)
    single = F.size(F.split(F.coalesce("text", F.lit("")), "## B")) <= 2  # else the next section of that name is found
    again = made.where(single).select("id", "v", notes.section_bullets(F.col("now"), "B").alias("b"), notes.upsert_section(F.col("now"), "B", F.col("v")).alias("twice"), "now")
    for r in again.collect():
        items = list(dict.fromkeys(v.strip() for v in r["v"] if v.strip()))
        assert r["b"] == items
    trees = [{(r["id"], r["nth"], r["level"], r["title"], r["parent"]) for r in notes.sections(again.select("id", F.col(c).alias("text")), "id").collect()} for c in ("now", "twice")]
    assert trees[0] == trees[1]


def test_front_matter_links_and_voices(spark):
    text = '---\ntitle: "A \'b\'"\ntags:\n  - x\n  - "y z"\n  -\nsource_ref: \'r1\'\n---\n# Head\n[[a\\b|n]] [[c.MD]] [[ ]] [[d|]]\n'
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(notes.front_scalar(F.lit(text), "source_ref")) == "r1" and one(notes.front_scalar(F.lit(text), "none", "f")) == "f"
    assert one(notes.front_array(F.lit(text), "tags")) == ["x", "y z"] and one(notes.front_array(F.lit("no"), "tags")) == []
    assert one(notes.title_of(F.lit(text), F.lit("file"))) == "A 'b'" and one(notes.title_of(F.lit("x\n# Head \n"), F.lit("file"))) == "Head" and one(notes.title_of(F.lit("x"), F.lit("file"))) == "file"
    assert [tuple(x) for x in one(notes.wiki_links(F.lit(text)))] == [("a/b.md", "n"), ("c.MD", "")]
    voice = "lead\n## 温度标尺\n- warm “oh”\n- cold\n## 禁用句\n1. never\n\n## Morning\n* hi 「there」\n2) so\n## Empty\n\n"
    rows = notes.cues(spark.createDataFrame([(1, voice)], "id long, text string"), "id").orderBy("nth").collect()
    assert [(r["kind"], r["scene"], r["cues"], r["quotes"]) for r in rows] == [
        ("temperature_scale", "温度标尺", ["warm “oh”", "cold"], ["oh"]), ("hard_no_say", "禁用句", ["never"], []), ("scenario_cue", "Morning", ["hi 「there」", "so"], ["there"])
    ]


def test_memo_evidence(spark):
    rows = [("m", 0, "linked", "r2"), ("m", 1, "dangling", None), ("m", 2, "by_title", "r1"), ("m", 3, "linked", "r2"), ("n", None, "no_links", None)]
    df = spark.createDataFrame(rows, "memo string, nth long, state string, source_ref string")
    assert [tuple(r) for r in notes.memo_evidence(df).orderBy("memo").collect()] == [("m", 3, 1, ["r2", "r1"]), ("n", 0, 0, [])]
