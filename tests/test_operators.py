"""Small literal fixtures: the traps of the evidence operators, and invariants."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.functions import ids, text
from threadloom.operators import bundle, chunking, compaction, growth, ranking, relations, rows, shape, state, timeline
from threadloom.sources import files
from threadloom.streaming.submissions import applied_once, apply_batch, windowed_counts


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("given", "want"), [("2025/2/3", "2025-02-03"), ("2025-2-3", "2025-02-03"), ("2025.7", "2025-07-01"), ("2025年7月9", "2025-07-09"), ("20250217", "20250217"), ("soon", "soon"), (None, "")])
def test_date_literal(spark, given, want):
    assert one(spark, text.date_literal("x"), x=given) == want


def test_distinct_identities(spark):
    xs = ["Ab c", "abc", " ABC ", "", None]
    assert one(spark, text.distinct_compact(F.col("x")), x=xs) == ["Ab c"]
    assert one(spark, text.distinct_exact(F.col("x")), x=xs) == ["Ab c", "abc", "ABC"]


def test_texts(spark):
    assert one(spark, text.safe_text("x"), x="　 a \t\n") == "a"
    assert one(spark, text.preview("x", 4), x="ab  cdef") == "ab c..."
    assert one(spark, text.path_segment("x"), x=" a / b\\c ") == "a_b_c"
    assert one(spark, text.path_segment("x"), x="//") == "unnamed"
    assert one(spark, text.utf16_length("x"), x="a😀中") == 4
    assert one(spark, text.month_key("x"), x="reviewed_2025-03.csv") == "2025-03"
    assert [one(spark, text.value_type("x"), x=v) for v in ("TRUE", "-1.5", "2025-1-2", "[1]", "a", None)] == ["boolean", "number", "date", "json", "text", "text"]
    assert [one(spark, text.epoch_seconds("x"), x=v) for v in ("1700000000", "1700000000123", "1700000000123456", "x", None)] == [1700000000] * 3 + [0, 0]
    assert one(spark, text.source_ref("x"), x="window_20250101_msg_7")["msg_index"] == 7
    assert [tuple(r) for r in one(spark, text.key_values("x"), x="a = 1 | b=2; c")] == [("a", "1"), ("b", "2; c")]
    assert one(spark, ids.fnv1a32(F.col("x")), x="a") == 0xE40C292C
    assert one(spark, ids.fnv1a32(F.col("x")), x="") == 2166136261


def test_chat_lines(spark):
    got = [tuple(one(spark, text.chat_line("x"), x=v)) for v in ("[w] user: hi", "[w] system: x", " second line ")]
    assert got == [("w", "user", "hi"), ("", "text", "[w] system: x"), ("", "text", "second line")]


def test_corpus_share(spark):
    share = lambda t, c: one(spark, text.corpus_share(F.col("t"), F.col("c")), t=t, c=c)
    assert (share("Blue house", "a BLUE-house here"), share("blue green", "blue"), share("", "x"), share("ab", "xy")) == (1.0, 0.5, 0.0, 0.0)  # one of two signals beats 4 of 9 letters


def test_packing_and_batches(spark):
    docs = spark.createDataFrame([(1, "abcd\nab\n\nabcd\na"), (2, "x" * 50), (3, None), (4, " \n")], "k long, text string")
    got = [(r["k"], r["slice_no"], r["n_lines"], r["char_count"], r["start_char"]) for r in chunking.slices(docs, "k", 8).orderBy("k", "slice_no").collect()]
    assert got == [(1, 1, 2, 7, 0), (1, 2, 2, 6, 7), (2, 1, 1, 50, 0)]
    cut = spark.createDataFrame([(1, 1, 5000), (1, 2, 5000), (1, 3, 1000)], "k long, slice_no long, char_count long")
    assert [(r["batch_no"], r["n_slices"], r["batch_chars"]) for r in chunking.batches(cut, "k", 2, 9000).orderBy("batch_no").collect()] == [(1, 1, 5000), (2, 2, 6000)]


def test_timeline(spark):
    rows = spark.createDataFrame([(5, 1), (0, 2), (3, 3), (0, 4), (5, 0), (200000, 9)], "s long, a long")
    got = [(r["s"], r["a"]) for r in timeline.merged_timeline(rows, "s", "a").orderBy("position").collect()]
    assert got == [(3, 3), (5, 0), (5, 1), (200000, 9), (0, 2), (0, 4)]
    steps = spark.createDataFrame([("g", 1, 1), ("g", 3, 2), ("o", 2, 1), ("o", 1, 2), ("d", 1, 1), ("d", 1, 2), ("e", 4, 1), ("e", 5, 2)], "w string, i long, t long")
    assert {r["w"]: r["status"] for r in timeline.contiguity(steps, "w", "i", "t").collect()} == {"g": "gap", "o": "disorder", "d": "duplicate", "e": "exact"}


def test_edges(spark):
    rows = [(1, "windows", 1), (2, "windows", 1), (1, "personas", 5), (2, "personas", 5), (3, "windows", 9), (4, "windows", 9), (3, "windows", 9)]
    edges = relations.overlap_edges(spark.createDataFrame(rows, "root long, kind string, member long"))
    assert [(r["from_root"], r["to_root"], r["score"], r["relation"]) for r in edges.collect()] == [(1, 2, 4, "shared_window")]
    assert {(r["root"], r["other"]) for r in relations.adjacency(edges).collect()} == {(1, 2), (2, 1)}


def test_ranges(spark):
    a = spark.createDataFrame([("w", 1, 1, 5), ("v", 2, 1, 5)], "w string, id long, start long, end long")
    b = spark.createDataFrame([("w", 8, 5, 9), ("w", 7, 5, 6), ("w", 9, 7, 8)], "w string, id long, start long, end long")
    assert [(r["a_id"], r["b_id"]) for r in relations.overlaps(a, b, "w", first=True).collect()] == [(1, 7)]
    assert sorted(r["b_id"] for r in relations.overlaps(a, b, "w", pad=2).collect()) == [7, 8, 9]


def test_fold(spark):
    rows = [("r", "2025-01", "a"), ("r", "2025-01", "b"), ("r", "2025-02", "b"), ("r", "2025-02", "c"), ("r", "2025-03", "x"), ("s", "2025-01", "a")]
    got = {r["root"]: r for r in growth.roots(spark.createDataFrame(rows, "root string, at string, fact string")).collect()}
    assert (got["r"]["version_count"], got["r"]["branch_count"], got["r"]["conflict_hint"], got["r"]["facts"]) == (3, 2, True, ["a", "b", "c"])
    assert (got["s"]["evolution"], got["s"]["version_count"]) == ("stable", 1)


def test_ranking_keeps_all(spark):
    rows = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1)], "g string, v long")
    t = ranking.top_k(rows, ["g"], [F.desc("v")], 3)
    assert (t.count(), t.where("selected").count()) == (8, 4)
    tiers = spark.createDataFrame([("q", 1, 2, 9.0), ("q", 1, 0, 1.0), ("q", 2, 1, 5.0), ("q", 3, 1, 6.0)], "q string, item long, tier int, score double")
    assert [(r["item"], r["tier"]) for r in ranking.cascade(tiers, "q", "item", 2).orderBy("rank").collect()] == [(1, 0), (3, 1)]


def test_bundle(spark):
    drafts = spark.createDataFrame([("a", "new", 2, 2), ("", "new", 1, 1), ("b", "new", 1, 0), ("c", "skip", 1, 1), ("d", "update", 2, 1), (None, "hold", 0, 0)], "identity string, decision string, n_spans long, n_reliable long")
    routed = bundle.route(drafts)
    assert {(r["identity"], r["state"]) for r in routed.collect()} == {("a", "accepted"), ("", "rejected"), ("b", "hold"), ("c", "rejected"), ("d", "hold"), (None, "rejected")}
    row = bundle.conservation(routed).first()
    assert (row["inputs"], row["accepted"], row["held"], row["rejected"], row["conserved"]) == (6, 1, 2, 3, True)
    spans = spark.createDataFrame([(1, "a😀", None, 0, 3), (2, "", None, 0, 1)], "id long, excerpt string, excerpt_digest string, start long, end long").withColumn("excerpt_digest", F.when(F.col("id") == 1, ids.digest(F.col("excerpt"))))
    assert {(r["id"], r["rule"]) for r in bundle.violations(spans, "id", bundle.span_rules()).collect()} == {(2, "excerpt_blank"), (2, "digest_mismatch"), (2, "bounds_mismatch")}


def test_shape(spark):
    assert one(spark, shape.shape(F.col("x")), x=["第一次"]) == "scene_event"
    assert one(spark, shape.shape(F.col("x")), x=["第一次", "晚安", "首次", "仪式"]) == "ritual_pattern"  # a tie goes to the first
    assert one(spark, shape.shape(F.col("x")), x=[]) == "scene_event"


def test_state(spark):
    known = spark.createDataFrame([("t1", "d1")], "task string, digest string")
    rows = spark.createDataFrame([(1, "t1", "d1"), (2, "t1", "d2"), (3, "t2", "d1"), (4, "t2", "d1"), (5, "t2", "d9")], "arrival long, task string, digest string")
    got = {r["arrival"]: r["outcome"] for r in state.submissions(rows, known, "task", "digest").collect()}
    assert got == {1: "replay", 2: "conflict", 3: "write", 4: "replay", 5: "conflict"}


def test_sinks(spark, tmp_path):
    df, path = spark.range(3), f"file://{tmp_path}/t"
    state.write_new(df, path)
    with pytest.raises(Exception, match="(?i)exists"):
        state.write_new(df, path)
    assert not state.write_unless_empty(df.limit(0), path)
    assert spark.read.parquet(path).count() == 3
    state.write_jsonl(df, f"{path}j")
    assert spark.read.json(f"{path}j").count() == 3


def test_compaction_is_order_exact(spark):
    rows = [("s", "scene_event", i, i, f"t{i}", [str(k) for k in range(i // 4 * 10, i // 4 * 10 + 6)], ["ab", "bc"]) for i in range(8)]
    notes = spark.createDataFrame(rows, "scope string, shape string, note long, at long, title string, slices array<string>, grams array<string>")
    got = {r["note"]: r["cluster"] for r in compaction.compacted(notes).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 4, 7: 7}


def test_files(spark, tmp_path):
    (tmp_path / "reviewed_2025-03.csv").write_text('title,text\n"a ""b""","line\nbreak, comma"\nshort\n')
    rows = files.reviewed(spark, f"file://{tmp_path}/reviewed_2025-03.csv", "title string, text string").collect()
    assert (rows[0]["title"], rows[0]["text"], rows[0]["month_key"]) == ('a "b"', "line\nbreak, comma", "2025-03")
    assert rows[1]["_corrupt_record"] is not None
    with pytest.raises(Exception, match="(?i)malformed"):
        files.csv_rows(spark, f"file://{tmp_path}/reviewed_2025-03.csv", "title string, text string", fail=True).collect()
    kinds = {one(spark, files.json_shape(F.col("x")), x=v) for v in ('{"mapping":{}}', "{broken", None)}
    assert kinds == {"object", "text"}
    (tmp_path / "v").mkdir()
    (tmp_path / "v/a.md").write_text("---\ntype: memo\n---\n# Title\n- one\n- two [[Link|x]]\n")
    note = files.markdown_notes(spark, f"file://{tmp_path}/v").first()
    assert (note["title"], note["type"], note["links"], len(note["bullets"])) == ("Title", "memo", ["Link"], 2)


def test_streaming(spark, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    put = lambda rows: spark.createDataFrame(rows, "arrival long, task string, digest string").coalesce(1).write.mode("append").parquet(src)
    put([(1, "a", "d1"), (2, "b", "d1")])
    stream = lambda: spark.readStream.schema("arrival long, task string, digest string").parquet(src)
    applied_once(stream(), out, f"file://{tmp_path}/cp").awaitTermination()
    put([(3, "a", "d1"), (4, "b", "d2"), (5, "c", "d1")])
    applied_once(stream(), out, f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r["arrival"] for r in spark.read.parquet(out).collect()) == [1, 2, 5]
    assert [r["arrival"] for r in spark.read.parquet(f"{out}_conflicts").collect()] == [4]
    again = spark.createDataFrame([(6, "d", "d1"), (7, "a", "d9")], "arrival long, task string, digest string")
    for _ in range(2):  # a batch that is run again
        apply_batch(again, out, "x-1")
    assert sorted(r["arrival"] for r in spark.read.parquet(out).collect()) == [1, 2, 5, 6]
    assert sorted(r["arrival"] for r in spark.read.parquet(f"{out}_conflicts").collect()) == [4, 7]
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == 1000


def test_row_predicates(spark):
    from pyspark.sql import functions as F

    from threadloom.operators import rows, signals

    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert [one(signals.decision(F.lit(x))) for x in ("create", " PATCH", "merge_into", "hold", "archive", "add", "", None)] == ["new", "update", "merge", "skip", "delete", "add", "touch", "touch"]
    assert [one(rows.source_label(F.lit(x))) for x in ("/srv/a/b.csv", "plain", "\\\\host\\share\\x.md", "//", None)] == ["b.csv", "plain", "x.md", "local_source", ""]
    assert [one(rows.is_generic(F.lit(x))) for x in ("", None, "2024/5", "5月3日", "关系好", "River")] == [True, True, True, True, True, False]
    assert [one(rows.iso_time(F.lit(x).cast("double"))) for x in (1700000000, 1700000000123, 0, None)] == ["2023-11-14T22:13:20.000Z", "2023-11-14T22:13:20.123Z", "", ""]
    assert one(rows.uncovered(F.array(*map(F.lit, ["ab", "abc", "x", "b", "yx", "zz"])))) == ["ab", "x", "zz"]
    got = {k: one(c) for k, c in rows.quotes(F.lit("user: a；user: A ; bot：b;c: d; e")).items()}
    assert got == {"user": ["a"], "char": ["b"], "other": ["d", "e"]}
    assert [one(signals.privacy_hit(F.lit(x))) for x in ("sk-" + "a" * 20, "see /home/x/y", "C:\\a", "sk-short", None)] == ["secret_like_api_key", "absolute_private_path", "absolute_private_path", None, None]


def test_file_numbers_end_at_999(spark):
    from threadloom.operators import signals

    names = spark.range(1200).selectExpr("id", "'a' AS name")
    got = [r["file_name"] for r in signals.numbered_names(names, "name", "id").orderBy("id").collect()]
    assert got[:2] == ["a", "a_002"] and got[998] == "a_999" and set(got[999:]) == {None} and len(set(got)) == 1000


def test_fallback_of_empty_tables(spark):
    from pyspark.sql import functions as F

    from threadloom.operators import rows

    cards = spark.createDataFrame([(1, "a", "m"), (2, "b", "m"), (3, None, "m")], "card long, family string, kind string")
    asked = spark.createDataFrame([("a", "m"), ("z", "m"), ("z", "n")], "family string, kind string")
    got = sorted(tuple(r) for r in rows.exact_or_type(cards, asked, "family", "kind", [F.col("card")], 2).select("family", "kind", "card", "tier").collect())
    assert got == [("a", "m", 1, "exact"), ("z", "m", 1, "type"), ("z", "m", 2, "type")]
    assert rows.exact_or_type(cards.limit(0), asked, "family", "kind", [F.col("card")], 2).count() == 0


def test_rules_of_texts_by_hand(spark):
    """Values worked out from the rules, beside the SQL of their queries."""
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    share = lambda a, b: one(text.corpus_share(F.lit(a), F.lit(b)))
    assert share("hello world zebra zebra", "well hello there") == 0.72
    assert (share("ab", "xx ab"), share("", "a"), share("a", " . "), share("ab cd", "ab xy")) == (1.0, 0.0, 0.0, 0.5)
    assert share("关系状态", "这个状态") == round(1 / 6, 4)  # one of its six 2- to 4-grams
    assert one(text.term_score("foo,bar", text.compact_words(F.lit("x foo bar y")))) == 1.0
    assert one(text.term_score("foo, nothing", text.compact_words(F.lit("x foo")))) == round(3 / 10, 4)
    assert one(F.length(text.safe_text(F.lit("　x ﻿ ")))) == 1
    assert (one(text.clip(F.lit("ab  cd ef"), 4)), one(text.preview(F.lit("ab  cd ef"), 4)), one(text.clip_block(F.lit("ab\ncdef"), 6))) == ("ab…", "ab c...", "ab\ncd…")
    assert one(text.clip_note(F.lit("**a** `b` [object Object]> c d"), 5)) == "a b …"
    assert one(text.excerpt(F.lit("# t\nbody [EXTRACT_META]x\ny[/EXTRACT_META] end"), 40)) == "body end"
    message = lambda raw: one(F.to_json(F.struct(*(c.alias(k) for k, c in rows.message(F.lit(raw)).items()))))
    get = lambda raw, key: json.loads(message(raw))[key]
    assert get('{"content":"A","text":"B"}', "content") == "A" and get('{"content":{"parts":["a",null,"b"],"text":"t"}}', "content") == "a\n\nb"
    assert get('{"content":{"parts":[" "]},"text":"B"}', "content") == "" and get('{"content":{"text":"T"},"text":"B"}', "content") == "T"
    assert get('{"text":"","message":"m"}', "content") == "m" and get('{"create_time":1735689600000,"ts":5}', "ts") == 1735689600
    assert get('{"time":"2025-01-01T00:00:00Z"}', "ts") == 1735689600 and get('{"time":"never"}', "ts") == 0
    assert get('{"metadata":{"sourceMsgIndex":"7.9"},"source_window_id":" w "}', "msg_index") == 7
    said = {k: one(c) for k, c in rows.quotes(F.lit("User: one\ntwo; User: three; 伙伴：four; USER：Three")).items()}
    assert said == {"user": ["three"], "char": [], "other": ["User: one\ntwo", "four"]}
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    assert one(rows.iso_time(F.lit(1735689600.0))) == "2025-01-01T00:00:00.000Z"
    spark.conf.set("spark.sql.session.timeZone", zone)
