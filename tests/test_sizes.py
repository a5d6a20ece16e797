"""Steps whose cost must not grow faster than their input: results against plain versions, and plans without the step that grew."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from threadloom.functions import nested, text
from threadloom.operators import contract, pair_blocks, recall, relations, review, scenes, score_blocks, signals, snippets
from threadloom.plans.registry import QUERIES


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_are_counted_in_blocks_without_joining_pairs(spark, monkeypatch):
    monkeypatch.setattr(pair_blocks, "CELLS", 50)
    monkeypatch.setattr(pair_blocks, "ROOTS", 10)
    rng = random.Random(1)
    rows = [(rng.randrange(60), rng.choice(list(relations.POINTS)), rng.choice([1, 2, 3, -5, 2**40, rng.randrange(400)])) for _ in range(1500)]
    rows += [(None, "topics", 1), (3, "topics", None), (1, "other", 1)]
    members = spark.createDataFrame(rows, "root long, kind string, member long")
    by = {}
    for r, k, m in set(rows):
        if r is not None and m is not None and k in relations.POINTS:
            by.setdefault((k, m), []).append(r)
    n = Counter((a, b, k) for (k, _), rs in by.items() for a, b in combinations(sorted(rs), 2))
    want = {}
    for a, b in {x[:2] for x in n}:
        w, t, p = (min(n[a, b, k], 8) for k in relations.POINTS)
        if max(w, t, p) >= 2 or (w and t + p) or 3 * w + 2 * t + p >= 4:
            want[a, b] = (w, t, p, 3 * w + 2 * t + p)
    edges = relations.overlap_edges(members)
    assert "Join" not in plan(edges)
    assert {(r.from_root, r.to_root): (r.windows, r.topics, r.personas, r.score) for r in edges.collect()} == want and len(want) > 1000
    of = {}
    for (a, b), (*_, s) in want.items():
        of.setdefault(a, []).append((-s, b))
        of.setdefault(b, []).append((-s, a))
    best = {(r, o, -s, i) for r, xs in of.items() for i, (s, o) in enumerate(sorted(xs)[:3], 1)}
    few = relations.overlap_edges(members, best=3)
    assert {(r.root, r.other, r.score, r["rank"]) for r in relations.adjacency(few, 3).collect()} == best and few.count() < len(want)


def _near_and_far(spark, lonely):
    """Roots that share windows and topics with those of their ten only, and personas with all; the last ten may share less."""
    rng = random.Random(5)
    rows = [(r, k, r // 10 * 1000 + rng.randrange(12)) for r in range(60) for k in ("windows", "topics") for _ in range(8) if r < 50 or not lonely]
    rows += [(r, "personas", rng.randrange(40)) for r in range(60) for _ in range(15)]
    by, n, of = {}, Counter(), {}
    for r, k, m in set(rows):
        by.setdefault((k, m), []).append(r)
    for (k, _), rs in by.items():
        n.update((a, b, k) for a, b in combinations(sorted(rs), 2))
    want = {}
    for a, b in {x[:2] for x in n}:
        w, t, p = (min(n[a, b, k], 8) for k in relations.POINTS)
        if max(w, t, p) >= 2 or (w and t + p) or 3 * w + 2 * t + p >= 4:
            want[a, b] = 3 * w + 2 * t + p
            of.setdefault(a, []).append((-want[a, b], b))
            of.setdefault(b, []).append((-want[a, b], a))
    best = {(r, o, -s, i) for r, xs in of.items() for i, (s, o) in enumerate(sorted(xs)[:3], 1)}
    return spark.createDataFrame(rows, "root long, kind string, member long"), want, best


def test_blocks_that_hold_no_better_edge_are_not_met(spark, monkeypatch):
    monkeypatch.setattr(pair_blocks, "ROOTS", 10)
    calls, whole = [], pair_blocks._met
    monkeypatch.setattr(pair_blocks, "_met", lambda *a: calls.append(len(a[2])) or whole(*a))
    for lonely, met in ((False, [6]), (True, [6, 5])):
        calls.clear()
        members, _, best = _near_and_far(spark, lonely)
        assert {(r.root, r.other, r.score, r["rank"]) for r in relations.adjacency(relations.overlap_edges(members, best=3), 3).collect()} == best
        assert calls == met


def test_blocks_are_sent_without_kinds_that_lie_apart(spark, monkeypatch):
    monkeypatch.setattr(pair_blocks, "ROOTS", 10)
    members, want, _ = _near_and_far(spark, True)
    sent, whole = [], pair_blocks._sent
    monkeypatch.setattr(pair_blocks, "_sent", lambda group, to: sent.extend(to) or whole(group, to))
    assert {(r.from_root, r.to_root): r.score for r in relations.overlap_edges(members).collect()} == want
    assert len(sent) == 21 and all(of == [False, False, True] for i, j, of in sent if i < j)
    monkeypatch.setattr(pair_blocks, "FEW", 2)
    sent.clear()
    assert relations.overlap_edges(members).count() == len(want) and len(sent) == 3  # three blocks travel together: a block is sent twice, not six times


def test_names_and_their_cuts_are_not_broadcast(spark):
    names = spark.createDataFrame([(1, "Brand#1"), (2, "Brand#1 xyz"), (3, "ab brand#1"), (4, "Brand#1abcde"), (5, None), (6, "brand#1")], "id long, name string")
    found = signals.affix_matches(names, spark.createDataFrame([(9, "Brand#1")], "token_id long, token string"))
    assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(1, 9), (2, 9), (3, 9), (6, 9)]


def test_members_come_down_to_one_row_before_they_meet_who_asks(spark):
    rows = [(p, "f" if p < 300 else "", "Clan" if p % 2 else "Kin", "persona", "x", p % 2, "r") for p in range(400)]
    rows = spark.createDataFrame(rows, "place long, family_id string, family_title string, layer string, source_file string, row_no long, source_ref string")
    asked = spark.createDataFrame([(a, i, t) for a in range(50) for i, t in (("f", ""), ("", "Clan"), ("", "Kin"))], "asked long, family_id string, family_title string")
    found = review.linked_personas(asked, rows)
    assert {tuple(r) for r in found.select("asked", "family_id", "row_no", "place").collect()} == {(a, f, n, p + n) for a in range(50) for f, p in (("f", 0), ("", 300)) for n in (0, 1)}
    assert "Aggregate [key" in plan(found).split("Join Inner")[1].split(":- ")[-1]  # the members' side


def test_terms_of_a_root_are_held_in_many_tasks(spark, sf_dir):
    said = QUERIES["root_query_terms"](spark, sf_dir)
    below = plan(said).split("Aggregate [root", 1)[1]
    assert below.lstrip().split("\n")[1].strip().startswith("+- RepartitionByExpression [root")


def test_kinds_of_roots_are_never_broadcast(spark, sf_dir):
    said = QUERIES["root_query_terms"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "Broadcast" not in said and said.count("SortMergeJoin") == 5


def test_hints_of_a_row_are_told_apart_in_many_tasks(spark, sf_dir):
    found = QUERIES["tag_hints"](spark, sf_dir)
    assert "RepartitionByExpression [source_file" in plan(found) and "distinct" not in plan(found)
    twice = spark.createDataFrame([("a", 1, "r", ["#回顾", " #回顾 ", "#回顾"]), ("a", 1, "r", ["#回顾"]), ("a", None, "r", ["#回顾"]), ("a", 2, None, ["#回顾", "#人物"])], "source_file string, row_no long, source_ref string, tags array<string>")
    assert {(r.hint_kind, r.n_rows) for r in recall.hints(twice).collect()} == {("shadow_recall", 3), ("root_type", 1)}


def test_questions_that_are_put_alike_are_met_once(spark):
    texts = ["", "", "", "", ""]
    rows = spark.createDataFrame([(1, "a name of it", *texts, "f1", 1, ["x"], ["#回顾"]), (2, "other", *texts, "f2", 2, ["root"], ["#时间"])],
        "id long, title string, summary string, anchor_name string, family_anchor_id string, family_title string, source_ref string, family_id string, row_no long, identities array<string>, tags array<string>").withColumn("source_file", F.lit("s"))
    asked = spark.createDataFrame([(n, "zz 名字", "root", ["f1"] if n % 2 else None) for n in range(6)] + [(9, "nothing", "", [])], "asked long, question string, root_name string, families array<string>")
    touched, routes = recall.routed(asked, rows)
    assert {tuple(r) for r in touched.collect()} == {(n, i) for n in range(6) for i in ((1, 2) if n % 2 else (2,))}
    assert {(r.asked, r.n_touched) for r in routes.collect()} == {(n, 2 if n % 2 else 1) for n in range(6)} | {(9, 0)}
    assert "Aggregate [question" in plan(touched)


def _asked_and_tagged(spark):
    rng = random.Random(4)
    words, tags = ["steel", "old", "bolt", "gear_"], ["#回顾", " #时间", "#人物", "#关系规则", "#生活"]
    data = [(i, rng.choice(words), rng.choice(["", None, "big"]), "", rng.choice(["f1", "f2", "", None]), None, rng.choice(["", "f3"]), "", "s", i, [rng.choice(["Root", "x", ""])], rng.sample(tags, 2)) for i in range(150)]
    rows = spark.createDataFrame(data, "id long, title string, summary string, anchor_name string, family_id string, family_anchor_id string, family_title string, source_ref string, source_file string, row_no long, identities array<string>, tags array<string>")
    said = [(q, f"{rng.choice(['名字', 'what'])} {rng.choice(words)}", rng.choice(["root", "ig", ""]), rng.choice([["f1"], ["f3", "f2"], [], None])) for q in range(40)]
    want = {}
    for q, question, name, families in said:
        tokens = {question, name, *question.split(" ")} - {""}
        for i, title, summary, _, family, _, kin, _, _, _, names, marks in data:
            text = "\n".join(x for x in (title, summary or "", kin, *(t.strip() for t in marks)) if x)
            if any(t in text for t in tokens) or {family, kin} & {*(families or [])} - {""} or (name and name == names[0].lower()):
                want.setdefault(q, {})[i] = {t.strip() for t in marks} & {"#回顾", "#时间", "#关系规则"}
    return spark.createDataFrame(said, "asked long, question string, root_name string, families array<string>"), rows, said, want


def test_rows_that_questions_touch_are_pairs_at_the_end_only(spark, monkeypatch):
    monkeypatch.setattr(recall, "LIST", 7)
    monkeypatch.setattr(recall, "PAIRS", 10)
    questions, rows, _, want = _asked_and_tagged(spark)
    touched = recall.routed(questions, rows)[0]
    assert plan(touched).startswith("MapInArrow")  # no join, shuffle or group after the pairs are made
    found = [tuple(r) for r in touched.collect()]
    assert {*found} == {(q, i) for q, ids in want.items() for i in ids} and len(found) == len({*found}) > 1000


def test_routes_are_told_without_pairs(spark):
    questions, rows, said, want = _asked_and_tagged(spark)
    routes = recall.routed(questions, rows)[1]
    assert "RepartitionByExpression" not in plan(routes)  # no row that is touched is held
    hints = {q: set().union(*want.get(q, {0: set()}).values()) for q, *_ in said}
    assert {(r.asked, r.n_touched, r.n_hints, r.used) for r in routes.collect()} == {(q, len(want.get(q, {})), len(hints[q]), bool(hints[q]) and "名字" in question) for q, question, *_ in said}


def test_entries_that_score_alike_are_met_once(spark):
    entries = spark.createDataFrame([(i, f"t{i % 2}", "w", "src1_2025-01.json") for i in range(5, 400)], "id long, topic_id string, window_id string, file string")
    hints = spark.createDataFrame([(1, "topic", "t0"), (2, "window", "w")], "request long, kind string, value string")
    found = snippets.topic_snippets(hints, entries)
    assert {tuple(r) for r in found.collect()} == {(1, 1, 6, 5.0), (2, 1, 6, 3.0), (2, 2, 5, 3.0)}
    assert "Aggregate [topic_id" in plan(found)


def test_roles_of_quotes_are_told_once(spark):
    q = QUERIES["quote_refs"](spark, "/root/testdata/sf0.001")
    assert plan(q).count("split(") == 1
    one = spark.sql("SELECT decode(unhex('C2A0E2808020C2850961C285200A'), 'UTF-8') AS t").select(text.safe_text("t")).first()[0]
    assert one == "\x85\ta\x85"


def test_scenes_are_scored_in_blocks_without_joining_pairs(spark, monkeypatch):
    for name, n in (("ROWS", 30), ("REQUESTS", 7), ("CELLS", 100), ("DENSE", 300)):
        monkeypatch.setattr(score_blocks, name, n)
    rng = random.Random(2)
    words, kinds = ["steel", "old", "bolt", "ring", "x y"], list(scenes.FIELDS)
    columns = list(dict.fromkeys([*scenes.TEXT, *scenes.TAG_TEXT, *scenes.FIELDS.values(), "quote_refs"]))
    data = []
    for i in range(200):
        r = {c: rng.choice([None, "", " "]) for c in columns} | {c: rng.choice(["v1", "v2", " v1 ", "", None]) for c in scenes.FIELDS.values()}
        r |= {"title": " ".join(rng.sample(words, 2)).upper(), "tags": "#" + rng.choice(words), "quote_refs": rng.choice(["q", "", None]), "id": i, "start": rng.choice([None, rng.randrange(2000)]), "time": rng.choice([None, "1", "10"])}
        data.append(r | {"end": None if r["start"] is None else r["start"] + 3})
    rows = spark.createDataFrame(data, ", ".join(f"{c} string" for c in [*columns, "time"]) + ", id long, start long, end long")
    said = [(q, k, v) for q in range(20) for k, v in {(rng.choice([*kinds, "terms", "terms", "tag_terms"]), rng.choice(["v1", "v2", *words])) for _ in range(12)}]
    spans = [(q, rng.choice(["v1", None]), "v2", s, s + 3) for q in range(22) for s in (rng.randrange(2000), rng.randrange(2000))]
    terms = [(q, "STEEL") for q in range(21)]
    signals_ = spark.createDataFrame(said, "request long, kind string, value string")
    asked = signals_, spark.createDataFrame(spans, "request long, window_id string, window_title string, start long, end long"), spark.createDataFrame(terms, "request long, term string")
    t = lambda v: (v or "").strip()
    want = {}
    for q in range(22):
        mine = [(k, v) for p, k, v in said if p == q]
        for r in data:
            text, tagged = ("\n".join(t(r[c]).lower() for c in names) for names in (scenes.TEXT, scenes.TAG_TEXT))
            score = sum(3 for w in [*(v.lower() for k, v in mine if k == "terms"), *(["steel"] if q < 21 else [])] if w in text)
            score += sum(scenes.POINTS[k] for k, v in mine if k in kinds and t(r[scenes.FIELDS[k]]) == v) + 4 * any(k == "tag_terms" and v in tagged for k, v in mine) + (q < 21 and t(r["quote_refs"]) != "")
            near = any(p == q and r["start"] is not None and ((t(w) and t(w) == t(r["window_id"])) or v == t(r["window_title"])) and not (z + 96 < r["start"] or r["end"] + 96 < a) for p, w, v, a, z in spans)
            if score + 12 * near:
                want[q, r["id"]] = score + 12 * near
    found = scenes.scored(rows, *asked)
    assert {(r.request, r.id): r.score for r in found.collect()} == want and found.count() == len(want) > 3000
    assert "Aggregate" not in plan(found).split("FlatMapGroupsInArrow")[0]  # pairs are not grouped
    of = {r["id"]: next((t(r[c]) for c in ("topic_labels", "track_id", "title") if t(r[c])), "") for r in data}
    best = set()
    for q in range(22):
        groups = {}
        for (p, i), s in want.items():
            if p == q:
                groups.setdefault(of[i], []).append((-s, data[i]["time"] or "", i))
        ranked = sorted((sum(s for s, *_ in xs), g) for g, xs in groups.items())[: scenes.GROUPS]
        best |= {(q, g, n, len(groups[g]), -total, i, m, -s) for n, (total, g) in enumerate(ranked, 1) for m, (s, _, i) in enumerate(sorted(groups[g])[: scenes.GROUP_ROWS], 1)}
    assert {tuple(r) for r in scenes.packets(rows, *asked).collect()} == best


def test_a_row_is_sent_once_for_many_requests(spark):
    asked = spark.range(9000).selectExpr("id AS request", "0 AS channel", "'x' AS feature", "1.0 AS weight", "NULL AS lo", "NULL AS hi")
    rows = spark.range(100).selectExpr("id", "'' AS group", "'' AS time", "NULL AS lo", "NULL AS hi")
    sent = score_blocks._pairs(asked, rows, rows.selectExpr("id", "0 AS channel", "'x' AS feature", "1.0 AS value"))._df
    assert sent.where("side = 1").count() == 100


def test_prepared_snippets_leave_a_block_as_its_best(spark, monkeypatch):
    for name, n in (("ROWS", 30), ("REQUESTS", 5), ("CELLS", 100), ("DENSE", 300)):
        monkeypatch.setattr(score_blocks, name, n)
    rng = random.Random(3)
    data = [(i, f"window_20250101_msg_{rng.randrange(1, 90)}", rng.choice(["w1", "w2", "", None]), s, s + rng.randrange(-3, 90), rng.choice(["src1.json", "src12.json", "x", None]), rng.choice(["steel ring", "old", None])) for i, s in ((i, rng.randrange(90)) for i in range(120))]
    chunks = spark.createDataFrame(data, "id long, source_ref string, window_id string, start long, end long, file string, text string")
    spans = [(f"t{rng.randrange(3)}", rng.choice(["w1", "w2"]), s, s + 9) for s in (rng.randrange(90) for _ in range(6))]
    entries = spark.createDataFrame(spans, "topic_id string, window_id string, start long, end long")
    refs = [f"window_20250101_msg_{n}" for n in range(1, 90)]
    said = {(q, *x) for q in range(14) for x in rng.sample([*(("ref", r) for r in rng.sample(refs, 4)), ("window", "w1"), ("window", " w2"), ("batch", "src1.CSV"), ("batch", "src12"), ("topic", "t1"), ("topic", "t0"), ("term", "Steel"), ("term", "ring steel"), ("ref", "x")], 6)}
    want = {}
    for q in range(14):
        mine = {k: {v.strip() for p, kind, v in said if p == q and kind == k} for k in ("ref", "window", "batch", "topic", "term")}
        scored = []
        for i, own, w, a, z, file, text in data:
            at = {int(r.rpartition("_")[2]): r for r in mine["ref"] if r != "x"}
            score = sum(10 if r == own else 7 * (a > 0 and z > 0 and a <= n <= z and (not mine["window"] or w in mine["window"])) for n, r in at.items()) + 2 * (w in mine["window"])
            score += any(b.removesuffix(".CSV") in (file or "") for b in mine["batch"]) + 6 * len(mine["term"]) * ("steel ring" == text)
            over = sorted(t for t, ew, s, e in spans if t in mine["topic"] and ew == w and s > 0 and a > 0 and z > 0 and s <= z and a <= e)
            if score + 8 * bool(over):
                scored.append((-score - 8 * bool(over), i, over[0] if over else ""))
        want |= {(q, n): (i, -s, t) for n, (s, i, t) in enumerate(sorted(scored)[:8], 1)}
    calls, whole = [], score_blocks.best
    monkeypatch.setattr(score_blocks, "best", lambda *a: calls.append(a) or whole(*a))
    found = snippets.prepared_snippets(spark.createDataFrame(list(said), "request long, kind string, value string"), chunks, entries)
    assert {(r.request, r["rank"]): (r.id, r.score, r.topic) for r in found.collect()} == want
    assert len(calls) == 1  # no pair of request and chunk is a row


def test_chunks_and_requests_that_are_alike_are_scored_once(spark, monkeypatch):
    text = lambda i: "steel ring" if i % 4 == 0 else "old"
    chunks = spark.createDataFrame([(i, f"window_20250101_msg_{i}", f"w{i % 3}", 0, 0, f"src{i % 2}.json", text(i)) for i in range(5, 300)], "id long, source_ref string, window_id string, start long, end long, file string, text string")
    hints = [(q, k, v) for q in range(30) for k, v in (("window", f"w{q % 2}"), ("batch", "src1.CSV"), ("term", "steel"))]
    entries = spark.createDataFrame([], "topic_id string, window_id string, start long, end long")
    want = {}
    for q in range(30):
        scores = [(-(2 * (i % 3 == q % 2) + i % 2 + 6 * (i % 4 == 0)), i) for i in range(5, 300)]
        want |= {(q, n): (i, -s) for n, (s, i) in enumerate(sorted(x for x in scores if x[0])[:8], 1)}
    calls, whole = [], score_blocks.best
    monkeypatch.setattr(score_blocks, "best", lambda asked, rows, *a: calls.append((asked.select("request").distinct().count(), rows.count())) or whole(asked, rows, *a))
    found = snippets.prepared_snippets(spark.createDataFrame(hints, "request long, kind string, value string"), chunks, entries)
    assert {(r.request, r["rank"]): (r.id, r.score) for r in found.collect()} == want
    assert len(calls) == 1 and calls[0][0] == 2 and calls[0][1] <= 12


def test_rules_of_a_bundle_take_few_passes(spark, sf_dir):
    nodes = nested.walk(spark.range(1).select("id", F.concat(F.lit('{"a":['), "id", F.lit("]}")).alias("json")), "id", "json")
    passes = {f.__name__: plan(df).count("Range (") for f, df in ((f, f(nodes, "id", *more)) for f, more in ((contract.shape_violations, ["s"]), (contract.source_violations, []), (contract.whole_violations, [])))}
    assert passes == {"shape_violations": 5, "source_violations": 3, "whole_violations": 1}
    assert "RepartitionByExpression [conv_id" in plan(contract.assembled(spark.range(1).selectExpr("id AS conv_id", "0 AS place", "'hold' AS state", *(f"'' AS {c}" for c in ("reason", "title", "speaker", "excerpt", "source_file", "window"))), "conv_id"))


def test_items_of_roots_are_made_in_many_tasks(spark, sf_dir):
    found = plan(QUERIES["root_evidence"](spark, sf_dir))
    assert found.count("RepartitionByExpression [root") == 9


def test_facts_of_a_row_are_made_in_many_tasks(spark, sf_dir):
    assert "RepartitionByExpression [event_id" in plan(QUERIES["derived_facts"](spark, sf_dir))


def test_nested_values_are_walked_in_many_tasks(spark, sf_dir):
    assert "RepartitionByExpression [event_id" in plan(QUERIES["nested_privacy"](spark, sf_dir))
    deep = spark.createDataFrame([(1, '{"a":[{"b":"[[[["}]}'), (2, '[{"c":"\\"]"},2]'), (3, "{{{{"), (4, None)], "id long, json string")
    assert {(r.id, r.path) for r in nested.walk(deep, "id", "json").collect()} == {(1, "$"), (1, "$.a"), (1, "$.a[0]"), (1, "$.a[0].b"), (2, "$"), (2, "$[0]"), (2, "$[0].c"), (2, "$[1]")}
