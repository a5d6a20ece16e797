"""D12 against a plain fold over all clusters, on random notes and on the query's own."""

import random

import pytest

from threadloom.operators import compaction
from threadloom.plans import flow_queries
from threadloom.plans.registry import QUERIES

NOTES = "scope string, shape string, note long, at long, title string, slices array<string>, grams array<string>"


def near(a, b, shared, least):
    if len(a["slices"] & b["slices"]) < shared or not a["grams"] or not b["grams"]:
        return False
    return 2 * len(a["grams"] & b["grams"]) / (len(a["grams"]) + len(b["grams"])) >= least


def plain(rows, shared, least):
    out, held = {}, {}
    for r in sorted(rows, key=lambda r: (r["at"], r["title"], r["note"])):
        r = {**r, "slices": set(r["slices"] or []), "grams": set(r["grams"] or [])}
        best, most = None, -1.0
        for c in held.setdefault((r["scope"], r["shape"]), []):
            like = [m for m in c if near(r, m, shared, least)] if len(c) < compaction.LIMITS.get(r["shape"], 2) else []
            score = max((len(r["slices"] & m["slices"]) for m in like), default=0) + 1.2 * len(like)
            if like and score > most:
                best, most = c, score
        if best is None:
            best = []
            held[r["scope"], r["shape"]].append(best)
        best.append(r)
        out[r["note"]] = best[0]["note"]
    return out


@pytest.mark.parametrize(("shared", "least"), [(2, 0.18), (3, 0.5)])
def test_random_notes(spark, shared, least):
    rng = random.Random(shared)
    draw = lambda n, k: [f"w{rng.randrange(n)}" for _ in range(k)]
    rows = [(f"s{i % 2}", ("scene_event", "other")[i % 3 == 0], i, rng.randrange(40), f"t{rng.randrange(3)}", draw(14, rng.randrange(8)), draw(10, rng.randrange(7))) for i in range(260)]
    df = spark.createDataFrame(rows, NOTES)
    got = {r["note"]: r["cluster"] for r in compaction.compacted(df.repartition(5), shared, least).collect()}
    want = plain([r.asDict() for r in df.collect()], shared, least)
    assert got == want
    assert any(list(want.values()).count(c) == 3 for c in set(want.values()))


def test_query_against_plain_fold(spark, sf_dir, monkeypatch):
    seen = {}
    whole = compaction.compacted
    monkeypatch.setattr(flow_queries.compaction, "compacted", lambda n: seen.setdefault("n", n) and whole(n))
    got = {r["note"]: r["cluster"] for r in QUERIES["note_compaction"](spark, sf_dir).collect()}
    assert got == plain([r.asDict() for r in seen["n"].collect()], 5, 0.18)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201)]
    got = {r["id"]: r["component"] for r in compaction.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
