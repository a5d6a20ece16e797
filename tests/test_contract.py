"""Nested JSON and the bundle contract against plain recursion over parsed JSON."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from threadloom.functions import nested
from threadloom.operators import contract
from threadloom.plans import contract_queries as cq

LINES = {shape: (kind, "".join(flags)) for shape, kind, *flags in (x.split() for x in contract.CONTRACT.strip().split("\n"))}


def stable(x):
    return json.dumps(x, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def text_of(x):
    return x.strip() if isinstance(x, str) else ""


def sealed(b):
    m = {**b["manifest"], "manifest_digest": ""}
    return sha(stable({**b, "manifest": m}))


def is_count(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool) and x >= 0 and x == int(x)


def nodes(x, path="$", shape="$"):
    yield path, shape, x
    if isinstance(x, dict):
        for k, v in x.items():
            yield from nodes(v, f"{path}.{k}", f"{shape}.{k}")
    elif isinstance(x, list):
        for i, v in enumerate(x):
            yield from nodes(v, f"{path}[{i}]", f"{shape}[]")


def objects(b, name):
    rows = b.get(name)
    return [(f"$.{name}[{i}]", r) for i, r in enumerate(rows) if isinstance(r, dict)] if isinstance(rows, list) else []


def brute(raw, schema="bundle_v0"):
    """(path, rule) of every broken rule."""
    try:
        b = json.loads(raw)
    except ValueError:
        return {("$", "not_object")}
    out = set()
    add = lambda path, rule: out.add((path, rule))
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool}
    for path, shape, x in nodes(b):
        key = path.rpartition(".")[2] if not path.endswith("]") else ""
        if key.lower() in contract.FORBIDDEN:
            add(path, "forbidden_key")
        if shape.endswith("[]") and "*" in LINES.get(shape[:-2], ("", ""))[1]:
            if not isinstance(x, str):
                add(path, "wrong_kind")
            elif not x.strip():
                add(path, "blank")
            elif len(x.strip().encode("utf-16-le")) > 1024:
                add(path, "too_long")
        if shape not in LINES:
            continue
        kind, flags = LINES[shape]
        if not (kind == "any" or (kind == "integer" and is_count(x)) or (kind in kinds and isinstance(x, kinds[kind]))):
            add(path, "wrong_kind")
        if kind == "string" and isinstance(x, str) and not x.strip() and "~" not in flags:
            add(path, "blank")
        if "+" in flags and x == []:
            add(path, "empty")
        if "#" in flags and not (isinstance(x, str) and re.fullmatch("sha256:[a-f0-9]{64}", x)):
            add(path, "bad_digest")
        if "=" in flags and isinstance(x, bool) and x != (flags.endswith("true")):
            add(path, "must_be")
        if (shape == "$.schema" and not isinstance(x, (dict, list, type(None))) and str(x) != schema) or (shape.endswith(".unit") and not isinstance(x, (dict, list, type(None))) and str(x) != "utf16_code_units"):
            add(path, "must_be")
        if isinstance(x, dict):
            children = {s.rpartition(".")[2]: f for s, (_, f) in LINES.items() if "." in s and s.rpartition(".")[0] == shape}
            if children:
                for k in x.keys() - children.keys():
                    add(f"{path}.{k}", "unknown_field")
                for k, f in children.items():
                    if "!" in f and k not in x:
                        add(f"{path}.{k}", "required")
        if isinstance(x, list) and "*" in flags:
            said = [text_of(v) for v in x]
            for i, v in enumerate(said):
                if v and v in said[:i]:
                    add(f"{path}[{i}]", "not_unique")
        if shape == "$.projection_roundtrip.notion.candidate_id_map" and isinstance(x, list) and x:
            add(path, "must_be_empty")
    if not isinstance(b, dict):
        add("$", "not_object")
        return out
    for path, o in objects(b, "source_occurrences"):
        file, said = text_of(o.get("source_file")), text_of(o.get("source_file_digest"))
        if file and not said:
            add(f"{path}.source_file_digest", "file_digest_missing")
        if said and not re.fullmatch("sha256:[a-f0-9]{64}", o["source_file_digest"]):
            add(f"{path}.source_file_digest", "bad_digest")
        if file and ("/" in file or "\\" in file):
            add(f"{path}.source_file", "private_path")
        if not file and not text_of(o.get("source_window")):
            add(f"{path}.source_file", "no_source")
        if text_of(o.get("digest")) and o["digest"] != sha(stable({k: v for k, v in o.items() if k != "digest"})):
            add(f"{path}.digest", "digest_mismatch")
    for path, o in objects(b, "source_spans"):
        if text_of(o.get("excerpt_text")) and text_of(o.get("excerpt_digest")) and o["excerpt_digest"] != sha(o["excerpt_text"]):
            add(f"{path}.excerpt_digest", "digest_mismatch")
        if isinstance(o.get("bounds"), dict):
            start, end = o["bounds"].get("start"), o["bounds"].get("end")
            numbers = all(isinstance(v, (int, float)) for v in (start, end))
            if not numbers or start < 0 or end < start:
                add(f"{path}.bounds", "bad_range")
            if start != 0:
                add(f"{path}.bounds.start", "must_be")
            if text_of(o.get("excerpt_text")) and end != len(o["excerpt_text"].encode("utf-16-le")) // 2:
                add(f"{path}.bounds.end", "length_mismatch")
    for name, state, prefix, fields in (("hold_ledger", "hold", "hold_", ("reason", "sourceId", "sourceKind", "title")), ("rejected_ledger", "rejected", "reject_", ("reason", "sourceId", "sourceKind"))):
        for path, o in objects(b, name):
            if text_of(o.get("state")) != state:
                add(f"{path}.state", "must_be")
            spelled = {"sourceId": "source_id", "sourceKind": "source_kind"}
            want = prefix + hashlib.sha256(stable({f: text_of(o.get(spelled.get(f, f))) for f in fields}).encode()).hexdigest()[:16]
            if text_of(o.get("ledger_id")) and o["ledger_id"] != want:
                add(f"{path}.ledger_id", "id_mismatch")
    for shape, field in contract.IDS.items():
        seen = set()
        for path, o in objects(b, shape[2:-2]):
            own = text_of(o.get(field))
            if own and own in seen:
                add(f"{path}.{field}", "not_unique")
            seen.add(own)
    there = {text_of(o.get("source_occurrence_id")) for _, o in objects(b, "source_occurrences")} - {""}
    span_of = {text_of(o.get("source_span_id")): text_of(o.get("source_occurrence_id")) for _, o in objects(b, "source_spans")}
    for path, o in objects(b, "source_spans"):
        if text_of(o.get("source_occurrence_id")) and text_of(o["source_occurrence_id"]) not in there:
            add(f"{path}.source_occurrence_id", "no_occurrence")
    for path, card in objects(b, "warm_cards"):
        refs = card.get("source_refs") if isinstance(card.get("source_refs"), dict) else {}
        spans, own = (refs.get(k) if isinstance(refs.get(k), list) else [] for k in ("source_span_ids", "source_occurrence_ids"))
        mine, proven = {text_of(x) for x in own} - {""}, set()
        for i, x in enumerate(own):
            if text_of(x) and text_of(x) not in there:
                add(f"{path}.source_refs.source_occurrence_ids[{i}]", "no_occurrence")
        for i, x in enumerate(spans):
            if not text_of(x) or text_of(x) not in span_of:
                add(f"{path}.source_refs.source_span_ids[{i}]", "no_span")
            elif occurrence := span_of[text_of(x)]:
                proven.add(occurrence)
                if mine and occurrence not in mine:
                    add(f"{path}.source_refs.source_span_ids[{i}]", "foreign_span")
        if mine != proven:
            add(f"{path}.source_refs.source_occurrence_ids", "not_proven")
        quality = card.get("quality") if isinstance(card.get("quality"), dict) else {}
        if quality.get("source_span_count") != len(spans):
            add(f"{path}.quality.source_span_count", "count_mismatch")
    at = lambda path: (b.get(path.split(".")[1]) or {}).get(path.split(".")[2]) if isinstance(b.get(path.split(".")[1]), dict) else None
    for path, name in contract.COUNTS.items():
        rows = b.get(name[2:]) if isinstance(b.get(name[2:]), list) else []
        if is_count(at(path)) and at(path) != len(rows):
            add(path, "count_mismatch")
    n = {k: at(f"$.conservation.{k}") for k in ("input_rows", "input_growth_draft_rows", "input_reviewed_rows", "accepted_rows", "rejected_rows", "hold_rows")}
    for parts in (("input_growth_draft_rows", "input_reviewed_rows"), ("accepted_rows", "rejected_rows", "hold_rows")):
        if all(is_count(n[k]) for k in ("input_rows", *parts)) and n["input_rows"] != sum(n[k] for k in parts):
            add("$.conservation.input_rows", "sum_mismatch")
    lists = {k: b.get(k) if isinstance(b.get(k), list) else [] for k in ("source_occurrences", "source_spans")}
    if text_of(at("$.source_manifest.source_digest")) and at("$.source_manifest.source_digest") != sha(stable(lists)):
        add("$.source_manifest.source_digest", "digest_mismatch")
    if text_of(at("$.manifest.manifest_digest")) and at("$.manifest.manifest_digest") != sealed(b):
        add("$.manifest.manifest_digest", "digest_mismatch")
    return out


def violations(df):
    return {(r["conv_id"], r["path"], r["rule"]) for r in df.collect()}


@pytest.mark.parametrize("seal", [True, False])
def test_contract_violations(spark, sf_dir, seal):
    own = cq.conversation_bundles(spark, sf_dir)
    more = [own.withColumn("conv_id", F.col("conv_id") + F.lit(1000 * k + k)) for k in range(5)]  # other faults for the same bundles
    bundles = more[0]
    for m in more[1:]:
        bundles = bundles.unionByName(m)
    bundles = cq.tampered(bundles, seal).checkpoint()
    rows = bundles.collect()
    want = {(r["conv_id"], *v) for r in rows for v in brute(r["json"])}
    got = violations(contract.contract_violations(bundles, "conv_id", "json"))
    assert got == want, (sorted(got - want)[:5], sorted(want - got)[:5])
    assert {r["conv_id"] for r in rows if r["conv_id"] % 16 == 0}.isdisjoint({v[0] for v in got})
    assert {v[2] for v in got} >= {"unknown_field", "required", "wrong_kind", "blank", "empty", "must_be", "bad_digest", "not_unique", "not_object", "must_be_empty", "forbidden_key", "private_path", "digest_mismatch", "bad_range", "length_mismatch", "id_mismatch", "no_span", "not_proven", "count_mismatch", "sum_mismatch"}


def test_legacy_reading(spark, sf_dir):
    bundles = cq.legacy_bundles(spark, sf_dir).checkpoint()
    read, after = contract.read_normalised(bundles, "conv_id", "json", "old_import_policy")
    left = violations(after)
    texts, modes = {r["conv_id"]: r["json"] for r in bundles.collect()}, set()
    for r in read.collect():
        raw, b = texts[r["conv_id"]], json.loads(texts[r["conv_id"]])
        faults = brute(raw)
        old = [(f"$.warm_cards[{i}].old_import_policy", c["old_import_policy"]) for i, c in enumerate(b["warm_cards"]) if "old_import_policy" in c]
        if not faults:
            mode = "current_contract"
        elif not old:
            mode = "strict_rejected"
        elif any(p not in dict(old) for p, _ in faults) or any(p["direct_write_allowed"] for _, p in old):
            mode = "legacy_rejected"
        else:
            mode = "legacy_read_only"
            for c in b["warm_cards"]:
                del c["old_import_policy"]
            b["manifest"]["manifest_digest"] = sealed(b)
            assert r["digest_now"] == b["manifest"]["manifest_digest"] and r["digest_before"] != r["digest_now"]
            raw, faults = stable(b), brute(stable(b))
        assert (r["mode"], r["stripped"], r["json"], r["ok"]) == (mode, len(old), raw, not faults)
        assert {v[1:] for v in left if v[0] == r["conv_id"]} == faults
        modes.add(mode)
    assert modes >= {"current_contract", "strict_rejected", "legacy_rejected", "legacy_read_only"}


def test_walk_depth_arrays_and_edits(spark):
    docs = {1: '{"a":[{"b":{"Vine":{"c":[[{"Snapshots":1}]]}}},"x"],"cluster":null}', 2: "[]", 3: "{{{{", 4: None, 5: '"vine"', 6: '{"k\\"q":"a\\nb","n":1}'}
    df = spark.createDataFrame(list(docs.items()), "id long, j string")
    found = nested.walk(df, "id", "j").select("id", "path", "shape", "kind", "text", "place").collect()
    want = {(i, p, s) for i, t in docs.items() if t and i != 3 for p, s, _ in nodes(json.loads(t))}
    assert {(r["id"], r["path"], r["shape"]) for r in found} == want
    keys = {(r["path"], r["key"]) for r in contract.forbidden_keys(nested.walk(df, "id", "j"), "id").collect()}
    assert keys == {("$.a[0].b.Vine", "Vine"), ("$.a[0].b.Vine.c[0][0].Snapshots", "Snapshots"), ("$.cluster", "cluster")}
    v = F.try_parse_json("j")
    out = {r["id"]: r["e"] for r in df.select("id", nested.edited(v, {("a", "[]", "b", "Vine"): None, ("n",): F.lit("[2]"), ("none", "x"): None}).alias("e")).collect()}
    assert out == {1: '{"a":[{"b":{}},"x"],"cluster":null}', 2: "[]", 3: None, 4: None, 5: '"vine"', 6: '{"k\\"q":"a\\nb","n":[2]}'}
