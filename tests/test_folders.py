"""Snapshots, JSON folders and commits: what is read, and what broken and repeated writes leave."""

import json
import os

import pytest
from pyspark.sql import functions as F

from threadloom.operators import commits
from threadloom.plans import folder_queries as fq
from threadloom.sources import folders, outputs


def test_index_opens_listed_files_only(spark, tmp_path):
    path = f"file://{tmp_path}/roots"
    assert folders.load_roots(spark, path, "k") is None
    cards = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 9).alias("kind"), F.repeat(F.lit("x"), 200).alias("body"))
    folders.write_roots(cards.limit(5), path, "s1", "k", "kind")
    folders.write_roots(cards, path, "s2", "k", "kind", files=4)
    names = [f for f in os.listdir(f"{tmp_path}/roots/s2/cards") if f.startswith("part-")]
    assert len(names) > 1
    index = folders.root_index(spark, path)
    assert index.count() == 4000 and "body" not in index.columns
    one = folders.load_roots(spark, path, "k", F.col("k") == 17)
    assert [r["k"] for r in one.collect()] == [17]
    opened = {f for f in one.inputFiles() if "/cards/" in f}
    assert len(opened) == 1 and len(folders.load_roots(spark, path, "k").inputFiles()) == len(names)
    assert folders.load_roots(spark, path, "k", F.col("k") < 0).count() == 0
    os.remove(f"{tmp_path}/roots/s2/cards/{next(n for n in names if n not in ''.join(opened))}")  # a file that the index does not name is not needed
    assert folders.load_roots(spark, path, "k", F.col("k") == 17).count() == 1


def test_json_folders_catalogues_and_stages(spark, tmp_path):
    assert folders.json_folder(spark, f"file://{tmp_path}/none", "topic string").count() == 0
    os.makedirs(f"{tmp_path}/in/memo")
    os.makedirs(f"{tmp_path}/in/case")
    for name, text in {"a.json": '[{"topic":"t1","n":2},{"n":"x"}]', "b.json": '{"topic":"no list"}', "c.json": "{broken", "d.txt": "[1]"}.items():
        open(f"{tmp_path}/in/{name}", "w").write(text)
    rows = folders.json_folder(spark, f"file://{tmp_path}/in", "topic string, n long").orderBy("file", "place").collect()
    assert [tuple(r) for r in rows] == [("a.json", 0, "t1", 2, False), ("a.json", 1, None, None, False), ("c.json", None, None, None, True)]
    for k in range(5):
        open(f"{tmp_path}/in/{('memo', 'case')[k % 2]}/draft_2025-0{k + 1}.json", "w").write(json.dumps({"generated_at": f"2025-0{k + 1}", "frontmatter": {"title": f" T{k} "}}))
    summary = {"generated_at": "$.generated_at", "title": "$.frontmatter.title"}
    got = folders.draft_catalogue(spark, f"file://{tmp_path}/in", summary, kind="memo", most=2).collect()
    assert [(r["artifact_id"], r["title"], r["total"]) for r in got] == [("draft_2025-05", "T4", 3), ("draft_2025-03", "T2", 3)] and got[0]["markdown_file"].endswith("memo/draft_2025-05.md")
    assert folders.draft_catalogue(spark, f"file://{tmp_path}/away", summary).count() == 0
    stages = {(r["stage"], r["file"]): r for r in folders.stage_files(spark, f"file://{tmp_path}/in").collect()}
    assert stages[("memo", "draft_2025-03.json")]["month_key"] == "2025-03" and stages[("case", "draft_2025-02.json")]["stage_files"] == 2
    assert stages[("in", "a.json")]["bytes"] == 32 and stages[("memo", "draft_2025-01.json")]["stage_bytes"] == sum(r["bytes"] for r in stages.values() if r["stage"] == "memo")


def read(spark, path):
    return [sorted(map(str, f(spark, path).collect())) for f in (commits.registry, commits.ledger)]


def test_commits_once_whatever_breaks_off(spark, sf_dir, tmp_path, monkeypatch):
    d = fq.decided(spark, sf_dir)
    part = lambda k: d.where(F.col("part") == k).drop("part")
    clean, rough = f"file://{tmp_path}/clean", f"file://{tmp_path}/rough"
    assert [commits.commit(part(k), clean, f"b{k}", k) for k in range(3)] == ["write"] * 3
    assert commits.commit(part(0), rough, "b0", 0) == "write"
    with monkeypatch.context() as m:  # the second batch breaks off after both tables, and before its marker
        m.setattr(commits, "write_text", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            commits.commit(part(1).limit(7), rough, "b1", 1)
    registry, _ = commits.entries(part(2))
    registry.limit(3).write.parquet(f"{rough}/registry/batch=b2")  # the third after a part of one table
    first = f"file://{tmp_path}/first"
    commits.commit(part(0), first, "b0", 0)
    assert read(spark, rough) == read(spark, first)
    assert [commits.commit(part(k), rough, f"b{k}", k) for k in (1, 2, 1, 0)] == ["write", "write", "replay", "replay"]
    assert commits.commit(part(1).limit(3), rough, "b1", 1) == "conflict"
    assert read(spark, rough) == read(spark, clean)
    total = commits.registry_summary(commits.registry(spark, clean)).agg(F.sum("n")).first()[0]
    assert total == commits.registry(spark, clean).count()


def test_outputs_tell_what_was_written(spark, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("title"), F.lit(None).cast("string").alias("kind"), "text")
    path = f"file://{tmp_path}/packets/p1"
    with monkeypatch.context() as m:  # breaks off before the manifest
        m.setattr(outputs, "write_text", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            outputs.packet(docs, path, "p1")
    assert outputs.reread(spark, path).count() == 0
    told = outputs.packet(docs.repartition(5), path, "p1")
    assert told["outputs"]["documents"]["rows"] == docs.count() and {r["whole"] for r in outputs.reread(spark, path).collect()} == {True}
    assert json.loads(open(f"{tmp_path}/packets/latest.json").read()) == {"latest": path}
    again = outputs.packet(docs.repartition(2, "text"), f"file://{tmp_path}/packets/p2", "p1")
    assert again["outputs"] == told["outputs"]  # whatever the order
    part = next(f for f in os.listdir(f"{tmp_path}/packets/p1/documents") if f.startswith("part-"))
    os.remove(f"{tmp_path}/packets/p1/documents/{part}")
    assert {r["output"]: r["whole"] for r in outputs.reread(spark, path).collect()} == {"documents": False, "index": True}
