"""The pipeline's stages: each on its own input, whole columns, odd rows and empty tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from threadloom.llm import near_dup  # noqa: E402

from .test_llm import brute_groups, brute_windows, empty, odd, rows_of  # noqa: E402, F401


def test_stages(spark, odd, tmp_path):  # noqa: F811
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = f"file://{tmp_path}/{name}"
        stage(spark, docs, odd).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    key = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before, after = seen["near_duplicates"]
    groups = brute_groups([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()])
    assert key(after) - {None} == {d for d, (_, c) in groups.items() if d == c}
    before, after = seen["decontamination"]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{odd}/benchmark.parquet").collect()]
    dirty = {r[0] for r in brute_windows([(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()], bench) if r[-1]}
    assert {str(k) for k in key(before) - key(after)} == dirty
    before, after = seen["secrets"]
    assert key(before) == key(after) and after.where("text LIKE '%[secret]%'").count() >= 4
    before, after = seen["packing"]
    assert key(before) == key(after)


def test_near_duplicates_at_80(spark, empty):  # noqa: F811
    docs, alike = [], []
    for k in range(60):  # 200 words: m new ones at the end leave 196 - m of 196 + m shingles
        m = 14 + k % 12
        base = [f"g{k}w{i}" for i in range(200)]
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base[: 200 - m], *(f"x{k}n{i}" for i in range(m))]))]
        alike.append(100 * (196 - m) >= 80 * (196 + m))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    left = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, empty).collect()}
    assert left == {2 * k for k in range(60)} | {2 * k + 1 for k in range(60) if not alike[k]} and 0 < sum(alike) < 60
    assert [near_dup.bands_of(p) for p in (80, 85)] == [(28, 4), (25, 5)]
    groups = near_dup.near_duplicates(frame).where("doc_id <> component_id").collect()
    assert {r["doc_id"] for r in groups} == {2 * k + 1 for k in range(60) if 100 * (182 - k % 12) >= 85 * (210 + k % 12)}


def test_run(spark, sf_dir, empty):  # noqa: F811
    assert corpus_pipeline.run(spark, empty).count() == 0
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 100 and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
