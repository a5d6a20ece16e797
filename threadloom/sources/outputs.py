"""Several outputs as one: row counts and digests are taken while each is written, the manifest comes last."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.ids import digest
from threadloom.functions.nested import walk
from threadloom.functions.text import first_text, preview
from threadloom.operators.contract import privacy_hits, read_normalised

from .folders import exists, read_text, write_text
from .shared import held


def _facts(df: DataFrame) -> list[Column]:
    """The number of rows, and the sum of their hashes, which is the same in any order. Rows are taken as the JSON that is written."""
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64("line").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")]


def write_outputs(outputs: dict[str, DataFrame], path: str, **about: str) -> dict:
    """Writes frames as JSON lines, one row a line, under their names, then ``manifest.json`` with what was seen of each and ``about``, then the pointer ``latest.json`` beside the folder.

    A manifest that is there tells of a whole output: a run that breaks off leaves none, and the next one overwrites what it finds.
    """
    told = {}
    spark = next(iter(outputs.values())).sparkSession
    for name, df in outputs.items():
        lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
        seen = Observation(name)
        lines.observe(seen, *_facts(lines)).write.mode("overwrite").text(f"{path}/{name}")
        told[name] = {"rows": seen.get["rows"], "digest": seen.get["digest"]}
    manifest = {**about, "outputs": told}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, sort_keys=True))
    write_text(spark, f"{path.rpartition('/')[0]}/latest.json", json.dumps({"latest": path}))
    return manifest


def reread(spark: SparkSession, path: str) -> DataFrame:
    """(output, rows, digest, whole): what the manifest of an output says, and whether the files say the same now; nothing without a manifest."""
    schema = "output string, rows long, digest string, whole boolean"
    if not exists(spark, f"{path}/manifest.json"):
        return spark.createDataFrame([], schema)
    manifest, found = json.loads(read_text(spark, f"{path}/manifest.json")), None
    for name, told in manifest["outputs"].items():
        lines = spark.read.text(f"{path}/{name}").withColumnRenamed("value", "line")
        one = lines.agg(*_facts(lines)).select(F.lit(name).alias("output"), F.lit(told["rows"]).cast("long").alias("rows"), F.lit(told["digest"]).alias("digest"), ((F.col("rows") == told["rows"]) & (F.col("digest") == told["digest"])).alias("whole"))
        found = one if found is None else found.unionByName(one)
    return found


def packet(documents: DataFrame, path: str, packet_id: str) -> dict:
    """An ingest packet of documents (doc_id, title, kind, text): whole documents, and an index without their texts."""
    index = documents.select("doc_id", first_text("title").alias("title"), first_text("kind").alias("kind"), F.length("text").cast("long").alias("char_count"), preview("text").alias("preview"))
    return write_outputs({"documents": documents.select(*index.columns[:3], "text"), "index": index}, path, packet_id=packet_id)


def projections(bundles: DataFrame, id_: str, json_: str, path: str, old_field: str = "old_import_policy") -> DataFrame:
    """Writes the review surfaces of sound bundles, and returns (id, status): ``blocked_by_privacy`` (secrets or private paths in them), ``blocked_by_contract``, ``written``, or ``written_empty`` without cards.

    Outputs: ``cards``, ``spans`` with the cards that cite them, ``ledger``, ``roundtrip`` (what finds a card again, with a hash of what was shown), ``notes`` (file name and Markdown of each card).
    """
    read = held(read_normalised(bundles, id_, json_, old_field)[0].select(id_, "ok", "json"))
    private = privacy_hits(walk(read, id_, "json"), id_).select(id_).distinct().withColumn("private", F.lit(True))
    v = F.try_parse_json("json")
    n = F.coalesce(F.size(F.try_variant_get(v, "$.warm_cards", "array<variant>")), F.lit(0))
    status = F.when(F.col("private"), "blocked_by_privacy").when(~F.col("ok"), "blocked_by_contract").when(n == 0, "written_empty").otherwise("written")
    states = held(read.join(private, id_, "left").select(id_, status.alias("status"), "json"))
    good = states.where(F.col("status").startswith("written")).select(id_, F.try_variant_get(v, "$.manifest.bundle_id", "string").alias("bundle_id"), v.alias("v"))
    items = lambda name: good.select("bundle_id", F.posexplode(F.try_variant_get("v", f"$.{name}", "array<variant>")).alias("place", "x"))
    get = lambda *paths: [F.try_variant_get("x", f"$.{p}", "string").alias(p.rpartition(".")[2]) for p in paths]
    refs = lambda name: F.try_variant_get("x", f"$.source_refs.{name}", "array<string>").alias(name)
    cards = held(items("warm_cards").select("bundle_id", "place", *get("candidate_id", "title", "archive_bucket", "frontend_delivery_tier", "portable_warm_card.body_markdown", "portable_warm_card.living_fragment"), refs("source_span_ids"), refs("source_occurrence_ids"), digest(F.to_json("x")).alias("sync_hash")))
    cited = cards.select("bundle_id", "candidate_id", F.explode("source_span_ids").alias("source_span_id")).groupBy("bundle_id", "source_span_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("linked_candidate_ids"))
    seen = items("source_occurrences").select("bundle_id", *get("source_occurrence_id", "source_file", "source_window", "turn_range"))
    spans = items("source_spans").select("bundle_id", *get("source_span_id", "source_occurrence_id", "speaker", "excerpt_text", "excerpt_digest")).join(seen, ["bundle_id", "source_occurrence_id"], "left").join(cited, ["bundle_id", "source_span_id"], "left")
    ledger = items("rejected_ledger").unionByName(items("hold_ledger")).select("bundle_id", *get("ledger_id", "state", "reason", "source_kind", "source_id", "title", "row_digest"))
    name = F.concat(F.lit("Warm Card "), F.lpad((F.col("place") + 1).cast("string"), 3, "0"), F.lit(" "), F.regexp_replace("candidate_id", r"[^A-Za-z0-9_-]+", "_"), F.lit(".md"))
    links = F.array_join(F.transform("source_span_ids", lambda s: F.concat(F.lit("- [["), s, F.lit("]]"))), "\n")
    body = F.concat(F.lit("# "), "title", F.lit("\n\n"), "body_markdown", F.lit("\n\n## Sources\n\n"), links, F.lit("\n"))
    outputs = {
        "cards": cards.drop("place"), "spans": spans, "ledger": ledger, "roundtrip": cards.select("candidate_id", "bundle_id", "sync_hash", name.alias("file")), "notes": cards.select("bundle_id", name.alias("file"), body.alias("markdown")),
    }
    write_outputs(outputs, path, kind="review_projection", canonical_truth="false")
    return states.select(id_, "status")


