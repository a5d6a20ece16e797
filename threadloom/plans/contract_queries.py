"""Queries of nested JSON and the bundle contract; bundles are made of the conversations, one for each, and some are tampered with."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.nested import edited, json_text, walk
from threadloom.operators import contract
from threadloom.sources import outputs
from threadloom.sources.shared import held, shared_dir, spread
from threadloom.sources.tables import table

from .registry import query

#: Events inside five levels of objects and arrays, some of whose keys must not leave.
DEEP = """'{"a":[{"b":{"' || CASE event_id % 4 WHEN 0 THEN 'Vine' WHEN 1 THEN 'home_WRITE' ELSE 'fine' END || '":{"list":[1,[{"' || event_type || '":"/home/' || event_type || '"}],{"source_file":"C:\\\\x","snapshot":' || props || '}]}}},"~"],"Cluster' || (user_id % 3) || '":"sk-' || repeat('A', CAST(user_id % 30 AS INT)) || '"}'"""


def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props"), "event_id").select("event_id", F.expr(DEEP.replace("\\", "\\\\")).alias("json"))


@query(f"""WITH d AS (SELECT event_id, {DEEP} AS j FROM events) SELECT event_id, t.fullkey AS path, t.key AS key FROM d, json_tree(d.j) t WHERE lower(t.key) IN ({', '.join(f"'{k}'" for k in contract.FORBIDDEN)})""")
def forbidden_key_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each forbidden key at any depth."""
    return contract.forbidden_keys(walk(_deep(spark, sf_dir), "event_id", "json"), "event_id")


@query(f"""WITH d AS (SELECT event_id, {DEEP} AS j FROM events), t AS (SELECT event_id, x.fullkey AS path, x.atom ->> '$' AS v FROM d, json_tree(d.j) x WHERE x.type = 'VARCHAR' AND NOT regexp_matches(x.fullkey, '\\.source_file($|[.\\[])')),
  h AS (SELECT event_id, path, CASE WHEN regexp_matches(v, 'sk-[A-Za-z0-9_-]{{20,}}') THEN 'secret_like_api_key' WHEN regexp_matches(v, '/(?:Users|home|srv)/[^\\s"''`]+|[A-Za-z]:[\\\\/][^\\s"''`]+') THEN 'absolute_private_path' END AS reason FROM t) SELECT * FROM h WHERE reason IS NOT NULL""")
def nested_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and private paths in nested values; a source_file may be one."""
    return contract.privacy_hits(walk(_deep(spark, sf_dir), "event_id", "json"), "event_id")


def conversation_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sealed bundle (conv_id, json) of each conversation: users' turns are accepted, assistants' held, others rejected."""
    m = table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    state = F.when(F.col("role") == "user", "accepted").when(F.col("role") == "assistant", "hold").otherwise("rejected")
    rows = m.select(
        "conv_id", F.col("turn").alias("place"), state.alias("state"), F.concat("role", F.lit(" turn")).alias("reason"), F.left("text", F.lit(30)).alias("title"), F.col("role").alias("speaker"), F.left("text", F.lit(400)).alias("excerpt"),
        F.when(F.col("turn") % 3 == 0, "export.json").otherwise("").alias("source_file"), F.concat(F.lit("w"), F.col("conv_id").cast("string")).alias("window"),
    )
    return contract.assembled(rows, "conv_id")


def tampered(bundles: DataFrame, seal: bool = True) -> DataFrame:
    """Bundles of which most have one fault, by conv_id; sealed again, so that the fault itself must be found."""
    v, k = F.try_parse_json("json"), F.col("conv_id") % 16
    text = lambda s: F.lit(f'"{s}"')
    faults: dict[int, dict[tuple[str, ...], Column | None]] = {
        1: {("source_spans", "[]", "excerpt_text"): text("changed")}, 2: {("conservation",): None}, 3: {("persona_authority",): F.lit('{"authority":1,"Vine":{"snapshot":[{}]}}')},
        4: {("warm_cards", "[]", "source_refs", "source_span_ids"): F.lit('["span_x","span_x"]')}, 5: {("warm_cards", "[]", "source_refs", "source_occurrence_ids"): F.lit("[]")},
        6: {("source_occurrences", "[]", "source_file"): text("/home/me/x.json")}, 7: {("hold_ledger", "[]", "state"): text("rejected"), ("hold_ledger", "[]", "row_digest"): text("sha256:0"), ("hold_ledger", "[]", "title"): text("new")},
        8: {("conservation", "input_rows"): F.lit("99"), ("manifest", "candidate_count"): F.lit('"1"')}, 9: {("warm_cards", "[]", "quality", "source_bound"): F.lit("false"), ("warm_cards", "[]", "privacy"): F.lit("[]")},
        10: {("source_spans", "[]", "bounds"): F.lit('{"start":1,"end":0.5,"unit":"bytes"}')}, 11: {("warm_cards", "[]", "candidate_id"): text("same"), ("schema",): text("other")},
        12: {("rejected_ledger",): F.lit("{}"), ("projection_roundtrip", "notion", "candidate_id_map"): F.lit("[1]")}, 13: {("source_manifest", "source_digest"): text(" ")},
        14: {("warm_cards", "[]", "home_import_policy"): F.lit('{"direct_write_allowed":true,"state":" ","reason":"r","more":[]}')},
    }
    whole = held(bundles.select("conv_id", "json"))
    out = whole.where(~k.isin(*faults)).withColumn("json", F.when(F.col("conv_id") % 48 == 15, "[1]").when(F.col("conv_id") % 48 == 31, "{").otherwise(F.col("json")))
    for n, edits in faults.items():
        out = out.unionByName(whole.where(k == n).withColumn("json", edited(v, edits)))
    return out.withColumn("json", F.coalesce(contract.canonical_bundle(F.col("json")), "json")) if seal else out


@query()
def bundle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: every broken rule of bundles, one row each (a test holds it against a plain validator)."""
    return contract.contract_violations(tampered(conversation_bundles(spark, sf_dir)), "conv_id", "json")


def legacy_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of which a third have the older import policy in their cards, some of these unsound or with other faults."""
    b = conversation_bundles(spark, sf_dir)
    k, v = F.col("conv_id") % 6, F.try_parse_json("json")
    policy = F.when(k == 5, F.lit('{"direct_write_allowed":true,"state":"s","reason":"r"}')).otherwise(F.lit('{"reason":"r","state":"s","direct_write_allowed":false}'))
    tier = F.concat(json_text(F.lit("default")), F.lit(',"old_import_policy":'), policy)
    old = edited(v, {("warm_cards", "[]", "frontend_delivery_tier"): tier})
    other = edited(v, {("schema",): F.lit('"other"')})
    b = b.withColumn("json", F.when(k.isin(1, 2, 5), old).otherwise(F.col("json"))).withColumn("json", F.when(k.isin(2, 3), other).otherwise(F.col("json")))
    return b.withColumn("json", contract.canonical_bundle(F.col("json")))


@query()
def legacy_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: how older bundles are read: mode, digests before and after, and whether they are sound now (against a plain version in a test)."""
    return contract.read_normalised(legacy_bundles(spark, sf_dir), "conv_id", "json", "old_import_policy")[0].drop("json")


def reviewed_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of which a fifth has another schema and a fifth a private path."""
    b = conversation_bundles(spark, sf_dir)
    k, v = F.col("conv_id") % 5, F.try_parse_json("json")
    other, private = edited(v, {("schema",): F.lit('"other"')}), edited(v, {("persona_authority", "authority"): F.lit('"see /home/me/notes"')})
    b = b.withColumn("json", F.when(k == 1, other).when(k == 2, private).otherwise(F.col("json")))
    return b.withColumn("json", contract.canonical_bundle(F.col("json")))


_ROWS = "r AS (SELECT conv_id, role FROM conversations WHERE trim(text) <> '' AND conv_id % 5 NOT IN (1, 2))"


@query(f"""WITH {_ROWS}, c AS (SELECT count(*) FILTER (role = 'user') AS u, count(*) FILTER (role <> 'user') AS o FROM r)
  SELECT unnest(['cards', 'spans', 'roundtrip', 'notes', 'ledger']) AS output, unnest([u, u, u, u, o]) AS rows, true AS whole FROM c""")
def projection_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K6: rows of each review surface by its manifest, and whether the files hold the same."""
    path = f"{shared_dir(spark)}/projections-{uuid.uuid4().hex}/one"
    outputs.projections(reviewed_bundles(spark, sf_dir), "conv_id", "json", path)
    return outputs.reread(spark, path).drop("digest")


@query("""SELECT conv_id, CASE WHEN conv_id % 5 = 2 THEN 'blocked_by_privacy' WHEN conv_id % 5 = 1 THEN 'blocked_by_contract' WHEN count(*) FILTER (role = 'user') > 0 THEN 'written' ELSE 'written_empty' END AS status FROM conversations WHERE trim(text) <> '' GROUP BY conv_id""")
def projection_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bundles can be shown, and what holds the others back."""
    return outputs.projections(reviewed_bundles(spark, sf_dir), "conv_id", "json", f"{shared_dir(spark)}/projections-{uuid.uuid4().hex}/one")


@query("""SELECT 'documents' AS output, count(*) AS rows, true AS whole FROM documents UNION ALL SELECT 'index', count(*), true FROM documents""")
def ingest_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: documents and their index as one packet."""
    path = f"{shared_dir(spark)}/packets-{uuid.uuid4().hex}/p1"
    outputs.packet(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.col("lang").alias("kind"), "text"), path, "p1")
    return outputs.reread(spark, path).drop("digest")
