"""The contract of evidence bundles: every broken rule of a bundle as a row (id, path, rule), and the reading of older bundles.

A bundle is one JSON text. It is walked once; the contract is a small table of shapes that the walk's rows meet, so that keys, kinds,
blanks and fixed values are one join with a bounded table. References, counts and digests are joins and groupings of
the walk's rows by bundle; a bundle of many spans is many rows, not one large record in a function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import digest
from threadloom.functions.nested import canonical, edited, json_text, walk
from threadloom.functions.text import safe_text, utf16_length
from threadloom.sources.shared import held as kept
from threadloom.sources.shared import spread

#: The fields of a bundle, their kind, and what they must keep: ``!`` there, ``~`` may be blank, ``+`` not
#: empty, ``*`` texts that are not blank, not over 512 characters and not repeated, ``#`` a digest, ``=`` equal to.
CONTRACT = """
$ object
$.schema string !~
$.manifest object !
$.manifest.bundle_id string !
$.manifest.created_at string !
$.manifest.generator string !
$.manifest.scope object !
$.manifest.scope.owner_id string !~
$.manifest.scope.realm_id string !~
$.manifest.scope.bot_id string !~
$.manifest.candidate_count integer !
$.manifest.source_span_count integer !
$.manifest.manifest_digest string !
$.source_manifest object !
$.source_manifest.source_count integer !
$.source_manifest.source_occurrence_count integer !
$.source_manifest.source_span_count integer !
$.source_manifest.source_digest string !
$.persona_authority object !
$.persona_authority.authority string !~
$.persona_authority.persona_digest string !~
$.persona_authority.language_fingerprint_digest string !~
$.warm_cards array !
$.warm_cards[] object
$.warm_cards[].candidate_id string !
$.warm_cards[].title string !
$.warm_cards[].archive_bucket string !
$.warm_cards[].frontend_delivery_tier string !
$.warm_cards[].portable_warm_card object !
$.warm_cards[].portable_warm_card.body_markdown string !
$.warm_cards[].portable_warm_card.living_fragment string !
$.warm_cards[].portable_warm_card.feeling_as_fact string ~
$.warm_cards[].portable_warm_card.future_use_hint string ~
$.warm_cards[].portable_warm_card.voice_fingerprint_refs array *
$.warm_cards[].portable_warm_card.persona_refs array *
$.warm_cards[].source_refs object !
$.warm_cards[].source_refs.source_occurrence_ids array !+*
$.warm_cards[].source_refs.source_span_ids array !+*
$.warm_cards[].privacy object !
$.warm_cards[].privacy.local_only boolean !=true
$.warm_cards[].privacy.projection_requires_user_action boolean !=true
$.warm_cards[].quality object !
$.warm_cards[].quality.source_bound boolean !=true
$.warm_cards[].quality.source_complete boolean !=true
$.warm_cards[].quality.source_span_count integer !
$.warm_cards[].quality.source_incomplete boolean !=false
$.warm_cards[].home_import_policy object !
$.warm_cards[].home_import_policy.direct_write_allowed boolean !=false
$.warm_cards[].home_import_policy.state string !
$.warm_cards[].home_import_policy.reason string !
$.source_occurrences array !
$.source_occurrences[] object
$.source_occurrences[].source_occurrence_id string !
$.source_occurrences[].source_id string !
$.source_occurrences[].source_kind string !
$.source_occurrences[].source_file string !~
$.source_occurrences[].source_file_digest string !~
$.source_occurrences[].source_window string !~
$.source_occurrences[].turn_range string !
$.source_occurrences[].message_ids array !*
$.source_occurrences[].source_time string !~
$.source_occurrences[].digest string !
$.source_spans array !
$.source_spans[] object
$.source_spans[].source_span_id string !
$.source_spans[].source_occurrence_id string !
$.source_spans[].turn_range string !
$.source_spans[].message_ids array !*
$.source_spans[].speaker string !
$.source_spans[].excerpt_text string !
$.source_spans[].excerpt_digest string !
$.source_spans[].bounds object !
$.source_spans[].bounds.start integer !
$.source_spans[].bounds.end integer !
$.source_spans[].bounds.unit any !
$.rejected_ledger array !
$.rejected_ledger[] object
$.rejected_ledger[].ledger_id string !
$.rejected_ledger[].state string !
$.rejected_ledger[].reason string !
$.rejected_ledger[].source_kind string !
$.rejected_ledger[].source_id string !
$.rejected_ledger[].title string ~
$.rejected_ledger[].row_digest string !#
$.rejected_ledger[].review_note string ~
$.hold_ledger array !
$.hold_ledger[] object
$.hold_ledger[].ledger_id string !
$.hold_ledger[].state string !
$.hold_ledger[].reason string !
$.hold_ledger[].source_kind string !
$.hold_ledger[].source_id string !
$.hold_ledger[].title string ~
$.hold_ledger[].row_digest string !#
$.hold_ledger[].review_note string ~
$.projection_roundtrip object !
$.projection_roundtrip.notion object !
$.projection_roundtrip.notion.candidate_id_map array !
$.conservation object !
$.conservation.input_growth_draft_rows integer !
$.conservation.input_reviewed_rows integer !
$.conservation.input_rows integer !
$.conservation.accepted_rows integer !
$.conservation.rejected_rows integer !
$.conservation.hold_rows integer !
$.conservation.source_occurrence_count integer !
$.conservation.source_span_count integer !
"""
#: Keys of cold graphs and their writers, at any depth and in any case.
FORBIDDEN = [
    "canonical_action_receipt", "canonical_receipt", "cold_root", "cold_roots", "cold_tree", "cluster", "clusters", "home_write", "home_writes", "owner_receipt", "private_authority",
    "relation_edge", "relation_edges", "relation_root", "relation_roots", "snapshot", "snapshots", "vine", "vines", "vine_edge", "vine_edges",
]
#: Counts, and the lists that they count.
COUNTS = {
    "$.manifest.candidate_count": "$.warm_cards", "$.manifest.source_span_count": "$.source_spans", "$.source_manifest.source_count": "$.source_occurrences",
    "$.source_manifest.source_occurrence_count": "$.source_occurrences", "$.source_manifest.source_span_count": "$.source_spans", "$.conservation.accepted_rows": "$.warm_cards",
    "$.conservation.rejected_rows": "$.rejected_ledger", "$.conservation.hold_rows": "$.hold_ledger", "$.conservation.source_occurrence_count": "$.source_occurrences", "$.conservation.source_span_count": "$.source_spans",
}
IDS = {"$.source_occurrences[]": "source_occurrence_id", "$.source_spans[]": "source_span_id", "$.warm_cards[]": "candidate_id", "$.rejected_ledger[]": "ledger_id", "$.hold_ledger[]": "ledger_id"}
UNIT, MOST_CHARS, DIGEST = "utf16_code_units", 512, "^sha256:[a-f0-9]{64}$"


def contract_table(rows: DataFrame, schema: str) -> DataFrame:
    """(shape, wanted, needed, blank_ok, filled, texts, digest, equal, known): the contract, one row for each shape; about a hundred."""
    lines = [x.split() for x in CONTRACT.strip().split("\n")]
    children: dict[str, list[str]] = {}
    for shape, *_ in lines:
        if "." in shape:
            children.setdefault(shape.rpartition(".")[0], []).append(shape.rpartition(".")[2])
    flags = {shape: "".join(rest[1:]) for shape, *rest in lines}
    needed = {s: [k for k in ks if "!" in flags[f"{s}.{k}"]] for s, ks in children.items()}
    table = []
    for shape, kind, *_ in lines:
        f = flags[shape]
        equal = f.partition("=")[2] or (schema if shape == "$.schema" else UNIT if shape.endswith(".unit") else None)
        table.append((shape, kind, children.get(shape), needed.get(shape), "~" in f, "+" in f, "*" in f, "#" in f, equal))
    return rows.sparkSession.createDataFrame(table, "shape string, wanted string, known array<string>, needed array<string>, blank_ok boolean, filled boolean, texts boolean, digest boolean, equal string")


def forbidden_keys(nodes: DataFrame, id_: str, keys: list[str] | None = None) -> DataFrame:
    """(id, path, key) of each forbidden key of a walk, at any depth."""
    return nodes.where(F.lower("key").isin(FORBIDDEN if keys is None else keys)).select(id_, "path", "key")


def privacy_hits(nodes: DataFrame, id_: str) -> DataFrame:
    """(id, path, reason) of each text that must not leave; a value under ``source_file`` may be a path."""
    from .signals import privacy_hit

    exempt = F.coalesce(F.col("path").rlike(r"\.source_file($|[.\[])"), F.lit(False))
    return nodes.where((F.col("kind") == "string") & ~exempt).select(id_, "path", privacy_hit("text").alias("reason")).where("reason IS NOT NULL")


def field(name: str) -> Column:
    """A field of a walked object as a text; null if it is away, null or no scalar."""
    return F.try_variant_get("value", f"$.{name}", "string")


def _rule(rows: DataFrame, id_: str, path: Column | str, rule: str, broken: Column) -> DataFrame:
    return rows.where(F.coalesce(broken, F.lit(False))).select(id_, (F.col(path) if isinstance(path, str) else path).alias("path"), F.lit(rule).alias("rule"))


def _rules(rows: DataFrame, id_: str, rules: list[tuple[Column, str, Column]]) -> DataFrame:
    """What ``_rule`` gives for each (path, rule, broken), in one pass over the rows."""
    each = F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.struct(path.alias("path"), F.lit(rule).alias("rule"))) for path, rule, broken in rules))
    return rows.select(id_, F.inline(F.array_compact(each)))


def _under(name: str) -> Column:
    return F.concat("path", F.lit(f".{name}"))


def shape_violations(nodes: DataFrame, id_: str, schema: str) -> DataFrame:
    """Unknown and missing fields, wrong kinds, blanks, empty lists, fixed values, broken texts of lists and digests."""
    known = F.broadcast(contract_table(nodes, schema))  # about a hundred rows, fixed
    met = nodes.join(known, "shape")
    value = F.try_variant_get("value", "$", "double")
    right = (
        F.when(F.col("wanted") == "any", True).when(F.col("wanted") == "integer", (F.col("kind") == "number") & (value >= 0) & (value == F.floor(value))).otherwise(F.col("kind") == F.col("wanted"))
    )
    blank = (F.col("wanted") == "string") & (F.col("kind") == "string") & (safe_text("text") == "")
    here = F.col("path")
    listed = lambda mine, rule: F.transform(mine, lambda k: F.struct(F.concat(here, F.lit("."), k).alias("path"), F.lit(rule).alias("rule")))
    items = nodes.where("shape LIKE '%[]'").withColumn("list", F.expr("left(shape, length(shape) - 2)")).join(known.where("texts").select(F.col("shape").alias("list")), "list")
    said = items.withColumn("said", safe_text("text"))
    first = said.where("kind = 'string' AND said <> ''").groupBy(id_, "parent", "said").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = said.join(first, [id_, "parent", "said"]).where("place > first").select(id_, "path", F.lit("not_unique").alias("rule"))
    none = F.array().cast("array<struct<path:string,rule:string>>")
    own = F.coalesce(F.when((F.col("kind") == "object") & F.col("known").isNotNull(), F.concat(F.coalesce(listed(F.array_except("keys", "known"), "unknown_field"), none), F.coalesce(listed(F.array_except("needed", "keys"), "required"), none))), none)
    plain = [
        (here, "wrong_kind", ~right), (here, "blank", blank & ~F.col("blank_ok")), (here, "empty", F.col("filled") & (F.col("kind") == "array") & (F.col("size") == 0)),
        (here, "must_be", (F.col("wanted") != "boolean") & (F.col("text") != F.col("equal"))), (here, "must_be", (F.col("kind") == "boolean") & (F.col("text") != F.col("equal"))),
        (here, "bad_digest", F.col("digest") & ((F.col("kind") != "string") | ~F.col("text").rlike(DIGEST))), (here, "not_object", (here == "$") & (F.col("kind") != "object")),
        (here, "must_be_empty", (F.col("shape") == "$.projection_roundtrip.notion.candidate_id_map") & (F.col("kind") == "array") & (F.col("size") > 0)),
    ]
    listed_ = [
        (here, "wrong_kind", F.col("kind") != "string"), (here, "blank", (F.col("kind") == "string") & (F.col("said") == "")), (here, "too_long", utf16_length("said") > MOST_CHARS)
    ]
    return _rules(met, id_, plain).unionByName(met.select(id_, F.inline(own))).unionByName(_rules(said, id_, listed_)).unionByName(again)


def source_violations(nodes: DataFrame, id_: str) -> DataFrame:
    """Occurrences: a file needs its digest and no folder, one of file and window must be there, the digest must match. Spans: digest of the
    excerpt, and bounds from 0 to its UTF-16 length. Ledgers: state and deterministic id."""
    rows = lambda *shapes: nodes.where(F.col("shape").isin(*shapes) & (F.col("kind") == "object"))
    has = lambda name: safe_text(field(name)) != ""
    sealed = digest(edited(F.col("value"), {("digest",): None}))
    path_like = field("source_file").contains("/") | field("source_file").contains("\\") | field("source_file").rlike(r"^[A-Za-z]:[\\/]")
    bound = lambda name: F.try_variant_get("value", f"$.bounds.{name}", "double")
    in_bounds = F.try_variant_get("value", "$.bounds", "map<string,variant>").isNotNull()
    seen = [
        (_under("source_file_digest"), "file_digest_missing", has("source_file") & ~has("source_file_digest")), (_under("source_file_digest"), "bad_digest", has("source_file_digest") & ~field("source_file_digest").rlike(DIGEST)),
        (_under("source_file"), "private_path", has("source_file") & path_like), (_under("source_file"), "no_source", ~has("source_file") & ~has("source_window")), (_under("digest"), "digest_mismatch", has("digest") & (field("digest") != sealed)),
    ]
    spans = [
        (_under("excerpt_digest"), "digest_mismatch", has("excerpt_text") & has("excerpt_digest") & (field("excerpt_digest") != digest(field("excerpt_text")))),
        (_under("bounds"), "bad_range", in_bounds & F.coalesce((bound("start") < 0) | (bound("end") < bound("start")), F.lit(True))), (_under("bounds.start"), "must_be", in_bounds & F.coalesce(bound("start") != 0, F.lit(True))),
        (_under("bounds.end"), "length_mismatch", in_bounds & has("excerpt_text") & F.coalesce(bound("end") != utf16_length(field("excerpt_text")), F.lit(True))),
    ]
    ledgers = []
    for shape, state, prefix, names in (("$.hold_ledger[]", "hold", "hold_", ("reason", "source_id", "source_kind", "title")), ("$.rejected_ledger[]", "rejected", "reject_", ("reason", "source_id", "source_kind"))):
        spelled, own = {"source_id": "sourceId", "source_kind": "sourceKind"}, F.col("shape") == shape
        text = F.concat(F.lit("{"), *(p for k, n in enumerate(names) for p in (F.lit(f'{"," if k else ""}"{spelled.get(n, n)}":'), json_text(safe_text(field(n))))), F.lit("}"))
        ledgers += [
            (_under("state"), "must_be", own & (safe_text(field("state")) != state)), (_under("ledger_id"), "id_mismatch", own & has("ledger_id") & (field("ledger_id") != F.concat(F.lit(prefix), F.left(F.sha2(text, 256), F.lit(16))))),
        ]
    out = _rules(rows("$.source_occurrences[]"), id_, seen)
    return out.unionByName(_rules(rows("$.source_spans[]"), id_, spans)).unionByName(_rules(rows("$.hold_ledger[]", "$.rejected_ledger[]"), id_, ledgers))


def reference_violations(nodes: DataFrame, id_: str) -> DataFrame:
    """Ids that come twice; spans without occurrence; cards whose spans or occurrences are not there, or do not prove each other."""
    name = F.create_map(*(F.lit(x) for kv in IDS.items() for x in kv))[F.col("shape")]
    own = F.coalesce(*(F.when(F.col("shape") == shape, safe_text(field(n))) for shape, n in IDS.items()))
    objects = lambda shape: nodes.where((F.col("shape") == shape) & (F.col("kind") == "object"))
    known = kept(nodes.where(F.col("shape").isin(*IDS) & (F.col("kind") == "object")).select(id_, "shape", "path", "place", own.alias("own"), name.alias("name"), F.when(F.col("shape") == "$.source_spans[]", safe_text(field("source_occurrence_id"))).alias("occurrence")))
    rows = known.where("own <> ''")
    first = rows.groupBy(id_, "shape", "own").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    out = rows.join(first, [id_, "shape", "own"]).where("place > first").select(id_, F.concat("path", F.lit("."), "name").alias("path"), F.lit("not_unique").alias("rule"))
    occurrences = rows.where("shape = '$.source_occurrences[]'").select(id_, F.col("own").alias("occurrence")).distinct()
    spans = known.where("shape = '$.source_spans[]'").select(id_, "path", "place", F.col("own").alias("span"), "occurrence")
    lost = spans.where("occurrence <> ''").join(occurrences, [id_, "occurrence"], "left_anti").select(id_, F.concat("path", F.lit(".source_occurrence_id")).alias("path"), F.lit("no_occurrence").alias("rule"))
    proof = spans.where("span <> ''").groupBy(id_, "span").agg(F.max_by("occurrence", "place").alias("occurrence"))
    cited = lambda name: nodes.where(F.col("shape") == f"$.warm_cards[].source_refs.{name}[]").select(id_, "path", "parent", F.regexp_extract("path", r"^(\$\.warm_cards\[\d+\])", 1).alias("card"), safe_text("text").alias("ref"))
    said_spans, said_occurrences = cited("source_span_ids"), cited("source_occurrence_ids").where("ref <> ''")
    unknown = said_occurrences.join(occurrences.withColumnRenamed("occurrence", "ref"), [id_, "ref"], "left_anti").select(id_, "path", F.lit("no_occurrence").alias("rule"))
    joined = said_spans.join(proof.withColumnRenamed("span", "ref"), [id_, "ref"], "left")
    away = joined.where("occurrence IS NULL").select(id_, "path", F.lit("no_span").alias("rule"))
    proven = joined.where("occurrence <> ''").select(id_, "card", "path", "occurrence")
    own = said_occurrences.select(id_, "card", F.col("ref").alias("occurrence")).distinct()
    some = own.select(id_, "card").distinct()
    stray = proven.join(some, [id_, "card"], "left_semi").join(own, [id_, "card", "occurrence"], "left_anti").select(id_, "path", F.lit("foreign_span").alias("rule"))
    both = proven.select(id_, "card", "occurrence").distinct().withColumn("p", F.lit(1)).join(own.withColumn("o", F.lit(1)), [id_, "card", "occurrence"], "full")
    uneven = both.where("p IS NULL OR o IS NULL").select(id_, F.concat("card", F.lit(".source_refs.source_occurrence_ids")).alias("path"), F.lit("not_proven").alias("rule")).distinct()
    cards = objects("$.warm_cards[]")
    n = F.coalesce(F.size(F.try_variant_get("value", "$.source_refs.source_span_ids", "array<variant>")), F.lit(0))
    counted = _rule(cards, id_, _under("quality.source_span_count"), "count_mismatch", ~F.coalesce(F.try_variant_get("value", "$.quality.source_span_count", "double") == n, F.lit(False)))
    for more in (lost, unknown, away, stray, uneven, counted):
        out = out.unionByName(more)
    return out


def whole_violations(nodes: DataFrame, id_: str) -> DataFrame:
    """Counts of lists, sums of rows, and the digests of sources and of the whole bundle."""
    top = nodes.where("path = '$' AND kind = 'object'")
    number = lambda path: F.try_variant_get("value", path, "double")
    good = lambda path: F.when((number(path) >= 0) & (number(path) == F.floor(number(path))) & (F.schema_of_variant(F.try_variant_get("value", path, "variant")) != "STRING"), number(path))
    size = lambda path: F.coalesce(F.size(F.try_variant_get("value", path, "array<variant>")), F.lit(0))
    total = lambda *names: sum((good(f"$.conservation.{n}") for n in names[1:]), good(f"$.conservation.{names[0]}"))
    inputs = good("$.conservation.input_rows")
    listed = lambda path: F.coalesce(F.to_json(F.try_variant_get("value", path, "array<variant>")), F.lit("[]"))
    sources = digest(F.concat(F.lit('{"source_occurrences":'), listed("$.source_occurrences"), F.lit(',"source_spans":'), listed("$.source_spans"), F.lit("}")))
    told = lambda path: safe_text(F.try_variant_get("value", path, "string"))
    found = [(F.lit(path), "count_mismatch", good(path) != size(list_)) for path, list_ in COUNTS.items()]
    found += [
        (F.lit("$.conservation.input_rows"), "sum_mismatch", (inputs != total("input_growth_draft_rows", "input_reviewed_rows")) | (inputs != total("accepted_rows", "rejected_rows", "hold_rows"))),
        (F.lit("$.source_manifest.source_digest"), "digest_mismatch", (told("$.source_manifest.source_digest") != "") & (F.try_variant_get("value", "$.source_manifest.source_digest", "string") != sources)),
        (F.lit("$.manifest.manifest_digest"), "digest_mismatch", (told("$.manifest.manifest_digest") != "") & (F.try_variant_get("value", "$.manifest.manifest_digest", "string") != manifest_digest(F.col("value")))),
    ]
    return _rules(top, id_, found)


def manifest_digest(v: Column) -> Column:
    """The digest that a bundle's manifest must have: of the whole bundle with that field empty."""
    return digest(edited(v, {("manifest", "manifest_digest"): F.lit('""')}))


def contract_violations(bundles: DataFrame, id_: str, json: str, schema: str = "bundle_v0", forbidden: list[str] | None = None) -> DataFrame:
    """(id, path, rule) once for each broken rule; a text that is no JSON object breaks ``not_object`` at ``$``."""
    bundles = kept(spread(bundles.select(id_, json), id_))
    return _violations(bundles, kept(walk(bundles, id_, json)), id_, json, schema, forbidden)


def _violations(bundles: DataFrame, nodes: DataFrame, id_: str, json: str, schema: str, forbidden: list[str] | None) -> DataFrame:
    """``contract_violations`` of bundles and their walk, both held."""
    lost = bundles.where(F.try_parse_json(json).isNull()).select(id_, F.lit("$").alias("path"), F.lit("not_object").alias("rule"))
    keys = forbidden_keys(nodes, id_, forbidden).select(id_, "path", F.lit("forbidden_key").alias("rule"))
    parts = [lost, keys, shape_violations(nodes, id_, schema), source_violations(nodes, id_), reference_violations(nodes, id_), whole_violations(nodes, id_)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def read_normalised(bundles: DataFrame, id_: str, json: str, old_field: str, schema: str = "bundle_v0", forbidden: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Older bundles as they are read: (id, mode, ok, json, stripped, digest_before, digest_now), and the violations that remain.

    A sound bundle is ``current_contract``. One that breaks rules and has no ``old_field`` in its cards is ``strict_rejected``. One whose only
    faults are those fields loses them, if each is a sound import policy, gets a new manifest digest and is validated again
    (``legacy_read_only``); any other fault makes it ``legacy_rejected``, and its text stays.
    """
    bundles = kept(spread(bundles.select(id_, json), id_))
    nodes = kept(walk(bundles, id_, json))
    before = kept(_violations(bundles, nodes, id_, json, schema, forbidden))
    held = nodes.where(F.col("shape") == f"$.warm_cards[].{old_field}").select(id_, "path", "kind", "value", "keys")
    allowed = F.array(*map(F.lit, ("direct_write_allowed", "state", "reason")))
    typed = lambda name, kind: F.schema_of_variant(F.try_variant_get("value", f"$.{name}", "variant")) == kind
    sound = (
        (F.col("kind") == "object") & (F.size(F.array_except("keys", allowed)) == 0) & (F.size(F.array_except(allowed, F.col("keys"))) == 0) & typed("direct_write_allowed", "BOOLEAN")
        & (field("direct_write_allowed") == "false") & typed("state", "STRING") & typed("reason", "STRING") & (safe_text(field("state")) != "") & (safe_text(field("reason")) != "")
    )
    fields = held.groupBy(id_).agg(F.count("*").alias("stripped"), F.min(F.coalesce(sound, F.lit(False))).alias("sound"))
    others = before.join(held.select(id_, "path"), [id_, "path"], "left_anti")
    # the seal of a bundle with an old field is one of its own contents, so its digest is no other fault unless it does not match
    state = bundles.select(id_, json).join(fields, id_, "left").join(before.select(id_).distinct().withColumn("broken", F.lit(True)), id_, "left").join(others.select(id_).distinct().withColumn("other", F.lit(True)), id_, "left")
    mode = (
        F.when(F.col("broken").isNull(), "current_contract").when(F.col("stripped").isNull(), "strict_rejected").when(F.col("other") | ~F.col("sound"), "legacy_rejected").otherwise("legacy_read_only")
    )
    v = F.try_parse_json(json)
    bare = edited(v, {("warm_cards", "[]", old_field): None, ("manifest", "manifest_digest"): F.lit('""')})
    now = digest(bare)
    resealed = edited(F.try_parse_json(bare), {("manifest", "manifest_digest"): json_text(now)})
    told = kept(state.withColumn("mode", mode)).select(
        id_, "mode", F.when(F.col("mode") == "legacy_read_only", resealed).otherwise(F.col(json)).alias("json"), F.coalesce("stripped", F.lit(0)).cast("long").alias("stripped"),
        F.try_variant_get(v, "$.manifest.manifest_digest", "string").alias("digest_before"), F.when(F.col("mode") == "legacy_read_only", now).alias("digest_now"),
    )
    old = told.where("mode = 'legacy_read_only'")
    after = before.join(told.where("mode <> 'legacy_read_only'").select(id_), id_, "left_semi")
    if not old.isEmpty():
        after = after.unionByName(contract_violations(old, id_, "json", schema, forbidden))
    bad = after.select(id_).distinct().withColumn("bad", F.lit(True))
    out = told.join(bad, id_, "left").withColumn("ok", F.col("bad").isNull()).select(id_, "mode", "ok", "json", "stripped", "digest_before", "digest_now")
    return out, after


def canonical_bundle(c: Column) -> Column:
    """A bundle with its manifest sealed anew."""
    v = F.try_parse_json(canonical(c))
    return edited(v, {("manifest", "manifest_digest"): json_text(manifest_digest(v))})


def assembled(rows: DataFrame, id_: str, schema: str = "bundle_v0") -> DataFrame:
    """(id, json): a sealed bundle of each id, from rows (id, place, state, reason, title, speaker, excerpt, source_file, window).

    An accepted row is a card with its span and occurrence, any other a row of its ledger; counts, digests and ids follow from them.
    """
    ref = F.concat_ws(":", F.col(id_).cast("string"), F.col("place").cast("string"))
    of = lambda prefix: F.concat(F.lit(prefix), F.left(F.sha2(ref, 256), F.lit(16)))
    occurrence_id, span_id, turn = of("occ_"), of("span_"), F.concat(F.col("place").cast("string"), F.lit("-"), F.col("place").cast("string"))
    messages = F.array(F.concat(F.lit("m"), F.col("place").cast("string")))
    occurrence = {
        "source_occurrence_id": occurrence_id, "source_id": ref, "source_kind": F.lit("message"), "source_file": F.col("source_file"), "source_window": F.col("window"), "turn_range": turn, "message_ids": messages,
        "source_file_digest": F.when(F.col("source_file") != "", digest(F.col("source_file"))).otherwise(""), "source_time": F.lit(""),
    }
    as_json = lambda d: F.to_json(F.struct(*(d[k].alias(k) for k in sorted(d))))
    occurrence["digest"] = digest(canonical(as_json(occurrence)))
    span = {
        "source_span_id": span_id, "source_occurrence_id": occurrence_id, "turn_range": turn, "message_ids": messages, "speaker": F.col("speaker"), "excerpt_text": F.col("excerpt"), "excerpt_digest": digest(F.col("excerpt")),
        "bounds": F.struct(utf16_length("excerpt").alias("end"), F.lit(0).alias("start"), F.lit(UNIT).alias("unit")),
    }
    card = {
        "candidate_id": of("cand_"), "title": F.col("title"), "archive_bucket": F.lit("warm"), "frontend_delivery_tier": F.lit("default"),
        "portable_warm_card": F.struct(F.col("excerpt").alias("body_markdown"), F.col("title").alias("living_fragment")),
        "source_refs": F.struct(F.array(occurrence_id).alias("source_occurrence_ids"), F.array(span_id).alias("source_span_ids")),
        "privacy": F.struct(F.lit(True).alias("local_only"), F.lit(True).alias("projection_requires_user_action")),
        "quality": F.struct(F.lit(True).alias("source_bound"), F.lit(True).alias("source_complete"), F.lit(False).alias("source_incomplete"), F.lit(1).alias("source_span_count")),
        "home_import_policy": F.struct(F.lit(False).alias("direct_write_allowed"), F.lit("review").alias("reason"), F.lit("pending").alias("state")),
    }
    held = F.col("state") == "hold"
    identity = F.concat(F.lit('{"reason":'), json_text(safe_text("reason")), F.lit(',"sourceId":'), json_text(ref), F.lit(',"sourceKind":"message"'), F.when(held, F.concat(F.lit(',"title":'), json_text(safe_text("title")))).otherwise(""), F.lit("}"))
    ledger = {
        "ledger_id": F.concat(F.when(held, "hold_").otherwise("reject_"), F.left(F.sha2(identity, 256), F.lit(16))), "state": F.col("state"), "reason": F.col("reason"), "source_kind": F.lit("message"), "source_id": ref,
        "title": F.col("title"), "row_digest": digest(F.concat_ws("|", ref, "reason", "title")),
    }
    made = spread(rows, id_).select(id_, "place", "state", *(canonical(as_json(d)).alias(n) for n, d in (("occurrence", occurrence), ("span", span), ("card", card), ("ledger", ledger))))
    listed = made.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("place", "state", "occurrence", "span", "card", "ledger"))).alias("r"))
    part = lambda state, name: F.transform(F.filter("r", lambda x: x["state"] == state), lambda x: x[name])
    text = lambda state, name: F.concat(F.lit("["), F.array_join(part(state, name), ","), F.lit("]"))
    n = lambda state: F.size(part(state, "card"))
    counts = F.to_json(F.struct(n("accepted").alias("accepted_rows"), n("hold").alias("hold_rows"), F.size("r").alias("input_growth_draft_rows"), F.lit(0).alias("input_reviewed_rows"), F.size("r").alias("input_rows"),
        n("rejected").alias("rejected_rows"), n("accepted").alias("source_occurrence_count"), n("accepted").alias("source_span_count")))
    sources = digest(F.concat(F.lit('{"source_occurrences":'), text("accepted", "occurrence"), F.lit(',"source_spans":'), text("accepted", "span"), F.lit("}")))
    manifest = F.to_json(F.struct(F.concat(F.lit("bundle_"), F.col(id_).cast("string")).alias("bundle_id"), n("accepted").alias("candidate_count"), F.lit("2025-01-01T00:00:00Z").alias("created_at"), F.lit("assembled").alias("generator"),
        F.lit("").alias("manifest_digest"), F.struct(F.lit("").alias("bot_id"), F.lit("").alias("owner_id"), F.lit("").alias("realm_id")).alias("scope"), n("accepted").alias("source_span_count")))
    manifest_ = F.to_json(F.struct(n("accepted").alias("source_count"), sources.alias("source_digest"), n("accepted").alias("source_occurrence_count"), n("accepted").alias("source_span_count")))
    pieces = {
        "conservation": counts, "hold_ledger": text("hold", "ledger"), "manifest": manifest, "persona_authority": F.lit('{"authority":"","language_fingerprint_digest":"","persona_digest":""}'),
        "projection_roundtrip": F.lit('{"notion":{"candidate_id_map":[]}}'), "rejected_ledger": text("rejected", "ledger"), "schema": json_text(F.lit(schema)), "source_manifest": manifest_,
        "source_occurrences": text("accepted", "occurrence"), "source_spans": text("accepted", "span"), "warm_cards": text("accepted", "card"),
    }
    json = F.concat(F.lit("{"), *(x for i, (k, v) in enumerate(pieces.items()) for x in (F.lit(f'{"," if i else ""}"{k}":'), v)), F.lit("}"))
    return listed.select(id_, json.alias("json")).select(id_, canonical_bundle(F.col("json")).alias("json"))
