"""Nested JSON as VARIANT: canonical texts, edited texts, and a walk that gives a row for every value at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OBJECT, ARRAY = "map<string,variant>", "array<variant>"


def canonical(c: Column) -> Column:
    """JSON without blanks and with sorted keys at every depth; null for what is no JSON. Numbers keep their own spelling."""
    return F.to_json(F.try_parse_json(c))


def json_text(c: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def edited(v: Column, edits: dict[tuple[str, ...], Column | None]) -> Column:
    """Canonical JSON of a VARIANT with some values replaced (by JSON texts) or, for None, left out.

    A path is keys, with ``[]`` for every element of an array; what is not there stays away.
    """
    if () in edits:
        return edits[()]
    if not edits:
        return F.to_json(v)
    under: dict[str, dict] = {}
    for path, new in edits.items():
        under.setdefault(path[0], {})[path[1:]] = new
    whole = F.to_json(v)
    if "[]" in under:
        parts = F.transform(F.try_variant_get(v, "$", ARRAY), lambda x: edited(x, under["[]"]))
        return F.coalesce(F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")), whole)
    gone = [k for k, sub in under.items() if sub.get((), 0) is None]

    def entry(e: Column) -> Column:
        value = F.to_json(e["value"])
        for k, sub in under.items():
            if k not in gone:
                value = F.when(e["key"] == k, edited(e["value"], sub)).otherwise(value)
        return F.concat(json_text(e["key"]), F.lit(":"), value)

    rows = F.filter(F.map_entries(F.try_variant_get(v, "$", OBJECT)), lambda e: ~e["key"].isin(gone) if gone else F.lit(True))  # of a map whose keys are in order
    return F.coalesce(F.concat(F.lit("{"), F.array_join(F.transform(rows, entry), ","), F.lit("}")), whole)


def nesting(c: Column) -> Column:
    """How deep brackets of a JSON text are nested."""
    return _depth(brackets(c))


def brackets(c: Column) -> Column:
    """The brackets of a JSON text, without what is inside strings."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'"(?:[^"\\]++|\\.)*+"', ""), r"[^\[\]{}]+", "")


def _depth(bare: Column) -> Column:
    step = lambda s, x: F.struct((s["now"] + F.when(x.isin("[", "{"), 1).when(x.isin("]", "}"), -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(x.isin("[", "{"), 1).otherwise(0)).alias("most"))
    return F.aggregate(F.split(bare, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"]


def walk(rows: DataFrame, id_: str, json: str) -> DataFrame:
    """(id, path, parent, shape, key, place, kind, text, size, keys, value): a row for every value in the JSON of a row, the whole one first.

    ``path`` is like ``$.a[0].b``, ``shape`` the same without indexes (``$.a[].b``); ``text`` is a scalar's text; ``size`` counts
    elements or keys; ``value`` is the VARIANT. JSON that cannot be read gives no rows. The deepest nesting is measured first (one
    number, of each different row of brackets); levels then unfold inside each row, so nothing else is shuffled.
    """
    shapes = rows.where(F.try_parse_json(json).isNotNull()).select(brackets(F.col(json)).alias("bare")).distinct()
    deepest = shapes.agg(F.max(_depth(F.col("bare")))).first()[0] or 0

    def node(path, parent, shape, key, place, value) -> Column:
        return F.struct(path.alias("path"), parent.alias("parent"), shape.alias("shape"), key.alias("key"), place.alias("place"), value.alias("value"))

    none, no_place = F.lit(None).cast("string"), F.lit(None).cast("int")

    def below(n: Column) -> Column:
        named = F.transform(F.map_entries(F.try_variant_get(n["value"], "$", OBJECT)), lambda e: node(F.concat(n["path"], F.lit("."), e["key"]), n["path"], F.concat(n["shape"], F.lit("."), e["key"]), e["key"], no_place, e["value"]))
        listed = F.transform(F.try_variant_get(n["value"], "$", ARRAY), lambda x, i: node(F.concat(n["path"], F.lit("["), i.cast("string"), F.lit("]")), n["path"], F.concat(n["shape"], F.lit("[]")), none, i, x))
        return F.coalesce(named, listed, F.array().cast("array<struct<path:string,parent:string,shape:string,key:string,place:int,value:variant>>"))

    out = rows.select(id_, F.try_parse_json(json).alias("v_")).where("v_ IS NOT NULL")
    out = out.select(id_, F.array(node(F.lit("$"), none, F.lit("$"), none, no_place, F.col("v_"))).alias("l0"))
    for k in range(deepest):
        out = out.withColumn(f"l{k + 1}", F.flatten(F.transform(f"l{k}", below)))
    nodes = out.select(id_, F.inline(F.concat(*(f"l{k}" for k in range(deepest + 1)))))
    keys, items = F.map_keys(F.try_variant_get("value", "$", OBJECT)), F.try_variant_get("value", "$", ARRAY)
    scalar = F.schema_of_variant("value")
    kind = (
        F.when(F.col("keys").isNotNull(), "object").when(F.col("items_").isNotNull(), "array").when(F.is_variant_null("value"), "null").when(scalar == "STRING", "string")
        .when(scalar == "BOOLEAN", "boolean").otherwise("number")
    )
    nodes = nodes.withColumn("keys", keys).withColumn("items_", items)
    return nodes.select(
        id_, "path", "parent", "shape", "key", "place", kind.alias("kind"), F.when(F.col("keys").isNull() & F.col("items_").isNull(), F.try_variant_get("value", "$", "string")).alias("text"),
        F.coalesce(F.size("keys"), F.size("items_")).alias("size"), "keys", "value",
    )
