"""Groups of evidence, placement decisions, and the ordered fold of batches into versioned roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import compact, date_literal, first_text, safe_text


def placement(groups: DataFrame) -> DataFrame:
    """Adds action and confidence to groups (trunk boolean, n_batches, n_windows, n_rows, n_facts, good_name boolean)."""
    spread = (F.col("n_batches") >= 2) | (F.col("n_windows") >= 2) & (F.col("n_rows") >= 2)
    kept = F.col("n_facts") > 0
    none = ~F.col("trunk") | ~spread & ~kept
    promoted = F.col("trunk") & spread & kept & F.col("good_name")
    return groups.withColumns({
        "action": F.when(promoted, "promote").when(none, "archive").otherwise("observe"),
        "confidence": F.when(promoted, "high").when(none, "low").otherwise(F.when(spread | kept, "middle").otherwise("low")),
    })


def fold_versions(batches: Column, most_facts: int = 8, most_incoming: int = 6) -> Column:
    """Folds batches (array of struct(at, facts), in order) into a root.

    The first batch seeds the facts; each later one is a version and a branch. A batch without any fact in common is a
    conflict: it is counted but its facts are not merged. Facts stay distinct, in order, up to ``most_facts``.
    """
    first = F.slice(batches[0]["facts"], 1, most_incoming)
    start = F.struct(first.alias("facts"), F.lit(1).alias("versions"), F.lit(0).alias("conflicts"), batches[0]["at"].alias("last_at"))

    def step(acc: Column, b: Column) -> Column:
        new = F.slice(b["facts"], 1, most_incoming)
        clash = (F.size(new) > 0) & (F.size(acc["facts"]) > 0) & ~F.arrays_overlap(new, acc["facts"])
        return F.struct(
            F.when(clash, acc["facts"]).otherwise(F.slice(F.array_union(acc["facts"], new), 1, most_facts)).alias("facts"),
            (acc["versions"] + 1).alias("versions"), (acc["conflicts"] + clash.cast("int")).alias("conflicts"), F.greatest(acc["last_at"], b["at"]).alias("last_at"),
        )

    return F.aggregate(F.slice(batches, 2, F.greatest(F.size(batches) - 1, F.lit(0))), start, step)


def roots(rows: DataFrame) -> DataFrame:
    """(root, at, fact) rows to one versioned root each: batches by ``at``, facts of a batch in order."""
    per = rows.groupBy("root", "at").agg(F.sort_array(F.collect_set("fact")).alias("facts"))
    per = per.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("at", "facts"))).alias("batches"))
    folded = per.select("root", fold_versions(F.col("batches")).alias("r"), F.element_at("batches", 1)["at"].alias("first_at"))
    return folded.select(
        "root", "first_at", F.col("r.last_at").alias("last_at"), F.col("r.versions").alias("version_count"), (F.col("r.versions") - 1).alias("branch_count"),
        (F.col("r.conflicts") > 0).alias("conflict_hint"), F.col("r.facts").alias("facts"),
        F.when(F.col("r.versions") > 1, "updated").when(F.size("r.facts") > 0, "stable").otherwise("volatile").alias("evolution"),
    )


#: Names of types in group keys; how many names a month shows, and how many groups of sources.
TYPE_KEYS = {"人物": "person", "规则": "rule", "事件": "event", "事物": "thing"}
NAMES, SOURCES = 12, 20


def grouped_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups and members of rows (id, kind, title, time, batch): (key, type_key, title, first_seen, last_seen, first_batch, n_rows, n_batches) and (key, id).

    A group is a type and a title in compact form; its title is the first spelling by id. Members stay rows of their own, so a group may have as many as it likes.
    """
    kind = F.lower(safe_text("kind"))
    type_key = F.coalesce(F.create_map(*(F.lit(x) for kv in TYPE_KEYS.items() for x in kv))[kind], kind)
    keyed = rows.select("id", type_key.alias("type_key"), safe_text("title").alias("title"), date_literal("time").alias("day"), "batch").withColumn("key", F.concat_ws("::", "type_key", compact("title")))
    day = F.when(F.col("day") != "", F.col("day"))
    groups = keyed.groupBy("key", "type_key").agg(
        F.min_by("title", "id").alias("title"), F.coalesce(F.min(day), F.lit("")).alias("first_seen"), F.coalesce(F.max(day), F.lit("")).alias("last_seen"), F.min("batch").alias("first_batch"),
        F.count("*").alias("n_rows"), F.count_distinct("batch").alias("n_batches"),
    )
    return groups, keyed.select("key", "id")


def reviewed_months(rows: DataFrame) -> DataFrame:
    """(month_key, rows, persona, sql, case, unknown, evolution, names) of reviewed rows (month_key, layer, evolution_status, name, place), with one row ``total`` for all.

    ``evolution`` counts the states of SQL rows (blank: volatile), ``names`` are their first twelve names. Names are ranked by where they come first, not gathered.
    """
    layers = ("persona", "sql", "case", "unknown")
    layer = F.when(F.lower("layer").isin(*layers), F.lower("layer")).otherwise("unknown")
    r = rows.select("month_key", layer.alias("layer"), first_text("evolution_status", F.lit("volatile")).alias("state"), safe_text("name").alias("name"), "place")
    per = r.rollup("month_key").agg(F.count("*").alias("rows"), *(F.count_if(F.col("layer") == k).alias(k) for k in layers)).withColumn("month_key", F.coalesce("month_key", F.lit("total")))
    states = r.where("layer = 'sql'").groupBy("month_key", "state").agg(F.count("*").alias("n")).groupBy("month_key").agg(F.array_sort(F.collect_list(F.struct("state", "n"))).alias("evolution"))
    first = r.where("layer = 'sql' AND name <> ''").groupBy("month_key", "name").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("month_key").orderBy("place", "name"))
    names = first.withColumn("rank", rank).where(F.col("rank") <= NAMES).groupBy("month_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("names"))
    return per.join(states, "month_key", "left").join(names, "month_key", "left")


def source_groups(rows: DataFrame, most: int = SOURCES) -> DataFrame:
    """(key, persona_rows, sql_rows, total_rows, first_time, last_time, all_rows, all_groups): the largest groups of rows (key, layer, time), equal ones by key, beside the totals."""
    stamp = F.when(safe_text("time") != "", safe_text("time"))
    layer = F.lower(safe_text("layer"))
    per = rows.groupBy("key").agg(F.count_if(layer == "persona").alias("persona_rows"), F.count_if(layer == "sql").alias("sql_rows"), F.count("*").alias("total_rows"), F.coalesce(F.min(stamp), F.lit("")).alias("first_time"), F.coalesce(F.max(stamp), F.lit("")).alias("last_time"))
    totals = per.agg(F.sum("total_rows").alias("all_rows"), F.count("*").alias("all_groups"))
    return per.orderBy(F.desc("total_rows"), "key").limit(most).withColumn("one_", F.lit(1)).join(F.broadcast(totals.withColumn("one_", F.lit(1))), "one_").drop("one_")  # one row
