"""Greedy packing of lines into slices and of slices into batches, as ordered folds inside a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import WHITE, safe_text


def fold_groups(costs: Column, most: int, most_items: int | None = None) -> Column:
    """Group number of each cost, greedily: a new group starts when the next would exceed ``most`` or ``most_items``.

    A single cost over ``most`` makes a group of its own. The fold keeps the sizes of closed groups only, a list that is copied once a group and
    not once a cost; numbers are laid out at the end.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("int").alias("items"), F.array().cast("array<int>").alias("closed"))

    def step(acc: Column, cost: Column) -> Column:
        over = acc["used"] + cost > most
        if most_items is not None:
            over = over | (acc["items"] >= most_items)
        new = (acc["items"] > 0) & over
        return F.struct(
            F.when(new, cost).otherwise(acc["used"] + cost).alias("used"), F.when(new, F.lit(1)).otherwise(acc["items"] + 1).alias("items"),
            F.when(new, F.concat(acc["closed"], F.array(acc["items"]))).otherwise(acc["closed"]).alias("closed"),
        )

    laid = lambda acc: F.flatten(F.transform(F.concat(acc["closed"], F.array(acc["items"])), lambda n, g: F.array_repeat(g.cast("long"), n)))
    return F.aggregate(F.transform(costs, lambda x: x.cast("long")), start, step, laid)


def slices(docs: DataFrame, key: str, target: int, paragraphs: bool = False) -> DataFrame:
    """Lines, or trimmed paragraphs, of each text packed to ``target`` characters: slice_no, n_lines, char_count, start_char.

    A line costs its length and one, a paragraph its length and two, as many as join it to the next. Blank ones go. Offsets are sums of the lengths of the
    slices before, as separators between slices are not counted.
    """
    lines = F.filter(F.split("text", "\n"), lambda x: safe_text(x) != "")
    paras = F.filter(F.transform(F.split("text", rf"\n[{WHITE}]*\n"), safe_text), lambda x: x != "")
    join = 2 if paragraphs else 1
    cut = docs.select(key, (paras if paragraphs else lines).alias("lines")).where(F.size("lines") > 0)
    cut = cut.withColumn("groups", fold_groups(F.transform("lines", lambda x: F.length(x) + join), target))
    per = cut.select(key, F.explode(F.arrays_zip("groups", "lines")).alias("l")).groupBy(key, F.col("l.groups").alias("g")).agg(
        F.count("*").alias("n_lines"), (F.sum(F.length("l.lines") + join) - join).alias("char_count")
    )
    before = F.sum("char_count").over(Window.partitionBy(key).orderBy("g").rowsBetween(Window.unboundedPreceding, -1))
    return per.select(key, (F.col("g") + 1).alias("slice_no"), "n_lines", "char_count", F.coalesce(before, F.lit(0)).alias("start_char"))


def batches(cut: DataFrame, key: str, most_slices: int, most_chars: int) -> DataFrame:
    """Slices of each key in batches of at most ``most_slices`` and ``most_chars`` (a first slice always fits)."""
    per = cut.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("slice_no", "char_count"))).alias("s"))
    per = per.withColumn("b", fold_groups(F.col("s.char_count"), most_chars, most_slices))
    return per.select(key, F.explode(F.arrays_zip("b", "s")).alias("x")).groupBy(key, (F.col("x.b") + 1).alias("batch_no")).agg(
        F.count("*").alias("n_slices"), F.sum("x.s.char_count").alias("batch_chars"), F.min("x.s.slice_no").alias("first_slice")
    )
