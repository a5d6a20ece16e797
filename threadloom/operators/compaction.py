"""Greedy compaction of notes: a note joins the best open cluster of its own shape, in order of time and title.

A note may only join a cluster that holds a note alike it, so pairs that are alike are found first, by a join on shared slices that is confirmed on
slices and grams; they make components, and the fold, which depends on order, runs in each component on its own, along its pairs only. Notes that are alike
no other never reach it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import dice
from threadloom.sources.shared import held

from .relations import pairs_of

#: Cluster sizes by shape; others take two.
LIMITS = {"scene_event": 3}


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of the edges (a, b) can reach. Labels go to neighbours and then to their labels' labels, until none changes."""
    both = held(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = held(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("now"))
        over = labels.select(F.col("id").alias("now"), F.col("component").alias("next"))
        labels = held(least.join(over, "now").select("id", F.least("now", "next").alias("new"), F.col("component").alias("was")))
        if labels.where("new <> was").isEmpty():
            return labels.select("id", F.col("new").alias("component"))
        labels = labels.select("id", F.col("new").alias("component"))


def alike(notes: DataFrame, least_shared: int, least_dice: float) -> DataFrame:
    """(a, b, shared), both ways, of notes (note, scope, shape, slices, grams) of one scope and shape that share enough slices and are near enough in grams."""
    each = notes.select("scope", "shape", "note", F.explode(F.array_distinct("slices")).alias("slice"))
    shared = pairs_of(each, ["scope", "shape", "slice"], "note").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least_shared)
    side = lambda s: notes.select(F.col("note").alias(s), F.array_distinct("grams").alias(f"g{s}"))
    near = held(shared.join(side("a"), "a").join(side("b"), "b").where((F.size("ga") > 0) & (F.size("gb") > 0) & (dice(F.col("ga"), F.col("gb")) >= least_dice)).select("a", "b", "shared"))
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))


def compacted(notes: DataFrame, least_shared: int = 5, least_dice: float = 0.18) -> DataFrame:
    """(scope, shape, note, cluster) from notes (scope, shape, note, at, title, slices, grams), each with a number of its own: cluster is its first note.

    The best cluster of a note is the one with the most shared slices of a member alike plus 1.2 for each such member; the first of equals.
    """
    notes = held(notes)
    pairs = alike(notes, least_shared, least_dice)
    parts = held(components(pairs))
    told = notes.select(F.col("note").alias("id"), "at", "title", "shape").join(parts, "id")
    links = pairs.join(parts.withColumnRenamed("id", "a"), "a").select(F.col("component").alias("of"), "a", "b", "shared")

    def fold(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(["at", "title", "id"], kind="stable")
        shared: dict[int, list[tuple[int, int]]] = {}
        for a, b, n in zip(near["a"], near["b"], near["shared"], strict=True):
            shared.setdefault(a, []).append((b, n))
        home: dict[int, int] = {}  # note to cluster, numbered as they are opened
        sizes: list[tuple[int, int]] = []  # first note and number of notes
        for note, shape in zip(mine["id"], mine["shape"], strict=True):
            score: dict[int, tuple[int, int]] = {}
            for other, n in shared.get(note, ()):
                if (c := home.get(other)) is not None and sizes[c][1] < LIMITS.get(shape, 2):
                    most, members = score.get(c, (0, 0))
                    score[c] = (max(most, n), members + 1)
            best = min(score, key=lambda c: (-(score[c][0] + 1.2 * score[c][1]), c)) if score else len(sizes)
            if best == len(sizes):
                sizes.append((note, 0))
            sizes[best] = (sizes[best][0], sizes[best][1] + 1)
            home[note] = best
        return pd.DataFrame({"id": mine["id"], "cluster": [sizes[home[n]][0] for n in mine["id"]]})

    folded = told.groupBy("component").cogroup(links.groupBy("of")).applyInPandas(fold, "id long, cluster long")
    out = notes.select("scope", "shape", F.col("note").alias("id")).join(folded, "id", "left")
    return out.select("scope", "shape", F.col("id").alias("note"), F.coalesce("cluster", "id").alias("cluster"))
