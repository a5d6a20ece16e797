"""Routing of drafts, validation as violation rows, and conservation of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.ids import digest
from threadloom.functions.text import utf16_length


def route(drafts: DataFrame) -> DataFrame:
    """State and reason of drafts (identity, decision, n_spans, n_reliable): rejected, hold or accepted."""
    reason = (
        F.when(F.coalesce(F.col("identity"), F.lit("")) == "", "missing_identity")
        .when(F.col("decision").isin("skip", "delete"), "decision_declined")
        .when(F.col("decision") == "hold", "decision_hold")
        .when(F.col("n_reliable") == 0, "no_reliable_span")
        .when(F.col("n_reliable") < F.col("n_spans"), "some_spans_unreliable")
        .otherwise("ok")
    )
    state = F.when(F.col("reason").isin("missing_identity", "decision_declined"), "rejected").when(F.col("reason") == "ok", "accepted").otherwise("hold")
    return drafts.withColumn("reason", reason).withColumn("state", state)


def conservation(routed: DataFrame) -> DataFrame:
    """One row: inputs, the three states, and whether nothing was lost."""
    n = lambda s: F.count_if(F.col("state") == s)
    return routed.agg(
        F.count("*").alias("inputs"), n("accepted").alias("accepted"), n("hold").alias("held"), n("rejected").alias("rejected"),
        (F.count("*") == n("accepted") + n("hold") + n("rejected")).alias("conserved"),
    )


def violations(rows: DataFrame, id_: str, rules: dict[str, Column]) -> DataFrame:
    """(id, rule) for every rule that a row breaks; a rule is true where the row is sound, null counts as broken."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.col(id_), F.explode(broken).alias("rule"))


def span_rules() -> dict[str, Column]:
    """Rules of evidence spans (excerpt, excerpt_digest, start, end): bounds are UTF-16 units."""
    return {
        "excerpt_blank": F.length("excerpt") > 0,
        "digest_mismatch": F.col("excerpt_digest") == digest(F.col("excerpt")),
        "bounds_mismatch": F.col("end") - F.col("start") == utf16_length("excerpt"),
    }


def duplicates(rows: DataFrame, id_: str) -> DataFrame:
    return rows.groupBy(id_).agg(F.count("*").alias("n")).where("n > 1")


def tied(values: list[Column]) -> Column:
    """True if all are equal."""
    return reduce(lambda a, b: a & b, [values[0].eqNullSafe(v) for v in values[1:]], F.lit(True))
