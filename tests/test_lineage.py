"""Lineage and geometry by hand: one case for each state."""

import pytest
from pyspark.sql import functions as F

from threadloom.operators import lineage

FACT = "fact_id string, scope int, fact_key string, anchor_name string, subject_role string, window string, source_ref string, user_name string, bot_name string"
CENSUS = [(1, "a", 11, "user"), (1, "a", 12, "assistant")]
MESSAGES = "scope int, window string, msg_index long, role string"


def status(spark, messages, **fact):
    base = {"fact_id": "f", "scope": 1, "fact_key": "user_prefers", "anchor_name": "A-Yuan", "subject_role": "", "window": "a", "source_ref": "window_20250201_a_msg_011", "user_name": "A-Yuan", "bot_name": "Companion"} | fact
    row = lineage.lineage(spark.createDataFrame([tuple(base.values())], FACT), spark.createDataFrame(messages, MESSAGES)).first()
    return row["status"], row["primary_role"], row["ok"]


@pytest.mark.parametrize(("fact", "messages", "want"), [
    ({"source_ref": "window_20250201_a_msg_012"}, CENSUS, ("source_primary_role_mismatch", "assistant", False)),
    ({"source_ref": "window_20250201_a_msg_011 | window_20250201_a_msg_012"}, CENSUS, ("source_role_lineage_exact", "user", True)),
    ({"source_ref": "window_20250201_msg_011"}, CENSUS, ("source_ref_window_unbound", "", False)),
    ({"source_ref": "window_20250201_b_msg_011"}, CENSUS, ("source_ref_window_mismatch", "", False)),
    ({"source_ref": "anything"}, CENSUS, ("source_ref_invalid", "", False)),
    ({"source_ref": "window_20250201_a_msg_099"}, CENSUS, ("source_ref_outside_census", "", False)),
    ({"window": "z"}, CENSUS, ("source_window_invalid", "user", False)),
    ({"window": ""}, CENSUS, ("source_role_lineage_exact", "user", True)),
    ({"window": "", "source_ref": "window_20250201_msg_011"}, [*CENSUS, (1, "b", 11, "user")], ("source_window_ambiguous", "", False)),
    ({}, [(1, "a", None, "user")], ("source_role_census_incomplete", "", False)),
    ({}, [*CENSUS, (1, "a", 11, "user")], ("source_role_census_incomplete", "user", False)),
    ({}, [(2, "a", 11, "user")], ("source_role_census_incomplete", "", False)),
    ({"fact_key": "weather_state", "anchor_name": "weather", "source_ref": "window_20250201_a_msg_012"}, CENSUS, ("source_subject_role_unknown", "assistant", False)),
    ({"fact_key": "weather_state", "anchor_name": "weather", "source_ref": "window_20250201_a_msg_012", "subject_role": "other"}, CENSUS, ("source_subject_role_other", "assistant", True)),
    ({"fact_key": "user_weather_state", "subject_role": "other"}, CENSUS, ("source_subject_role_conflict", "user", False)),
    ({"fact_key": "mood", "anchor_name": "companion", "source_ref": "window_20250201_a_msg_012"}, CENSUS, ("source_role_lineage_exact", "assistant", True)),
])
def test_lineage_states(spark, fact, messages, want):
    assert status(spark, messages, **fact) == want


def test_census_counts(spark):
    rows = [*CENSUS, (1, "a", 11, "assistant"), (1, " ", 3, "user"), (1, "b", 0, "user"), (2, "c", 1, "user"), (3, None, None, None)]
    places, scopes = lineage.census(spark.createDataFrame(rows, MESSAGES))
    assert {tuple(r) for r in scopes.collect()} == {(1, 5, 1, 2, 1, False), (2, 1, 1, 0, 0, True), (3, 1, 0, 1, 0, False)}
    assert places.count() == 3


def test_geometry_and_partition(spark):
    refs = {"blank": "", "exact": "window_20250201_a_msg_524 | window_20250201_a_msg_526", "outside": "window_20250201_a_msg_318", "cross": "window_20250201_b_msg_524", "scope": "window_19990101_a_msg_524", "invalid": "PRIVATE BODY", "legacy": "window_20250201_msg_524"}
    rows = spark.createDataFrame(list(refs.items()), "id string, declared_ref string").select("*", F.lit("20250201").alias("d"), F.lit("a").alias("w"), F.lit(524).alias("x"), F.lit(526).alias("y"))
    accepted, holds = lineage.partitioned(rows, ["d", "w", "x", "y"])
    assert {r["id"] for r in accepted.collect()} == {"blank", "exact"}
    assert {tuple(r) for r in holds.collect()} == {("outside", "source_ref_outside_range"), ("cross", "source_ref_window_mismatch"), ("scope", "source_ref_scope_mismatch"), ("invalid", "source_ref_invalid"), ("legacy", "source_ref_invalid")}
