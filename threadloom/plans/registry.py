"""The queries of the conversation-evidence operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from . import contract_queries, evidence_queries, flow_queries, folder_queries, group_queries, lineage_queries, note_queries, relation_queries, review_queries, root_queries, row_queries, signal_queries, snippet_queries, text_queries, voice_queries  # noqa: E402, F401  they register themselves
