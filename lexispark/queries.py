"""All registered queries of the engine's own operators, with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from lexispark.plans import audits, corpus, experiments, files, records, selection, structure  # noqa: F401  they register themselves
from lexispark.registry import ORACLE, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
