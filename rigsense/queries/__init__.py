"""Named queries over the test tables, each with an independent SQL statement to compare with."""

from __future__ import annotations

from rigsense.queries.registry import ORACLE, QUERIES


def load() -> tuple[dict, dict]:
    from rigsense.queries import (  # noqa: F401
        aggregates, cleaning, evaluation, fleet, kpis, policies, streams, tables, windows,
    )

    return QUERIES, ORACLE
