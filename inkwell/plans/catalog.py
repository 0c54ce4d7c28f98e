"""All named queries of the engine."""

from __future__ import annotations

from inkwell.plans import crawl, deque, discovery, misc, pages, ranking, reports, session, state, streams, text  # noqa: F401  they register their queries
from inkwell.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
