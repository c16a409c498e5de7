"""All queries of the library, by name."""

from __future__ import annotations

from . import inference, series, squads  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
