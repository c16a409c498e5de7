"""Every query that SQL can express, against DuckDB on the smallest tables."""

import math

import pytest

from touchline.plans import catalog

from .oracle import check


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, small, name):
    check(catalog.queries()[name], catalog.oracle_sql()[name], spark, small)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"gbt_predict", "walk_forward_backtest"}))
def test_query_without_sql_gives_each_row_once_and_finite_numbers(spark, small, name):
    df = catalog.queries()[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(map(str, rows))) == len(rows)
    assert all(math.isfinite(v) for r in rows for v in r if isinstance(v, float))
    keys = [df.columns.index(c) for c in ("player_id", "gameweek", "problem", "group_id", "time_idx", "strategy") if c in df.columns]
    assert all(r[k] is not None for r in rows for k in keys)
