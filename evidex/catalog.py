"""The queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

from evidex import catalog_grid, catalog_trades

PARTS = [catalog_trades, catalog_grid]


def queries() -> dict:
    return {k: v for p in PARTS for k, v in p.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in PARTS for k, v in p.oracle_sql().items()}
