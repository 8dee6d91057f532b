"""Registered queries: every operator over the driver's tables, with DuckDB SQL of the same result.

The driver's tables hold no source code and no traces. Each query therefore maps a table to the schema that its operator
takes, and says how; the operators themselves are tested on code, traces and reports in ``tests/``.
"""

from brindle.queries import code, core, tools
from brindle.queries.base import QUERIES, SQL, Query

__all__ = ["QUERIES", "SQL", "Query", "code", "core", "oracle_sql", "queries", "tools"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
