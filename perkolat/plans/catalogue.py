"""All queries of the library, with the SQL that they are checked against."""

from . import network_queries, panel_queries, table_queries  # noqa: F401  they register themselves
from .base import QUERIES, SQL

FLAGSHIP = "flip_threshold_sweep"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
