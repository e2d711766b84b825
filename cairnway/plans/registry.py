"""All queries of the engine and their SQL, registered by the modules of ``cairnway.plans``."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

FLAGSHIP = "topk_rerank"
MODULES = ("geodesy", "raster", "access", "text", "wiki", "geocode", "spatial", "contacts", "places", "windows", "aggregates", "routing", "sinks", "scans", "services")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query, and the SQL that has to return the same rows; fixture views it names are put in front."""

    def add(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = with_fixtures(oracle)
        return f

    return add


def with_fixtures(sql: str) -> str:
    views = [f"{v} AS ({fixtures.oracle_view(v)})" for v in fixtures.needed(sql)]
    sql = sql.strip()
    if not views:
        return sql
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", sql):
        return f"WITH {m[1] or ''}{', '.join(views)}, {sql[m.end() :]}"
    return f"WITH {', '.join(views)} {sql}"


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"cairnway.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
