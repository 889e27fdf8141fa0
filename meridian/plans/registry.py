"""All registered queries of the catalog operators, with their SQL.

A query is a function of the views; its double columns are rounded to six decimals, in its SQL as well,
so that both engines' last digits do not matter.
"""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import functions as F

from .views import duckdb_ctes, views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def _rounded(df):
    doubles = {f.name: F.round(f.name, 6) + F.lit(0.0) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(doubles) if doubles else df


def query(name: str, uses: str = "", sql: str | None = None, doubles: str = ""):
    """Register a function of the views. ``sql`` is DuckDB SQL over the views named in ``uses``; ``doubles`` are its double columns."""

    def add(build):
        QUERIES[name] = lambda spark, sf_dir: _rounded(build(views(spark, sf_dir)))
        if sql is not None:
            body, ctes = sql.strip(), duckdb_ctes(uses.split())
            if ctes:
                recursive = "RECURSIVE " if body[4:].lstrip().upper().startswith("RECURSIVE") else ""
                rest = body[4:].strip().removeprefix(recursive)
                body = f"WITH {recursive}{ctes}, {rest}" if body[:4].upper() == "WITH" else f"WITH {ctes} {body}"
            if doubles:
                body = f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}' for c in doubles.split())}) FROM ({body})"
            ORACLE[name] = body
        return build

    return add


def load() -> None:
    """Import every module of registered queries."""
    package = __name__.rpartition(".")[0]
    for module in pkgutil.iter_modules(importlib.import_module(package).__path__):
        if module.name.startswith("queries_"):
            importlib.import_module(f"{package}.{module.name}")
