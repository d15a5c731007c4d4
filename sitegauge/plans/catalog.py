"""Catalogue of queries: each wires tables to an operator and may name the DuckDB SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import tuned
from ..sources.fixtures import DERIVED
from ..sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The step number that Spark computes in chunks is a plain window in the checking SQL.
ORACLE_SHAPES = {
    "actions": "SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS step FROM ({sql}) a",
}


def derived_ctes(names: list[str]) -> str:
    """WITH entries for derived tables and what they read, in order."""
    seen: list[str] = []

    def add(name):
        if name in DERIVED and name not in seen:
            for need in DERIVED[name][1]:
                add(need)
            seen.append(name)

    for n in names:
        add(n)
    entries = []
    for n in seen:
        sql, needs = DERIVED[n]
        text = sql.format(**{t: t for t in needs})
        entries.append(f"{n} AS ({ORACLE_SHAPES.get(n, '{sql}').format(sql=text)})")
    return ",\n".join(entries)


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``f(tables) -> DataFrame``. ``sql`` reads the derived tables named in ``uses``."""
    def register(f):
        if name in QUERIES:
            raise ValueError(f"query '{name}' is already registered")
        QUERIES[name] = lambda spark, directory: f(Tables(tuned(spark), directory))
        if sql is not None:
            ctes = derived_ctes(uses.split())
            body = sql.strip()
            if ctes and body.upper().startswith("WITH RECURSIVE"):
                body = f"WITH RECURSIVE {ctes},\n{body[14:].lstrip()}"
            elif ctes and body.upper().startswith("WITH "):
                body = f"WITH {ctes},\n{body[5:].lstrip()}"
            elif ctes:
                body = f"WITH {ctes}\n{body}"
            ORACLES[name] = body
        return f
    return register
