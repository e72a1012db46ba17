"""Named queries, with the DuckDB SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    help: str


_QUERIES: dict[str, Query] = {}
_MODULES = ("guided", "pixels", "aggregates", "neighbourhood", "resampling", "similarity", "geometry", "text", "storage", "connectivity", "palettes", "files", "extensions")


def query(oracle: str | None = None, name: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its own name or another."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"two queries are named {key}")
        _QUERIES[key] = Query(key, f, oracle, (f.__doc__ or "").strip().split("\n")[0])
        return f

    return register


def load() -> dict[str, Query]:
    for m in _MODULES:
        importlib.import_module(f"pixelframe.queries.{m}")
    return _QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in load().items()}


def oracles() -> dict[str, str]:
    return {k: q.oracle for k, q in load().items() if q.oracle}


def find(name: str) -> Query:
    """The query of that name, whatever its case. Raises KeyError with near names if there is none."""
    known = {k.lower(): q for k, q in load().items()}
    if name.strip().lower() not in known:
        near = [k for k in known if k.startswith(name.strip().lower()[:4])]
        raise KeyError(f"no query {name!r}; did you mean one of {near}?")
    return known[name.strip().lower()]


def execute(command: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run a command line: a query's name and arguments (`-name value`), which go to the query's parameters of those names. Raises TypeError for arguments that it does not have."""
    from .functions.text import parse_arguments

    name, _, rest = command.strip().partition(" ")
    given = {k: v[0] if len(v) == 1 else v for k, v in parse_arguments(rest).items()}
    return find(name).run(spark, sf_dir, **given)


def listing(prefix: str = "") -> list[tuple[str, str]]:
    """(name, help) of the queries whose names begin with prefix, whatever its case, in order of name."""
    return sorted((k, q.help) for k, q in load().items() if k.lower().startswith(prefix.lower()))
