"""All queries of this package, collected from the modules of ``corpusmill.plans``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> (function of (spark, sf_dir), SQL or None)
_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers the decorated function under its name, with the SQL that gives the same rows."""

    def register(function):
        _QUERIES[function.__name__] = (function, sql)
        return function

    return register


def _load() -> None:
    import importlib
    import pkgutil

    from corpusmill import plans

    for module in pkgutil.iter_modules(plans.__path__):
        importlib.import_module(f"corpusmill.plans.{module.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: function for name, (function, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
