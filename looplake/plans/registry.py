"""Query registry: operator key -> (Spark builder, DuckDB oracle SQL or None).

``queries()`` / ``oracle_sql()`` in ``__spark_entry__`` are views of this
registry.  Builders take ``(spark, sf_dir)`` and return a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from looplake.sources.fixtures import Fixtures, with_fixtures

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    key: str
    build: Builder
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(key: str, sql: str | None = None):
    """Register ``fn(fx: Fixtures) -> DataFrame`` under ``key``."""

    def deco(fn: Callable[[Fixtures], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        build.__name__ = f"q_{key}"
        build.__doc__ = fn.__doc__
        REGISTRY[key] = Entry(key, build, with_fixtures(sql) if sql else None)
        return fn

    return deco


def load_all() -> dict[str, Entry]:
    # Importing the catalog modules fills REGISTRY.
    from looplake.plans import (  # noqa: F401
        catalog_ingest, catalog_scope, catalog_state, catalog_train, catalog_eval,
        catalog_monitor, catalog_registry, catalog_stream, catalog_models,
    )
    return REGISTRY
