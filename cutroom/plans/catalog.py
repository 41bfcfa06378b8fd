"""Registry of the library's queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query: a function of ``get(view name) -> DataFrame``, and SQL with {view} places that gives its rows."""

    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(lambda v: views.view(spark, sf_dir, v))
        if sql:
            ORACLE_SQL[name] = views.oracle(sql)
        return build

    return register


from . import content_queries, file_queries, media_queries, text_queries, timeline_queries  # noqa: E402, F401
