"""Registration of queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from genoweave.registry.views import VIEWS, Views, with_views

FAMILIES = ("variants", "geometry", "copies", "structures", "alignments", "sequences", "phasing", "notes", "tracking", "scoring", "jobs")

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under a name; ``sql`` may name any view as a table."""

    def register(fn: Callable[[Views], DataFrame]):
        if name in _queries:
            raise ValueError(f"query registered twice: {name}")
        _queries[name] = lambda spark, folder: fn(Views(spark, folder))
        if sql is not None:
            _oracles[name] = with_views(sql)
        return fn

    return register


def load() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    for family in FAMILIES:
        importlib.import_module(f"genoweave.registry.{family}")
    return dict(_queries), dict(_oracles)


__all__ = ["VIEWS", "Views", "load", "query"]
