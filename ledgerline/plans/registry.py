"""All registered queries by name. An operator's module registers its queries with @query when it is imported."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import NEEDS, SQL, Views

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}

MODULES = [
    "operators.segments", "operators.joins", "operators.matching", "operators.reports", "operators.ranking", "operators.state",
    "functions.scoring", "functions.folding", "functions.text", "functions.addresses", "functions.urls", "functions.links", "functions.pages", "functions.grounding", "functions.names", "functions.display", "functions.morphology", "functions.checks", "sources.register", "streaming.streams",
]


def query(name: str, sql: str | None = None):
    """Register make(views) under `name`, with its SQL on the views' and star tables' names."""

    def add(make: Callable[[Views], DataFrame]):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        if sql:
            _sql[name] = with_views(sql)
        return make

    return add


def with_views(sql: str) -> str:
    """The statement with the views it names put before it."""
    body, own, kind = sql.strip(), "", "with "
    for opening in ("with recursive ", "with "):
        if body.lower().startswith(opening):
            own, body, kind = body[len(opening) :], "", opening
    named = [v for v in SQL if re.search(rf"\b{v}\b", sql)]
    wanted = [v for v in SQL if v in named or any(v in NEEDS.get(n, []) for n in named)]
    parts = [f"{v} as ({SQL[v]})" for v in wanted]
    if own:
        return kind + ", ".join([*parts, own])
    return ("with " + ", ".join(parts) + " " if parts else "") + body


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"ledgerline.{m}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    load()
    return _queries["best_available"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_sql)
