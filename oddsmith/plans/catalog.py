"""Registry of runnable plans and the SQL each one is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from oddsmith.functions.columns import rounded
from oddsmith.plans.bindings import VIEWS, Model, duck_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _expand_rounding(sql: str) -> str:
    """Replace each ``R(expr)`` by the shared six-decimal rounding expression."""
    while True:
        m = re.search(r"\bR\(", sql)
        if not m:
            return sql
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        inner = sql[m.end() : i - 1]
        sql = (
            sql[: m.start()]
            + f"(floor(cast(({inner}) as double) * 1000000 + 0.50001) / 1000000)"
            + sql[i:]
        )


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the model views it mentions."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    ctes = ", ".join(f"{n} AS ({body})" for n, body in duck_views(used))
    sql = _expand_rounding(sql.strip())
    if not ctes:
        return sql
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if m:
        return f"WITH {m.group(1) or ''}{ctes}, {sql[m.end():]}"
    return f"WITH {ctes} {sql}"


def plan(key: str, oracle: str | None = None):
    """Register ``fn(model) -> DataFrame`` under ``key``; doubles are rounded on the way out."""

    def deco(fn):
        QUERIES[key] = lambda spark, folder: rounded(fn(Model(spark, folder)))
        if oracle is not None:
            ORACLES[key] = with_views(oracle)
        return fn

    return deco
