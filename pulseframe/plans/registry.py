"""Register of checked queries: a Spark function and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseframe.plans.oracle_views import VIEWS
from pulseframe.plans.views import Tables
from pulseframe.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``fn(tables)`` under its name, with the SQL body of its oracle."""

    def register(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(tune(spark), sf_dir))

        QUERIES[key] = run
        if sql is not None:
            SQL[key] = with_views(sql)
        return fn

    return register


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it uses, each after the ones it uses itself."""
    ordered: list[str] = []

    def visit(text):
        for word in re.findall(r"\bv_\w+", text):
            if word in VIEWS and word not in ordered:
                visit(VIEWS[word])
                if word not in ordered:
                    ordered.append(word)

    visit(body)
    if not ordered:
        return body.strip()
    views = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in ordered)
    body = body.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body.startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def r(column: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison; engines add doubles in different orders."""
    named = column if isinstance(column, str) else None
    rounded = F.round(F.col(column) if named else column, digits)
    return rounded.alias(named) if named else rounded


def r_ties(column: str, digits: int) -> Column:
    """A double rounded as DuckDB does it, which decides ties on the double times a power of ten, not on its decimal digits."""
    scale = F.lit(10.0**digits)
    return (F.round(F.col(column) * scale) / scale).alias(column)


def micros(column: str, alias: str | None = None) -> Column:
    return F.unix_micros(column).alias(alias or f"{column}_us")
