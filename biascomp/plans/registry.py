"""Registry of queries: a Spark plan over the driver tables next to its SQL statement."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biascomp.plans.bindings import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def views_sql(uses: str) -> str:
    """WITH clause holding the named views and the views they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        needs, _ = SQL_VIEWS[name]
        for n in needs.split():
            visit(n)
        if name not in order:
            order.append(name)

    for name in uses.split():
        visit(name)
    return ",\n".join(f"{n} as ({SQL_VIEWS[n][1]})" for n in order)


def query(key: str, uses: str = "", sql: str | None = None):
    """Register a plan ``f(tables) -> DataFrame`` with the SQL that must agree with it."""

    def register(fn: Callable[[Tables], DataFrame]):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = run
        if sql is not None:
            body = sql.strip()
            with_clause = views_sql(uses) if uses else ""
            if with_clause and body.lower().startswith("with "):
                body = f"with {with_clause},\n{body[5:]}"
            elif with_clause:
                body = f"with {with_clause}\n{body}"
            ORACLES[key] = body
        return fn

    return register


def r(c: Column | str, digits: int = DIGITS) -> Column:
    """Rounded for comparison; never negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)
