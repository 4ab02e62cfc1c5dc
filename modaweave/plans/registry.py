"""Named queries over the test tables, each with the survey rows it covers and, where SQL can say
it, an equivalent statement to check against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    rows: tuple[str, ...]
    run: Run
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, rows: str, sql: str | None = None, digits: int = 6) -> Callable[[Run], Run]:
    """Register a query; its numbers are presented as bigint and rounded double."""

    def add(fn: Run) -> Run:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir), digits)

        if name in CATALOG:
            raise ValueError(f"query {name!r} is registered twice")
        CATALOG[name] = Query(name, tuple(rows.split()), run, sql)
        return fn

    return add


def present(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("tinyint", "smallint", "int"):
            c = c.cast("bigint")
        elif kind in ("float", "double"):
            c = F.round(c.cast("double"), digits)
        cols.append(c.alias(name))
    return df.select(*cols)


def r(expr: str, digits: int = 6) -> str:
    """SQL counterpart of the rounding above (adding zero removes a negative zero)."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
