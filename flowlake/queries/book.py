"""A book of queries and their SQL, and the rounding that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return add


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, counts as 64-bit integers; a negative zero becomes zero."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind in ("double", "float"):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        elif kind == "int":
            c = c.cast("long").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def rnd(expression: str, digits: int = DIGITS) -> str:
    """The same rounding in SQL."""
    return f"round(cast({expression} as double), {digits}) + 0.0"


def big(expression: str) -> str:
    return f"cast({expression} as bigint)"
