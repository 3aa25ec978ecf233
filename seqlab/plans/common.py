"""Helpers of the query modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name and their SQL; doubles are rounded to 6 places on both sides."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, doubles: str = ""):
        def put(f: Query) -> Query:
            self.queries[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
            if sql is not None:
                self.sql[name] = rounded_sql(sql, doubles.split())
            return f

        return put


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes))


def rounded_sql(sql: str, doubles: list[str]) -> str:
    if not doubles:
        return sql
    return f"select * replace ({', '.join(f'round({c}, 6) as {c}' for c in doubles)}) from ({sql}) as rounded_rows"
