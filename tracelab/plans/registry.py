"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, because summation order differs between runs; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(f.name, DIGITS) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query under ``name``; ``doubles`` lists the columns that the SQL has to round."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = _rounded_sql(sql, doubles.split())
        return fn

    return add


def _rounded_sql(sql: str, doubles: list[str]) -> str:
    if not doubles:
        return sql
    parts = ", ".join(f"round({c}, {DIGITS}) + 0.0::DOUBLE AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({parts}) FROM ({sql}) AS answer"
