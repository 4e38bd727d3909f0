"""Queries by name: what runs on Spark, and the same in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Registers a function of the tables. Doubles in its result are rounded to ``digits``, as in the SQL."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(Tables(spark, sf_dir))
            return found.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register
