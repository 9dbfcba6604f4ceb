"""The registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiflow.session import bounded_batches, ship_by_value, table

QUERIES: dict = {}
SQL: dict = {}
ship_by_value()


def query(sql: str | None = None):
    """Register a function (spark, read) under its name; read(name) gives a driver table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return f(spark, lambda name: table(spark, sf_dir, name))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
