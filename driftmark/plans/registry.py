"""Query registry: name -> (Spark callable, optional equivalent SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict = {}
SQL: dict = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles (and drop negative zero) so that engines can be compared."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(f.name)
        elif isinstance(f.dataType, (T.ShortType, T.ByteType)):
            c = c.cast("int").alias(f.name)
        cols.append(c)
    return df.select(*cols)


def query(name: str, sql: str | None = None, digits: int = 6):
    def register(fn):
        def run(spark, sf_dir):
            return tidy(fn(spark, sf_dir), digits)

        run.__doc__ = fn.__doc__
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r(expr: str, name: str, digits: int = 6) -> str:
    """SQL twin of ``tidy`` for one column."""
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name}"
