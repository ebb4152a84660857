"""Registry of the queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import jit_sized

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Report form: whole numbers as bigint, others rounded to six decimals, no negative zero.

    Decimals are rounded as the SQL twins do, on the product with a million: a quotient such as 1292/2560, whose
    double lies just below a half in the seventh decimal, goes down.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = c.cast("double")
            c = F.when(F.abs(c) < 1e300, F.round(c * 1e6, 0) / 1e6).otherwise(c) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(spark, sf_dir)``; the result is put in report form."""

    def deco(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark, d):
            jit_sized(spark)
            return tidy(fn(spark, d))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco
