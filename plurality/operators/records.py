"""Metric records: fixed fields, wide-to-long, closed status words, suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import METRIC_FIELDS, SMALL_CELL

_TYPES = {"seed": "bigint", "value": "double", "ci_low": "double", "ci_high": "double", "n_rows": "bigint",
          "n_patients": "bigint", "n_components": "bigint"}


def metric_record(df: DataFrame, **fields: Column) -> DataFrame:
    """Exactly the fixed metric fields; absent ones NULL, NaN to NULL, status PASS by default."""
    unknown = set(fields) - set(METRIC_FIELDS)
    if unknown:
        raise ValueError(f"unknown metric fields: {sorted(unknown)}")
    out = []
    for name in METRIC_FIELDS:
        kind = _TYPES.get(name, "string")
        c = fields.get(name, F.lit(None)).cast(kind)
        if kind == "double":
            c = F.when(~F.isnan(c), c)
        if name == "status":
            c = F.coalesce(c, F.lit("PASS"))
        out.append(c.alias(name))
    return df.select(*out)


def records_from_wide(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """One record per (id, metric)."""
    long = df.unpivot(ids, metrics, "metric", "value")
    return long.withColumn("status", F.when(F.col("value").isNull(), "NOT_ESTIMABLE").otherwise("PASS"))


def suppress(df: DataFrame, support: str, values: list[str], minimum: int = SMALL_CELL) -> DataFrame:
    """Hide the values of every cell supported by fewer than ``minimum`` groups."""
    hidden = F.col(support) < minimum
    return df.withColumns({v: F.when(~hidden, F.col(v)) for v in values}).withColumn("suppressed", hidden)
