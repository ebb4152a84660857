"""Group-weighted means: every group counts once, however many rows it has.

All of these are hash aggregations with map-side partial sums, so a group that holds a third
of the rows costs one partial row per task. Nothing is windowed by group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_means(df: DataFrame, by: Sequence[str], group: str, values: Sequence[str]) -> DataFrame:
    """Mean of each value per (by, group), with the row count."""
    return df.groupBy(*by, group).agg(
        *[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("rows_in_group"))


def group_weighted(df: DataFrame, by: Sequence[str], group: str, values: Sequence[str],
                   row_means: bool = False) -> DataFrame:
    """Mean over groups of the group means; optionally the plain row mean next to it.

    The row mean comes from the same per-group sums, so the input is aggregated once.
    """
    per = df.groupBy(*by, group).agg(
        *[F.sum(v).alias(f"s_{v}") for v in values],
        *[F.count(v).alias(f"c_{v}") for v in values], F.count(F.lit(1)).alias("rows_in_group"))
    out = []
    for v in values:
        mean = F.when(F.col(f"c_{v}") > 0, F.col(f"s_{v}") / F.nullif(F.col(f"c_{v}"), F.lit(0)))
        out.append(F.avg(mean).alias(f"group_{v}"))
        if row_means:
            out.append((F.sum(f"s_{v}") / F.nullif(F.sum(f"c_{v}"), F.lit(0))).alias(f"row_{v}"))
    return per.groupBy(*by).agg(*out, F.sum("rows_in_group").alias("n_rows"),
                                F.count(F.lit(1)).alias("n_groups"))


def group_weights(df: DataFrame, group: str) -> DataFrame:
    """Row weight 1 / (G * rows in group), so that a weighted sum is the group-weighted mean."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("rows_in_group"))
    n_groups = sizes.agg(F.count(F.lit(1)).alias("g")).scalar()
    return df.join(sizes, group).withColumn("weight", 1.0 / (n_groups * F.col("rows_in_group")))


def seed_summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_sd"),
        F.count(value).alias("n_seeds"))


def count_where(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))
