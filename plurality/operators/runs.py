"""Run tables and event logs: best runs, best epochs, sweeps, learning curves, ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_run(df: DataFrame, config: str, loss: str, key: str) -> DataFrame:
    """Lowest loss per configuration (ties by key) and a flag on the lowest overall."""
    per = df.groupBy(config).agg(F.min(F.struct(loss, key)).alias("b")).select(
        config, F.col(f"b.{key}").alias(key), F.col(f"b.{loss}").alias(loss))
    top = df.agg(F.min(F.struct(loss, key)).alias("b")).select(F.col(f"b.{key}")).scalar()
    return per.withColumn("overall", F.col(key) == top)


def latest_per_key(df: DataFrame, key: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Last record of every key: one hash aggregation, no window."""
    rest = [c for c in df.columns if c not in key]
    last = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("z"))
    return last.select(*key, *[F.col(f"z.{c}").alias(c) for c in rest])


def mean_sd(df: DataFrame, by: Sequence[str], value: str, *extra: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
                               F.count(value).alias("n"), *extra)


def paired_contrast(df: DataFrame, a: Column, b: Column, pair: Sequence[str], value: str,
                    by: Sequence[str] = ()) -> DataFrame:
    """Difference of two configurations on common pairing keys, after one value per key.

    A conditional aggregate replaces the self-join: one scan, one shuffle.
    """
    per = df.groupBy(*by, *pair).agg(F.avg(F.when(a, F.col(value))).alias("va"),
                                     F.avg(F.when(b, F.col(value))).alias("vb"))
    per = per.where(F.col("va").isNotNull() & F.col("vb").isNotNull()).withColumn("delta", F.col("va") - F.col("vb"))
    return per.groupBy(*by).agg(F.avg("delta").alias("mean_delta"), F.stddev_samp("delta").alias("sd_delta"),
                                F.count(F.lit(1)).alias("n_pairs"))


def completeness_gate(df: DataFrame, config: str, seed: str, complete: Column, required: Sequence[int], leaked: Column | None = None) -> DataFrame:
    """PASS only when a configuration has exactly the required seeds and each has a complete run, and nothing leaks.

    Runs are reduced to one row per (configuration, seed) first; the seed list is then tiny. ``leaked``
    is the number of members that partitions share (:func:`leaked_members`); any blocks every configuration.
    """
    per = df.groupBy(config, seed).agg(F.bool_or(complete).alias("whole"))
    need = ",".join(str(s) for s in sorted(required))
    out = per.groupBy(config).agg(F.sort_array(F.collect_set(seed)).alias("s"), F.bool_and("whole").alias("whole"))
    seeds = F.concat_ws(",", F.col("s").cast("array<string>"))
    leaked = F.lit(0) if leaked is None else leaked
    return out.select(config, seeds.alias("seeds"),
                      F.when(leaked > 0, "BLOCKED").when((seeds == need) & F.col("whole"), "PASS").otherwise("INCOMPLETE").alias("status"))


def leaked_members(rows: DataFrame, keys: Sequence[str], partition: str = "partition") -> Column:
    """Members of any of the keys that occur in more than one partition, as a scalar for other plans."""
    long = rows.unpivot([partition], list(keys), "key", "member")
    per = long.groupBy("key", "member").agg((F.min(partition) != F.max(partition)).alias("shared"))
    return per.agg(F.count_if("shared")).scalar()
