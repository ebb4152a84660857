"""Data-quality gates. Each counts its violations in one aggregate; strict callers refuse any."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..constants import CLASS_NAMES, LOCKED_PARTITIONS, SAMPLE_RATE_HZ, STATUSES


class GateError(ValueError):
    """A gate found violations."""


def count_rules(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows breaking each rule, next to the row count; one pass for any number of rules."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                               *[F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in rules.items()])


def require(counts: DataFrame) -> None:
    """Raise when any rule of a one-row count table is broken."""
    row = counts.first().asDict()
    bad = {k: v for k, v in row.items() if k != "n_rows" and v}
    if bad:
        raise GateError(f"gate failed: {bad}")


def vote_rules(v: Sequence[Column]) -> dict[str, Column]:
    d = [x.cast("double") for x in v]
    return {
        "non_finite": ~fn_all([~(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) for x in d]),
        "negative": fn_any([x < 0 for x in d]),
        "fractional": fn_any([x != F.floor(x) for x in d]),
        "zero_sum": F.coalesce(fn.total(d), F.lit(0.0)) <= 0,
    }


def probability_rules(q: Sequence[Column], p: Sequence[Column]) -> dict[str, Column]:
    sq, sp = fn.total(q), fn.total(p)
    return {
        "target_negative": fn_any([x < 0 for x in q]),
        "target_sum_off": F.abs(sq - 1.0) > 1e-6,
        "prediction_negative": fn_any([x < 0 for x in p]),
        "prediction_sum_zero": sp <= 0,
    }


def fn_any(cs: Sequence[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def fn_all(cs: Sequence[Column]) -> Column:
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_columns(df: DataFrame, needed: Sequence[str]) -> None:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise GateError(f"missing columns: {missing}")


def null_ids(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    require_columns(df, ids)
    return count_rules(df, {f"null_{c}": F.col(c).isNull() for c in ids})


def offset_rules(e: Column, rate: float = SAMPLE_RATE_HZ) -> dict[str, Column]:
    return {
        "not_finite": e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")),
        "below_zero": e < 0,
        "off_grid": F.abs(e * rate - F.rint(e * rate)) > 1e-6,
    }


def shared_window_rows(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Number of rows whose window key also occurs on another row. Counted by key, not windowed."""
    c = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("shared_rows"),
                 F.count_if(F.col("n") > 1).alias("shared_windows"))


def canonical_alias(df: DataFrame, keep: str, alias: str) -> DataFrame:
    """Accept either spelling of a column; when both are there they must agree, and one stays."""
    if alias not in df.columns:
        return df
    if keep not in df.columns:
        return df.withColumnRenamed(alias, keep)
    off = alias_mismatches(df, keep, alias).first()[0]
    if off:
        raise GateError(f"{keep} and {alias} disagree on {off} rows")
    return df.drop(alias)


def alias_mismatches(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(a), F.col(b)
    return df.agg(F.count_if(F.abs(x - y) > F.lit(1e-8) + F.lit(1e-5) * F.abs(y)).alias("n_mismatch"))


def consensus_audit(df: DataFrame, k: int = 6) -> DataFrame:
    """Consensus names against the unique majority, and whether ties follow class order."""
    v = fn.cols("v", k)
    names = F.array(*[F.lit(c) for c in CLASS_NAMES[:k]])
    first = F.get(names, fn.first_argmax(v).cast("int"))
    tied = fn.n_at_max(v) > 1
    return df.agg(
        F.count_if(~tied & (first != F.col("consensus"))).alias("mismatch_unique"),
        F.count_if(tied).alias("tied_rows"),
        F.count_if(tied & (first != F.col("consensus"))).alias("tied_off_order"),
        F.every(~tied | (first == F.col("consensus"))).alias("ties_follow_order"))


def select_partitions(df: DataFrame, parts: Sequence[str], role: str = "development") -> DataFrame:
    """Rows of the partitions; a development role may never ask for the locked one."""
    if role == "development" and set(parts) & set(LOCKED_PARTITIONS):
        raise GateError(f"role {role!r} asked for locked partitions {sorted(set(parts) & set(LOCKED_PARTITIONS))}")
    return df.where(F.col("partition").isin(*parts))


def drop_unusable(df: DataFrame) -> DataFrame:
    """Drop rows whose two views are both wholly invalid."""
    return df.where(~((F.col("local_valid") == 0) & (F.col("context_valid") == 0)))


def bad_statuses(df: DataFrame, status: str = "status") -> DataFrame:
    return df.where(F.col(status).isNull() | ~F.col(status).isin(*STATUSES))
