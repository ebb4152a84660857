"""Perturbations of cells: each is a pair of column expressions, so many conditions share one scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NORMAL_CLIP

Change = tuple[Column, Column]  # (value, valid)


def keep() -> Change:
    return F.col("value"), F.col("valid")


def _drop(where: Column) -> Change:
    return F.when(where, 0.0).otherwise(F.col("value")), F.col("valid") & ~where


def remove_region(region: str) -> Change:
    """The region is 0 and invalid in every view."""
    return _drop(F.col("region") == region)


def remove_view(view: str) -> Change:
    return _drop(F.col("view") == view)


def mask_time(bins: Mapping[str, tuple[int, int]]) -> Change:
    """A run of time bins (first, last) of each view is 0 and invalid."""
    hit = None
    for v, (a, b) in bins.items():
        c = (F.col("view") == v) & F.col("tbin").between(a, b)
        hit = c if hit is None else hit | c
    return _drop(hit)


def shift_gain(delta: float, scale: Column) -> Change:
    """Constant log-power shift of the valid cells of normalised data, clipped like the rest."""
    z = F.greatest(F.lit(-NORMAL_CLIP), F.least(F.col("value") + F.lit(delta) / scale, F.lit(NORMAL_CLIP)))
    return F.when(F.col("valid"), z).otherwise(0.0), F.col("valid")


def fan_out(cells: DataFrame, conditions: Mapping[str, Change]) -> DataFrame:
    """All conditions of every cell, from one scan."""
    z = F.array(*[F.struct(F.lit(n).alias("condition"), v.alias("value"), ok.alias("valid")) for n, (v, ok) in conditions.items()])
    keep_cols = [c for c in cells.columns if c not in ("value", "valid")]
    return cells.select(*keep_cols, F.explode(z).alias("z")).select(*keep_cols, "z.condition", "z.value", "z.valid")
