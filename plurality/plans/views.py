"""Composed views shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.scoring import score_rows
from ..sources import standins as sv

ID = ("method", "seed", "label_id")


def scored(spark: SparkSession, d: str, parts=None, methods=sv.METHODS, seeds=sv.SEEDS) -> DataFrame:
    return score_rows(sv.predictions(spark, d, parts, methods, seeds))
