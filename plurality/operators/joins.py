"""Key alignment and join gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .gates import GateError


def alignment_counts(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys on one side only and duplicate keys, counted from one tagged union and one aggregate.

    Cheaper than a full outer join: each side is combined by key before the shuffle.
    """
    t = a.select(*key, F.lit(1).alias("in_a"), F.lit(0).alias("in_b")).unionByName(
        b.select(*key, F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))
    per = t.groupBy(*key).agg(F.sum("in_a").alias("a"), F.sum("in_b").alias("b"))
    return per.agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("common"),
                   F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"),
                   F.count_if((F.col("a") > 1) | (F.col("b") > 1)).alias("repeated"))


def aligned(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Inner join that refuses to drop or repeat a key silently."""
    c = alignment_counts(a, b, key).first()
    if c.only_a or c.only_b or c.repeated:
        raise GateError(f"keys must align one to one: {c.asDict()}")
    return a.join(b, list(key))


def target_mismatches(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows of ``a``, per ``by``, whose targets differ from those of the same key in ``b``."""
    y = b.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    off = None
    for c in columns:
        d = ~F.col(c).eqNullSafe(F.col(f"__{c}"))
        off = d if off is None else off | d
    return a.join(y, list(key)).groupBy(*by).agg(F.count(F.lit(1)).alias("n_common"), F.count_if(off).alias("n_mismatch"))


def gather(ids: DataFrame, rows: DataFrame, key: str, missing: str = "raise") -> DataFrame:
    """The requested rows with the position they were asked for in ``pos``.

    An id without a row raises inside the plan, with no pass of its own; ``missing="null"`` keeps
    it with nulls instead. No requested position is ever lost.
    """
    if missing not in ("raise", "null"):
        raise ValueError("missing is 'raise' or 'null'")
    j = ids.join(rows.withColumn("__found", F.lit(True)), key, "left")
    if missing == "raise":
        text = F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
        # every column of the rows depends on the check, so that none can be had without it
        found = [F.when(F.col("__found"), F.col(c)).otherwise(F.raise_error(text).cast(t)).alias(c) if c in rows.columns else F.col(c) for c, t in j.dtypes if c != "__found"]
        return j.select(*found)
    return j.drop("__found")
