"""Confusion matrix and hard-label metrics on unique-majority rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nz(c):
    return F.nullif(c, F.lit(0))


def confusion(df: DataFrame, by: Sequence[str], group: str | None = None, k: int = 6) -> DataFrame:
    """Dense k x k counts per key: rows are true classes, columns predicted ones.

    Empty cells come from zero rows added before the last sum. A join with the grid would let
    Catalyst push a not-null filter on the predicted class down into its whole expression tree.
    """
    n_groups = F.count_distinct(group) if group else F.lit(0)
    cells = df.where(F.col("y") >= 0).groupBy(*by, "y", "yhat").agg(
        F.count(F.lit(1)).alias("n"), n_groups.cast("bigint").alias("n_groups"))
    classes = F.array(*[F.lit(i).cast("bigint") for i in range(k)])
    zero = F.lit(0).cast("bigint")
    grid = F.flatten(F.transform(classes, lambda i: F.transform(classes, lambda j: F.struct(
        i.alias("y"), j.alias("yhat"), zero.alias("n"), zero.alias("n_groups")))))
    per_key = cells.groupBy(*by).agg(F.collect_list(F.struct("y", "yhat", "n", "n_groups")).alias("seen"))
    full = per_key.select(*by, F.explode(F.concat(F.col("seen"), grid)).alias("z"))
    out = full.groupBy(*by, F.col("z.y").alias("y"), F.col("z.yhat").alias("yhat")).agg(
        F.sum("z.n").alias("n"), F.sum("z.n_groups").alias("n_groups"))
    return out if group else out.drop("n_groups")


def row_normalised(cm: DataFrame, by: Sequence[str]) -> DataFrame:
    sup = cm.groupBy(*by, "y").agg(F.sum("n").alias("support"))
    return cm.join(sup, [*by, "y"]).withColumn("row_share", F.col("n") / _nz(F.col("support"))).drop("support")


def per_class(cm: DataFrame, by: Sequence[str]) -> DataFrame:
    """Support, precision, recall, F1, specificity and prevalence per class; NULL where undefined."""
    both = F.array(F.struct(F.col("y").alias("class"), F.col("n").alias("row"), F.lit(0).cast("bigint").alias("col"),
                            F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp")),
                   F.struct(F.col("yhat").alias("class"), F.lit(0).cast("bigint").alias("row"),
                            F.col("n").alias("col"), F.lit(0).cast("bigint").alias("tp")))
    m = cm.select(*by, F.explode(both).alias("m")).groupBy(*by, F.col("m.class").alias("class")).agg(
        F.sum("m.row").alias("support"), F.sum("m.col").alias("predicted"), F.sum("m.tp").alias("tp"))
    total = cm.groupBy(*by).agg(F.sum("n").alias("total"))
    m = m.join(total, list(by))
    tp, sup, pre, tot = F.col("tp"), F.col("support"), F.col("predicted"), F.col("total")
    return m.select(*by, "class", "support", "predicted", "tp", "total",
                    (tp / _nz(sup)).alias("recall"), (tp / _nz(pre)).alias("precision"),
                    (2.0 * tp / _nz(sup + pre)).alias("f1"),
                    ((tot - sup - pre + tp) / _nz(tot - sup)).alias("specificity"),
                    (sup / _nz(tot)).alias("prevalence"))


def hard_summary(pc: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy, macro means over the defined classes, multi-class MCC and kappa."""
    a = pc.groupBy(*by).agg(
        F.max("total").alias("n"), F.sum("tp").alias("hits"), F.avg("recall").alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("f1").alias("macro_f1"),
        F.count("recall").alias("n_recall"), F.count("precision").alias("n_precision"), F.count("f1").alias("n_f1"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("tp_cross"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("pp"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("ss"))
    n, hits = F.col("n").cast("double"), F.col("hits").cast("double")
    spread = (n * n - F.col("ss")) * (n * n - F.col("pp"))
    mcc = F.when(spread > 0, (hits * n - F.col("tp_cross")) / F.sqrt(F.greatest(spread, F.lit(1e-300))))
    pe = F.col("tp_cross") / (n * n)
    return a.select(*by, F.col("n").alias("n_rows"), (hits / n).alias("accuracy"), "balanced_accuracy",
                    "macro_precision", F.col("balanced_accuracy").alias("macro_recall"), "macro_f1",
                    "n_recall", "n_precision", "n_f1", mcc.alias("mcc"),
                    F.when(pe < 1.0, (hits / n - pe) / F.nullif(1.0 - pe, F.lit(0.0))).alias("kappa"),
                    F.when(n > 0, "PASS").otherwise("NOT_ESTIMABLE").alias("status"))
