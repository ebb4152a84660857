"""Temperature scaling fitted per key over distributed rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..constants import T_MAX, T_MIN
from ..session import cut_lineage, join_small


def fit_temperature(df: DataFrame, by: Sequence[str], group: str, t_min: float = T_MIN, t_max: float = T_MAX,
                    tol: float = 1e-10, max_rounds: int = 40) -> DataFrame:
    """One temperature per key minimising the group-weighted cross-entropy of softmax(ln c / T).

    The objective is convex in b = 1/T with closed-form slope and curvature, so each round is a
    single aggregate over the rows (no grid fan-out) and a clamped Newton step on a table with
    one row per key. Rows are read from a checkpoint; only the step sizes reach the driver.
    """
    logs = [F.ln(c).alias(f"lg{k}") for k, c in enumerate(fn.cols("c"))]
    rows = cut_lineage(df.select(*by, group, *[f"q{k}" for k in range(6)], *logs))
    lo, hi = 1.0 / t_max, 1.0 / t_min
    state = rows.select(*by).distinct().withColumns({"b": F.lit(1.0), "step": F.lit(1.0)})
    lg, q = fn.cols("lg"), fn.cols("q")
    for _ in range(max_rounds):
        j = join_small(rows, state.select(*by, "b"), by)
        top = F.greatest(*lg)
        e = [F.exp(F.col("b") * (x - top)) for x in lg]
        j = j.withColumns({f"e{k}": x for k, x in enumerate(e)})
        mass = fn.total(fn.cols("e"))
        m1 = fn.total([a * b for a, b in zip(fn.cols("e"), lg)]) / mass
        m2 = fn.total([a * b * b for a, b in zip(fn.cols("e"), lg)]) / mass
        slope = m1 - fn.total([a * b for a, b in zip(q, lg)])
        per = j.groupBy(*by, group, "b").agg(F.avg(slope).alias("__g"), F.avg(m2 - m1 * m1).alias("__h"))
        s = per.groupBy(*by, "b").agg(F.avg("__g").alias("__g"), F.avg("__h").alias("__h"))
        move = F.greatest(F.lit(-0.75), F.least(F.col("__g") / F.greatest(F.col("__h"), F.lit(1e-12)), F.lit(0.75)))
        new = F.greatest(F.lit(lo), F.least(F.col("b") - move, F.lit(hi)))
        state = cut_lineage(s.select(*by, new.alias("b"), F.abs(new - F.col("b")).alias("step")))
        if (state.agg(F.max("step")).first()[0] or 0.0) < tol:
            break
    else:
        raise RuntimeError(f"temperatures did not settle in {max_rounds} rounds")
    return state.select(*by, (1.0 / F.col("b")).alias("temperature"))


def with_temperature(df: DataFrame, fits: DataFrame, by: Sequence[str], out: str = "t") -> DataFrame:
    """Calibrated probabilities t0..t5 (scoring form) from c0..c5 and the key's temperature."""
    j = join_small(df, fits, by)
    j = j.withColumns({f"__s{k}": x for k, x in enumerate(fn.temper(fn.cols("c"), F.col("temperature")))})
    j = j.withColumns({f"{out}{k}": x for k, x in enumerate(fn.clip_renorm(fn.cols("__s")))})
    return j.drop(*[f"__s{k}" for k in range(6)])


def temperature_report(df: DataFrame, fits: DataFrame, by: Sequence[str], group: str, t_min: float = T_MIN,
                       t_max: float = T_MAX, bound_tol: float = 1e-3) -> DataFrame:
    """Temperature with bound flags, objectives at 1, at the optimum and at both bounds, KL before and after."""
    j = join_small(df, fits, by)
    q, c = fn.cols("q"), fn.cols("c")
    aggs = []
    marks = {"before": F.lit(1.0), "after": F.col("temperature"), "at_min": F.lit(t_min), "at_max": F.lit(t_max)}
    for name, t in marks.items():
        j = j.withColumns({f"__{name}{k}": x for k, x in enumerate(fn.temper(c, t))})
        j = j.withColumns({f"__{name}{k}": x for k, x in enumerate(fn.clip_renorm(fn.cols(f"__{name}")))})
        aggs.append(F.avg(fn.cross_entropy(q, fn.cols(f"__{name}"))).alias(f"ce_{name}"))
    aggs += [F.avg(fn.kl(q, fn.cols(f"__{n}"))).alias(f"kl_{n}") for n in ("before", "after")]
    names = [f"ce_{n}" for n in marks] + ["kl_before", "kl_after"]
    per = j.groupBy(*by, group, "temperature").agg(*aggs, F.count(F.lit(1)).alias("c"))
    out = per.groupBy(*by, "temperature").agg(*[F.avg(n).alias(n) for n in names], F.sum("c").alias("n_rows"),
                                              F.count(F.lit(1)).alias("n_groups"))
    t = F.col("temperature")
    return out.withColumn("bound_hit", F.when(F.abs(t - t_min) <= bound_tol, "lower").when(F.abs(t - t_max) <= bound_tol, "upper"))
