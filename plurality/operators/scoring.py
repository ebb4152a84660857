"""Row-level scoring of predictions against votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..constants import VOTE_BANDS


def vote_band(n: Column) -> Column:
    out = None
    for name, lo, hi in VOTE_BANDS:
        cond = (n >= lo) if hi is None else n.between(lo, hi)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def with_clipped(df: DataFrame, p: str = "p", out: str = "c", k: int = 6) -> DataFrame:
    """Scoring form of the probabilities: clipped and renormalised once."""
    return df.withColumns({f"{out}{i}": c for i, c in enumerate(fn.clip_renorm(fn.cols(p, k)))})


def score_rows(df: DataFrame, p: str = "p") -> DataFrame:
    """Add every row metric of one prediction table (needs v0.., q0.., n and probabilities)."""
    df = with_clipped(df, p)
    q, c, v = fn.cols("q"), fn.cols("c"), fn.cols("v")
    return df.withColumns({
        "kl": fn.kl(q, c),
        "ce": fn.cross_entropy(q, c),
        "sse": fn.squared_error(q, c),
        "brier": fn.expected_brier(q, c),
        "ent": fn.entropy(c),
        "omx": 1.0 - fn.top_mass(c),
        "y": fn.unique_majority(v),
        "yhat": fn.first_argmax(c),
        "d_obs": fn.disagreement(v),
        "band": vote_band(F.col("n")),
    })


def referral_score(name: str | Column) -> Column:
    """Score registry: a named score of a scored table, or any Column of the caller."""
    if isinstance(name, Column):
        return name
    known = {"entropy": "ent", "one_minus_max": "omx", "d_hat": "d_hat"}
    if name not in known:
        raise ValueError(f"unknown referral score {name!r}; known: {sorted(known)}")
    return F.col(known[name])


def target_entropy(q: list[Column]) -> Column:
    """Entropy of the vote shares on a 1e-9 grid, so that equal vote patterns get equal values
    whatever the order of the classes and the order of summation."""
    return F.round(fn.entropy(q), 9)


def strata_rows(df: DataFrame, t1: Column, t2: Column, valid: Column) -> DataFrame:
    """One output row per (input row, analysis stratum it belongs to), in a single pass."""
    h = target_entropy(fn.cols("q"))
    names = [
        F.concat(F.lit("votes:"), vote_band(F.col("n"))),
        F.when(h <= t1, "entropy:low").when(h <= t2, "entropy:mid").otherwise("entropy:high"),
        F.when(valid < 0.95, "valid:lt_0.95").otherwise("valid:ge_0.95"),
        F.when(F.col("y") >= 0, F.concat(F.lit("majority:"), F.col("y").cast("string"))).otherwise("majority:tied"),
    ]
    return df.withColumn("stratum", F.explode(F.array(*names)))
