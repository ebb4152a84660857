"""Row functions over a fixed number of classes.

A distribution is a Python list of Columns, one per class, so that every metric unrolls
into plain arithmetic that whole-stage codegen compiles. Use :func:`unpack` for arrays.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import EPS

Columns = Sequence[Column]


def cols(prefix: str, k: int = 6) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(k)]


def unpack(array: str | Column, k: int = 6) -> list[Column]:
    c = F.col(array) if isinstance(array, str) else array
    return [c.getItem(i) for i in range(k)]


def total(xs: Columns) -> Column:
    return reduce(add, xs)


def soft_targets(votes: Columns) -> list[Column]:
    """Vote shares, never smoothed."""
    n = total(votes).cast("double")
    return [v / n for v in votes]


def clip_renorm(p: Columns, eps: float = EPS) -> list[Column]:
    """Clip below at eps, then renormalise once."""
    floored = [F.greatest(x, F.lit(eps)) for x in p]
    mass = total(floored)
    return [x / mass for x in floored]


def kl(q: Columns, p: Columns) -> Column:
    """Divergence of the prediction from the vote shares, natural log; empty classes add 0."""
    return total([F.when(a > 0, a * (F.ln(a) - F.ln(b))).otherwise(0.0) for a, b in zip(q, p)])


def cross_entropy(q: Columns, p: Columns) -> Column:
    return -total([a * F.ln(b) for a, b in zip(q, p)])


def squared_error(q: Columns, p: Columns) -> Column:
    return total([(b - a) * (b - a) for a, b in zip(q, p)])


def expected_brier(q: Columns, p: Columns) -> Column:
    return 1.0 - 2.0 * total([a * b for a, b in zip(q, p)]) + total([b * b for b in p])


def entropy(p: Columns) -> Column:
    """Shannon entropy with 0 ln 0 = 0."""
    return total([F.when(x > 0, -x * F.ln(x)).otherwise(0.0) for x in p])


def top_mass(p: Columns) -> Column:
    return F.greatest(*p)


def first_argmax(p: Columns) -> Column:
    """Index of the first largest entry."""
    m = F.greatest(*p)
    return F.coalesce(*[F.when(x == m, F.lit(i)) for i, x in enumerate(p)]).cast("bigint")


def last_argmax(p: Columns) -> Column:
    m = F.greatest(*p)
    return F.coalesce(*[F.when(x == m, F.lit(i)) for i, x in reversed(list(enumerate(p)))]).cast("bigint")


def pick(p: Columns, index: Column) -> Column:
    """The entry of ``p`` at a class index column."""
    return F.coalesce(*[F.when(index == i, x) for i, x in enumerate(p)])


def n_at_max(v: Columns) -> Column:
    m = F.greatest(*v)
    return total([(x == m).cast("bigint") for x in v])


def unique_majority(v: Columns) -> Column:
    """Class index where one class alone has the most votes, else -1."""
    return F.when(n_at_max(v) == 1, first_argmax(v)).otherwise(F.lit(-1)).cast("bigint")


def disagreement(v: Columns) -> Column:
    """Share of annotator pairs that disagree; NULL for a single vote."""
    n = total(v).cast("double")
    same = total([x * (x - 1) for x in v]).cast("double")
    return F.when(n > 1, 1.0 - same / (n * (n - 1.0)))


def js_divergence(a: Columns, b: Columns) -> Column:
    terms = []
    for x, y in zip(a, b):
        m = (x + y) * 0.5
        terms.append(0.5 * x * (F.ln(x) - F.ln(m)) + 0.5 * y * (F.ln(y) - F.ln(m)))
    return total(terms)


def js_distance(a: Columns, b: Columns) -> Column:
    return F.sqrt(F.greatest(js_divergence(a, b), F.lit(0.0)))


def temper(p: Columns, temperature: Column | float) -> list[Column]:
    """softmax(ln p / T); ``p`` must already be clipped."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    logs = [F.ln(x) for x in p]
    peak = F.greatest(*logs)
    raised = [F.exp((x - peak) / t) for x in logs]
    mass = total(raised)
    return [x / mass for x in raised]


def mix_views(local: Columns, context: Columns, gate: Column) -> list[Column]:
    return [(1.0 - gate) * a + gate * b for a, b in zip(local, context)]


def routed_gate(gate: Column, valid_local: Column, valid_context: Column, force: str | None = None) -> Column:
    """Weight of the context view; an absent or forced view decides it."""
    if force == "local":
        return F.lit(0.0)
    if force == "context":
        return F.lit(1.0)
    return F.when(valid_context <= 0, 0.0).when(valid_local <= 0, 1.0).otherwise(gate)


def dirichlet_disagreement(p: Columns, concentration: Column) -> Column:
    return 1.0 - total([x * (concentration * x + 1.0) / (concentration + 1.0) for x in p])


def rising_log(count: Column, start: Column) -> Column:
    """ln Gamma(start + count) - ln Gamma(start) for a whole count: sum of ln(start + j)."""
    steps = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda acc, j: acc + F.ln(start + j))


def dirichlet_multinomial_nll(v: Columns, p: Columns, concentration: Column) -> Column:
    """Per-vote negative log-likelihood of the counts under a Dirichlet-multinomial."""
    n = total(v)
    one = F.lit(1.0)
    log_lik = rising_log(n, one) - total([rising_log(x, one) for x in v]) - rising_log(n, concentration)
    for x, y in zip(v, p):
        log_lik = log_lik + rising_log(x, concentration * F.greatest(y, F.lit(1e-6)))
    return -log_lik / F.greatest(n.cast("double"), F.lit(1.0))
