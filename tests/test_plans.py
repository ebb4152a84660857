"""Plans of the slowest queries: what is compiled, and how often shared steps run."""

from __spark_entry__ import queries
from plurality.operators import curves, resample
from plurality.plans import perturbation
from plurality.plans import spectral
from plurality.session import JIT_BYTES, jit_sized
from pyspark.sql import functions as F

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_long_stages_are_not_interpreted(spark, data):
    """rows are not scored by methods too long for HotSpot; a limit of the caller's stays."""
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.unset(LIMIT)
        queries()["g18_temperature_effect"](spark, data)
        assert int(spark.conf.get(LIMIT)) == JIT_BYTES
        spark.conf.set(LIMIT, "6000")
        jit_sized(spark)
        assert spark.conf.get(LIMIT) == "6000"
    finally:
        spark.conf.set(LIMIT, before)


def test_condition_suite_fits_once(spark, data, monkeypatch):
    """the conditions, the model and the wide frames share one table of cells and one fit of its scales."""
    calls = []
    for name in ("kept_cells", "normaliser"):
        real = getattr(spectral, name)
        monkeypatch.setattr(spectral, name, lambda *a, _real=real, _name=name: calls.append(_name) or _real(*a))
    assert perturbation.l04(spark, data).count() == 6
    assert sorted(calls) == ["kept_cells", "normaliser"]


def test_rank_statistic_orders_rows_once(spark, monkeypatch):
    """replicates are weights of one order; values as by pairs, a replicate without rows is left out."""
    rows = [(g, c, float((g * 7 + k) % 5), 2, (g + k + c) % 3) for g in range(6) for k in range(4) for c in (0, 1)]
    df = spark.createDataFrame(rows, "g bigint, class bigint, score double, n_at bigint, pos_at bigint")
    calls = []
    real = curves.ordered_prefix
    monkeypatch.setattr(curves, "ordered_prefix", lambda *a, **k: calls.append(1) or real(*a, **k))

    def statistic(x, keys, weights):
        sums = [F.sum(F.col(w) * F.col(f"{m}_at")).alias(f"{m}_{i}") for i, w in enumerate(weights) for m in ("n", "pos")]
        return curves.auroc_many(x.groupBy(*keys, "class", "score").agg(*sums), keys, len(weights))

    got = {r["class"]: r for r in resample.bootstrap_rows(df, [], "g", statistic, 4).collect()}
    assert len(calls) == 1
    drawn = resample.multiplicities(resample.group_index(df, [], "g"), [], "g", 4).collect()

    def auc(c, weight):
        pos = [(s, p * weight.get(g, 0)) for g, k, s, n, p in rows if k == c]
        neg = [(s, (n - p) * weight.get(g, 0)) for g, k, s, n, p in rows if k == c]
        total = sum(x for _, x in pos) * sum(x for _, x in neg)
        return sum(x * y * ((s > t) + 0.5 * (s == t)) for s, x in pos for t, y in neg) / total

    for c in (0, 1):
        values = [auc(c, {r.g: r.m for r in drawn if r.replicate == i}) for i in range(4)]
        assert abs(got[c].point - auc(c, dict.fromkeys(range(6), 1))) < 1e-12
        assert abs(got[c].boot_mean - sum(values) / 4) < 1e-12 and got[c].n_replicates == 4 and got[c].n_dropped == 0
