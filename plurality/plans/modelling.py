"""Baselines and calibration (M), callbacks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import calibrate as cb
from ..operators import cells as cl
from ..operators import curves as cv
from ..operators import groups as gp
from ..operators import models as md
from ..operators.scoring import referral_score, with_clipped
from ..session import cut_lineage, join_small
from ..sources import standins as sv
from . import spectral as sp
from .registry import query
from .sqlkit import cte, kl, klist, ksum, r, sql
from .views import scored

MS = ["method", "seed"]
G = "method, seed::BIGINT AS seed"

_B0 = "SELECT " + klist("avg(q#) AS b#") + " FROM s_q WHERE \"partition\" = 'train'"
_B0R = "SELECT q.*, " + klist("greatest(b#, 1e-7::DOUBLE)/(" + "+".join(f"greatest(b{k}, 1e-7::DOUBLE)" for k in range(6)) + ") AS c#") + " FROM s_q q CROSS JOIN s_b0"


@query("m01_prior_baseline", sql(
    "SELECT \"partition\", " + r("avg(gk)", "group_kl") + ", " + r("sum(sk)/sum(nr)", "row_kl") + ", sum(nr)::BIGINT AS n_rows, count(*) AS n_groups FROM ("
    f"SELECT \"partition\", group_id, avg(k) AS gk, sum(k) AS sk, count(*) AS nr FROM (SELECT *, {kl('q', 'c')} AS k FROM s_b0r) GROUP BY 1, 2) GROUP BY 1", s_b0=_B0, s_b0r=_B0R))
def m01(spark, d):
    t = sv.targets(sv.labels(spark, d))
    b = md.prior(t.where(F.col("partition") == "train"))
    t = with_clipped(t.withColumns({f"p{k}": x for k, x in enumerate(b)}))
    t = t.withColumn("kl", fn.kl(fn.cols("q"), fn.cols("c")))
    return gp.group_weighted(t, ["partition"], "group_id", ["kl"], row_means=True)


# linear baseline on band features -------------------------------------------------------------
NAMES = [(v, g, b) for v in ("local", "uniform") for g in ("A", "B") for b in ("slow", "fast")]
FEATURES = [f"{v}_{g}_{b}_{s}" for v, g, b in NAMES for s in ("mean", "contrast")] + ["local_valid", "uniform_valid"]


def window_table(spark, d, cells):
    """Feature vectors of windows with the vote shares and partition of their recording."""
    x = cl.feature_vectors(sp.features(cells), cells, NAMES, ("local", "uniform")).fillna(0.0, subset=FEATURES)  # a lacking region
    v = sv.targets(sv.window_votes(spark, d)).withColumn("partition", sv.partition_of(F.col("recording_id")))
    return x.join(v, "recording_id")


def fitted(spark, d):
    """(normalised cells, feature table, model); both tables are checkpointed because they are read again."""
    z = cut_lineage(sp.normalised(spark, d))
    return z, *fitted_on(spark, d, z)


def fitted_on(spark, d, z):
    """(feature table, model) of normalised cells."""
    t = cut_lineage(window_table(spark, d, z))
    return t, md.fit_soft_regression(t.where(F.col("partition") == "train"), FEATURES)


@query("m02_soft_logistic_regression")
def m02(spark, d):
    _, _, m = fitted(spark, d)
    rows = [(c, f, float(w)) for c in range(6) for f, w in zip([*m.features, "bias"], [*m.weight[c], m.bias[c]])]
    return spark.createDataFrame(rows, "class bigint, feature string, coefficient double")


def _against_prior(t, m):
    """Group and row means of the divergence of the model and of the prior, per partition."""
    b = md.prior(t.where(F.col("partition") == "train"))
    both = m.score(t, "m").withColumns({f"b{k}": x for k, x in enumerate(b)})
    for pre in ("m", "b"):
        both = both.withColumns({f"{pre}{k}": x for k, x in enumerate(fn.clip_renorm(fn.cols(pre)))})
    both = both.withColumns({"linear": fn.kl(fn.cols("q"), fn.cols("m")), "prior": fn.kl(fn.cols("q"), fn.cols("b"))})
    return gp.group_weighted(both, ["partition"], "recording_id", ["linear", "prior"], row_means=True)


@query("m03_baseline_scoring")
def m03(spark, d):
    _, t, m = fitted(spark, d)
    return _against_prior(t, m)


@query("m03_all_views")
def m03_views(spark, d):
    """The same model on the features of the local and the context view."""
    v = sv.targets(sv.window_votes(spark, d)).withColumn("partition", sv.partition_of(F.col("recording_id")))
    x = sp.view_table(spark, d).join(sv.windows(spark, d).select("row", "recording_id"), "row")
    t = cut_lineage(x.join(v, "recording_id"))
    return _against_prior(t, md.fit_soft_regression(t.where(F.col("partition") == "train"), sp.VIEW_FEATURES))


# temperature --------------------------------------------------------------------------------------
cte("s_ct", "SELECT method, seed, group_id, " + klist("q#") + ", " + klist("c#") + ", " + klist("ln(c#) AS g#") + " FROM s_clip WHERE \"partition\" = 'calibration_t'")
_MXG = "greatest(" + klist("g#") + ")"
cte("s_nt0", "SELECT DISTINCT method, seed, 1.0::DOUBLE AS b FROM s_ct")
_ROUNDS = 12
for _i in range(_ROUNDS):
    cte(f"s_nt{_i + 1}", "SELECT method, seed, greatest(0.25, least(b - greatest(-0.75, least(avg(gr)/greatest(avg(he), 1e-12), 0.75)), 4.0))::DOUBLE AS b FROM ("
        "SELECT method, seed, group_id, b, avg(m1 - lq) AS gr, avg(m2 - m1*m1) AS he FROM (SELECT method, seed, group_id, b, " + ksum("q#*g#") + " AS lq, "
        + ksum("e#*g#") + "/" + ksum("e#") + " AS m1, " + ksum("e#*g#*g#") + "/" + ksum("e#") + " AS m2 FROM (SELECT c.*, b, " + klist(f"exp(b*(g# - {_MXG})) AS e#")
        + f" FROM s_ct c JOIN s_nt{_i} t ON t.method=c.method AND t.seed=c.seed)) GROUP BY ALL) GROUP BY method, seed, b")
cte("s_temp", f"SELECT method, seed, 1.0::DOUBLE/b AS temperature FROM s_nt{_ROUNDS}")


def _at(t, src):
    """Rows with scoring-form probabilities z0.. at temperature expression t."""
    e = "SELECT *, " + klist(f"exp((ln(c#) - ln(greatest(c0,c1,c2,c3,c4,c5)))/({t})) AS te#") + f" FROM {src}"
    f = "SELECT *, " + klist("greatest(te#/(te0+te1+te2+te3+te4+te5), 1e-7::DOUBLE) AS tf#") + f" FROM ({e})"
    return "SELECT * EXCLUDE (" + klist("te#") + ", " + klist("tf#") + "), " + klist("tf#/(tf0+tf1+tf2+tf3+tf4+tf5) AS z#") + f" FROM ({f})"


def _obj(t, name):
    return (f"SELECT method, seed, avg(ce) AS ce_{name}, avg(k) AS kl_{name} FROM (SELECT method, seed, group_id, avg(-{ksum('q#*ln(z#)')}) AS ce, avg({kl('q', 'z')}) AS k FROM ("
            + _at(t, "(SELECT c.*, temperature FROM s_ct c JOIN s_temp t ON t.method=c.method AND t.seed=c.seed)") + ") GROUP BY ALL) GROUP BY ALL")


@query("m04_fit_temperature", sql(
    "SELECT t.method, t.seed::BIGINT AS seed, " + ", ".join(r(c, c) for c in ("temperature", "ce_before", "ce_after", "ce_at_min", "ce_at_max", "kl_before", "kl_after"))
    + ", n_rows, n_groups, CASE WHEN abs(temperature-0.25) <= 1e-3 THEN 'lower' WHEN abs(temperature-4.0) <= 1e-3 THEN 'upper' END AS bound_hit FROM s_temp t JOIN (SELECT method, seed, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups FROM s_ct GROUP BY ALL) n USING (method, seed)"
    + "".join(f" JOIN ({_obj(t, n)}) USING (method, seed)" for t, n in (("1.0::DOUBLE", "before"), ("temperature", "after"), ("0.25::DOUBLE", "at_min"), ("4.0::DOUBLE", "at_max")))))
def m04(spark, d):
    rows = scored(spark, d, ("calibration_t",))
    return cb.temperature_report(rows, cb.fit_temperature(rows, MS, "group_id"), MS, "group_id")


_CS = "SELECT method, seed, group_id, label_id, part, kl AS kl_raw, " + kl("q", "z") + " AS kl_cal, -" + ksum("z#*ln(z#)") + " AS ent_cal FROM s_cs0"
_CS0 = _at("temperature", "(SELECT c.*, c.\"partition\" AS part, temperature FROM s_rows c JOIN s_temp t ON t.method=c.method AND t.seed=c.seed WHERE c.\"partition\" IN ('calibration_p', 'test'))")
_CT = "SELECT method, seed, ent_cal AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY method, seed ORDER BY ent_cal, label_id) AS rk, count(*) OVER (PARTITION BY method, seed) AS nn FROM s_cs WHERE part='calibration_p') WHERE rk = greatest(1, least(round_even(0.9::DOUBLE*nn, 0), nn))::BIGINT"


@query("m05_calibrate_and_score", sql(
    "SELECT c.method, c.seed::BIGINT AS seed, " + r("any_value(temperature)", "temperature") + ", " + r("avg(gr)", "group_kl_raw") + ", " + r("avg(gc)", "group_kl_cal") + ", " + r("sum(sc)/sum(nr)", "row_kl_cal") + ", "
    + r("any_value(threshold)", "threshold") + ", sum(nr)::BIGINT AS n_rows, " + r("sum(na)/sum(nr)", "actual_coverage") + ", " + r("sum(sa)/sum(na)", "accepted_risk") + " FROM ("
    "SELECT s.method, s.seed, group_id, threshold, avg(kl_raw) AS gr, avg(kl_cal) AS gc, sum(kl_cal) AS sc, count(*) AS nr, sum((ent_cal <= threshold)::INT) AS na, sum(CASE WHEN ent_cal <= threshold THEN kl_cal END) AS sa FROM s_cs s JOIN s_cthr t ON t.method=s.method AND t.seed=s.seed WHERE part='test' GROUP BY ALL) c"
    " JOIN s_temp t ON t.method=c.method AND t.seed=c.seed GROUP BY c.method, c.seed", s_cs=_CS, s_cs0=_CS0, s_cthr=_CT))
def m05(spark, d):
    """Temperature on one partition, threshold on the next, metrics on the third."""
    fits = cb.fit_temperature(scored(spark, d, ("calibration_t",)), MS, "group_id")
    t = cb.with_temperature(scored(spark, d, ("calibration_p", "test")), fits, MS)
    t = cut_lineage(t.select(*MS, "group_id", "label_id", "partition", "temperature", F.col("kl").alias("kl_raw"),
                             fn.kl(fn.cols("q"), fn.cols("t")).alias("kl_cal"), fn.entropy(fn.cols("t")).alias("ent_cal")))
    thr = cv.thresholds(t.where(F.col("partition") == "calibration_p"), MS, "ent_cal", "label_id", (0.9,)).select(*MS, "threshold")
    j = join_small(t.where(F.col("partition") == "test"), thr, MS)
    ok = F.col("ent_cal") <= F.col("threshold")
    per = j.groupBy(*MS, "temperature", "threshold", "group_id").agg(
        F.avg("kl_raw").alias("gr"), F.avg("kl_cal").alias("gc"), F.sum("kl_cal").alias("sc"), F.count(F.lit(1)).alias("nr"),
        F.count_if(ok).alias("na"), F.sum(F.when(ok, F.col("kl_cal"))).alias("sa"))
    return per.groupBy(*MS, "temperature", "threshold").agg(
        F.avg("gr").alias("group_kl_raw"), F.avg("gc").alias("group_kl_cal"), (F.sum("sc") / F.sum("nr")).alias("row_kl_cal"),
        F.sum("nr").alias("n_rows"), (F.sum("na") / F.sum("nr")).alias("actual_coverage"),
        (F.sum("sa") / F.nullif(F.sum("na"), F.lit(0))).alias("accepted_risk"))


@query("m06_evaluate_tune", sql(
    f"SELECT {G}, {r('avg(gk)', 'group_kl')}, {r('sum(sk)/sum(nr)', 'row_kl')}, {r('sum(sg)/sum(nr)', 'gate_mean')}, sum(nr)::BIGINT AS n_rows FROM (SELECT method, seed, group_id, avg(kl) AS gk, sum(kl) AS sk, sum(gate) AS sg, count(*) AS nr FROM s_rows WHERE \"partition\"='tune' GROUP BY ALL) GROUP BY method, seed"))
def m06(spark, d):
    g = gp.group_weighted(scored(spark, d, ("tune",)), MS, "group_id", ["kl", "gate"], row_means=True)
    return g.select(*MS, "group_kl", "row_kl", F.col("row_gate").alias("gate_mean"), "n_rows")


# callbacks ------------------------------------------------------------------------------------------
@query("o02_perturbation_callback", sql(
    "SELECT view, region, count(*) AS n_cells, " + r("sum(CASE WHEN region='A' THEN z*0.5 ELSE z END)", "total") + " FROM s_z GROUP BY 1, 2"))
def o02(spark, d):
    def halve_a(cells):
        return cells.withColumn("value", F.when(F.col("region") == "A", F.col("value") * 0.5).otherwise(F.col("value")))

    return sp.normalised(spark, d).transform(halve_a).groupBy("view", "region").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total"))


_O3 = "SELECT method, seed, kl, row_number() OVER w AS rnk, count(*) OVER (PARTITION BY method, seed) AS nn, sum(kl) OVER (PARTITION BY method, seed ORDER BY ent*gate, label_id ROWS UNBOUNDED PRECEDING) AS ck FROM s_rows WHERE \"partition\"='tune' WINDOW w AS (PARTITION BY method, seed ORDER BY ent*gate, label_id)"
_O3C = "SELECT method, seed, bucket, coverage, ck/rnk AS risk FROM s_o3 CROSS JOIN s_grid WHERE rnk = greatest(1, least(round_even(coverage*nn, 0), nn))::BIGINT"


@query("o03_referral_score_callback", sql(
    f"SELECT {G}, {r('sum(a)', 'aurc')} FROM (SELECT method, seed, (coverage - lag(coverage) OVER w)*(risk + lag(risk) OVER w)/2.0 AS a FROM s_o3c WINDOW w AS (PARTITION BY method, seed ORDER BY bucket)) GROUP BY 1, 2", s_o3=_O3, s_o3c=_O3C))
def o03(spark, d):
    s = scored(spark, d, ("tune",)).withColumn("score", referral_score(F.col("ent") * F.col("gate")))
    return cv.aurc(cv.risk_coverage(s, MS, "score", "kl", "label_id"), MS).select(*MS, "aurc")


def entropy_scorer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A stand-in for a caller's model: entropy of the six probabilities of each row."""
    p = np.maximum(pdf[[f"p{k}" for k in range(6)]].to_numpy(), 1e-7)
    p = p / p.sum(1, keepdims=True)
    return pdf[["method", "seed", "label_id"]].assign(score=-(p * np.log(p)).sum(1))


@query("o04_batch_inference", sql(f"SELECT {G}, label_id, {r('ent', 'score')} FROM s_rows WHERE \"partition\" = 'test'"))
def o04(spark, d):
    p = sv.predictions(spark, d, ("test",)).select(*MS, "label_id", *[f"p{k}" for k in range(6)])
    return md.predict_batches(p, entropy_scorer, "method string, seed int, label_id bigint, score double")


