"""Perturbations and evidence audits (L)."""

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import cells as cl
from ..operators import evidence as ev
from ..operators import perturb as pt
from ..operators import signal as sg
from ..operators.ranking import histogram_quantiles
from ..operators.splits import balanced_cases
from ..session import cut_lineage, join_small
from ..sources import standins as sv
from . import spectral as sp
from .modelling import FEATURES, NAMES, fitted, fitted_on
from .registry import query
from .sqlkit import r, sql
from .temporal import sample_windows

_FRACTIONS = (0.0, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)


def _summary(c):
    """Valid share, total and spread of every (row, view) after the change."""
    return c.groupBy("row", "view").agg(F.avg(F.col("valid").cast("int")).alias("valid_fraction"), F.sum("value").alias("total"))


def _sum_sql(value, valid):
    return sql("SELECT \"row\", view, " + r("avg(ok::INT)", "valid_fraction") + ", " + r("sum(zz)", "total")
               + f" FROM (SELECT *, {value} AS zz, {valid} AS ok FROM (SELECT z.*, scale FROM s_z z JOIN s_norm n ON n.view=z.view AND n.region=z.region)) GROUP BY 1, 2")


def _apply(cells, change):
    return cells.withColumns({"value": change[0], "valid": change[1]})


@query("l01_region_removal", _sum_sql("CASE WHEN region='A' THEN 0.0 ELSE z END", "valid AND region <> 'A'"))
def l01(spark, d):
    return _summary(_apply(sp.normalised(spark, d), pt.remove_region("A")))


MASK = {"local": (1, 2), "uniform": (2, 3)}


@query("l02_time_mask", _sum_sql(
    "CASE WHEN (view='local' AND tbin BETWEEN 1 AND 2) OR (view='uniform' AND tbin BETWEEN 2 AND 3) THEN 0.0 ELSE z END",
    "valid AND NOT ((view='local' AND tbin BETWEEN 1 AND 2) OR (view='uniform' AND tbin BETWEEN 2 AND 3))"))
def l02(spark, d):
    return _summary(_apply(sp.normalised(spark, d), pt.mask_time(MASK)))


def scaled(spark, d):
    """Normalised cells with the scale of their (view, region)."""
    c = sp.kept_cells(spark, d)
    return with_scale(c, sp.normaliser(spark, d, c))


def with_scale(cells, stats):
    return join_small(cl.normalise(cells, stats), stats.select("view", "region", "scale"), ["view", "region"])


@query("l03_gain_shift", _sum_sql("CASE WHEN valid THEN greatest(-8.0, least(z + 1.5/scale, 8.0)) ELSE 0.0 END", "valid"))
def l03(spark, d):
    return _summary(_apply(scaled(spark, d), pt.shift_gain(1.5, F.col("scale"))))


def score_conditions(spark, d, cells, model):
    """Features, probabilities and vote shares of every (window, condition)."""
    x = cl.feature_vectors(sp.features(cells), cells, NAMES, ("local", "uniform")).fillna(0.0, subset=FEATURES)
    v = sv.targets(sv.window_votes(spark, d)).select("recording_id", *[f"q{k}" for k in range(6)])
    s = model.score(x.join(v, "recording_id"), "p")
    s = s.withColumns({f"f{k}": c for k, c in enumerate(fn.clip_renorm(fn.cols("p")))})
    return s.select("condition", "recording_id", "row", *[f"q{k}" for k in range(6)], *[F.col(f"f{k}").alias(f"p{k}") for k in range(6)])


def _audit(spark, d, cells, model, clean):
    s = cut_lineage(score_conditions(spark, d, cells, model))
    return ev.condition_table(ev.compare_conditions(s, ["recording_id", "row"], clean), "recording_id")


@query("l04_condition_suite")
def l04(spark, d):
    """Six conditions on the same rows; only the wide-frame one needs cells of its own."""
    raw = sp.kept_cells(spark, d)
    stats = cut_lineage(sp.normaliser(spark, d, raw))  # the fit, the conditions and the wide frames share cells and scales
    z = cut_lineage(with_scale(raw, stats))
    _, model = fitted_on(spark, d, z.drop("scale"))
    conds = {"clean": pt.keep(), "region_missing": pt.remove_region("A"), "time_mask": pt.mask_time(MASK),
             "gain_mild": pt.shift_gain(0.5, F.col("scale")), "gain_strong": pt.shift_gain(1.5, F.col("scale"))}
    same = pt.fan_out(z, conds).drop("scale")
    wide = sg.encode(sample_windows(spark, d), sp.RC_WIDE, own=True)
    local = cl.normalise(wide.unionByName(raw.where(F.col("view") == "uniform")), stats)
    return _audit(spark, d, same.unionByName(local.withColumn("condition", F.lit("wide_frames"))), model, "clean")


@query("l05_view_and_region_deletion")
def l05(spark, d):
    z, _, model = fitted(spark, d)
    conds = {"intact": pt.keep(), "local_removed": pt.remove_view("local"), "context_removed": pt.remove_view("uniform"),
             "region_removed_A": pt.remove_region("A"), "region_removed_B": pt.remove_region("B")}
    return _audit(spark, d, pt.fan_out(z, conds), model, "intact")


@query("l06_ranked_deletion_curves")
def l06(spark, d):
    """Loss and shift as local (region, time bin) blocks go, by importance and in a seeded order."""
    z, t, model = fitted(spark, d)
    m = t.withColumns({"class": fn.unique_majority(fn.cols("v")), "entropy": F.round(fn.entropy(fn.cols("q")), 9)}).where(F.col("class") >= 0)
    middle = histogram_quantiles(m, [], "entropy", (0.5,)).select("quantile").scalar()
    m = m.withColumn("half", F.when(F.col("entropy") <= middle, "low").otherwise("high"))
    cases = balanced_cases(m, ["class", "half"], "row", 4, sp.SEED).select("row")
    c = cut_lineage(z.join(cases, "row", "left_semi"))
    now = score_conditions(spark, d, c.withColumn("condition", F.lit("now")), model)
    banded = c.withColumn("band", cl.band_of(F.col("fbin"), sp.FE, sp.BANDS)).where(F.col("band").isNotNull())
    blocks = cut_lineage(ev.block_importance(banded, now, model, banded, "local", (2, 6), sp.SEED))
    s = cut_lineage(score_conditions(spark, d, ev.occluded_cells(c, blocks, "local", _FRACTIONS, 16), model))
    cmp_ = ev.compare_conditions(s, ["recording_id", "row"], "ranked:0.0")
    out = cmp_.groupBy("condition").agg(F.avg("kl").alias("kl"), F.avg("js").alias("js"), F.count(F.lit(1)).alias("n_cases"))
    part = F.split("condition", ":")
    return out.select(part[0].alias("block_order"), part[1].cast("double").alias("fraction"), "kl", "js", "n_cases")
