"""Ranking, calibration and curve queries (H), row numbering."""

from pyspark.sql import Window
from pyspark.sql import functions as F


from ..operators import curves as cv
from ..operators import ranking as rk
from ..operators.scorecells import running_counts
from ..operators.scoring import referral_score, score_rows
from ..session import stored
from ..sources import standins as sv
from .registry import query
from .sqlkit import big, cte, pick, r, sql
from .views import scored

MS = ["method", "seed"]
G = "method, seed::BIGINT AS seed"


@query("a14_row_index", sql(
    "SELECT label_id, rw AS \"row\", rw // 2048 AS shard, rw % 2048 AS pos FROM "
    "(SELECT label_id, row_number() OVER (ORDER BY label_id) - 1 AS rw FROM s_labels)"))
def a14(spark, d):
    return rk.row_index(sv.labels(spark, d).select("label_id"), "label_id", 2048)


cte("s_conf", f"SELECT method, seed, label_id, group_id, greatest(c0,c1,c2,c3,c4,c5) AS confidence, {pick('q', 'yhat')} AS observed, y, yhat FROM s_rows")
cte("s_bins", "SELECT *, ntile(10) OVER (PARTITION BY method, seed ORDER BY confidence, label_id) - 1 AS bin FROM s_conf")
cte("s_mbins", "SELECT *, ntile(10) OVER (PARTITION BY method, seed ORDER BY confidence, label_id) - 1 AS bin FROM s_conf WHERE y >= 0")
cte("s_bint", "SELECT method, seed, bin, min(confidence) AS lower, max(confidence) AS upper, avg(confidence) AS mean_confidence,"
    " avg(observed) AS mean_observed, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups FROM s_bins GROUP BY ALL")
cte("s_ece", "SELECT method, seed, sum(abs(mean_confidence-mean_observed)*n_rows)/sum(n_rows) AS ece, max(abs(mean_confidence-mean_observed)) AS mce FROM s_bint GROUP BY ALL")


def _binned(spark, d):
    rows = cv.confidence_rows(scored(spark, d)).select(*MS, "label_id", "group_id", "confidence", "observed")
    return cv.equal_count_bins(rows, MS, "confidence", "label_id", 10)


@query("h01_equal_count_bins", sql(f"SELECT {G}, label_id, bin FROM s_bins"))
def h01(spark, d):
    return _binned(spark, d).select(*MS, "label_id", "bin")


@query("h02_merge_sparse_bins")
def h02(spark, d):
    b = _binned(spark, d)
    return cv.merged_bins(b, MS, "group_id", 10, 900)


@query("h03_soft_top_label_ece", sql(
    f"SELECT {G}, {r('ece', 'ece')}, {r('mce', 'mce')}, 10::BIGINT AS n_bins, n_rows FROM s_ece"
    " JOIN (SELECT method, seed, count(*) AS n_rows FROM s_conf GROUP BY ALL) USING (method, seed)"))
def h03(spark, d):
    return cv.soft_ece(scored(spark, d), MS, "label_id")


@query("h04_majority_label_ece", sql(
    f"SELECT {G}, {r('sum(abs(mc-mo)*nr)/sum(nr)', 'ece')}, {r('max(abs(mc-mo))', 'mce')}, count(*) AS n_bins, {big('sum(nr)', 'n_rows')} FROM ("
    "SELECT method, seed, bin, avg(confidence) AS mc, avg((y = yhat)::INT) AS mo, count(*) AS nr FROM s_mbins GROUP BY ALL) GROUP BY method, seed"))
def h04(spark, d):
    return cv.soft_ece(scored(spark, d), MS, "label_id", observed="majority")


# risk-coverage ------------------------------------------------------------------------
cte("s_rank", "SELECT method, seed, label_id, group_id, ent, kl, row_number() OVER w AS rnk, count(*) OVER (PARTITION BY method, seed) AS nn,"
    " sum(kl) OVER (PARTITION BY method, seed ORDER BY ent, label_id ROWS UNBOUNDED PRECEDING) AS ck FROM s_rows"
    " WINDOW w AS (PARTITION BY method, seed ORDER BY ent, label_id)")
cte("s_grid", "SELECT i AS bucket, (i + 50) / 100.0::DOUBLE AS coverage FROM (SELECT unnest(range(0, 51)) AS i)")
_K = "greatest(1, least(round_even(coverage*nn, 0), nn))::BIGINT"
cte("s_rcgrid", f"SELECT method, seed, bucket, coverage, nn, {_K} AS k FROM (SELECT DISTINCT method, seed, nn FROM s_rank) CROSS JOIN s_grid")
cte("s_rc", "SELECT g.method, g.seed, bucket, coverage, k AS n_accepted, ck/k AS risk, ent AS threshold FROM s_rcgrid g"
    " JOIN s_rank t ON t.method=g.method AND t.seed=g.seed AND t.rnk = g.k")


@query("h06_risk_coverage", sql(
    f"SELECT {G}, bucket, {r('coverage', 'coverage')}, n_accepted, {r('risk', 'risk')}, {r('threshold', 'threshold')} FROM s_rc"))
def h06(spark, d):
    c = cv.risk_coverage(scored(spark, d), MS, "ent", "kl", "label_id")
    return c.select(*MS, "bucket", "coverage", "n_accepted", "risk", "threshold")


cte("s_grc", "SELECT method, seed, bucket, avg(m) AS group_risk FROM (SELECT g.method, g.seed, bucket, group_id, avg(kl) AS m FROM s_rcgrid g"
    " JOIN s_rank t ON t.method=g.method AND t.seed=g.seed AND t.rnk <= g.k GROUP BY ALL) GROUP BY ALL")


@query("h07_group_weighted_risk_curve", sql(f"SELECT {G}, bucket, {r('group_risk', 'group_risk')} FROM s_grc"))
def h07(spark, d):
    c = cv.risk_coverage(scored(spark, d), MS, "ent", "kl", "label_id", group="group_id")
    return c.select(*MS, "bucket", "group_risk")


cte("s_aurc", "SELECT method, seed, sum(a) AS aurc, sum(a)/0.5::DOUBLE AS aurc_normalised FROM (SELECT method, seed,"
    " (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2.0 AS a FROM s_rc WINDOW w AS (PARTITION BY method, seed ORDER BY bucket)) GROUP BY ALL")


@query("h08_aurc", sql(f"SELECT {G}, {r('aurc', 'aurc')}, {r('aurc_normalised', 'aurc_normalised')} FROM s_aurc"))
def h08(spark, d):
    return cv.aurc(cv.risk_coverage(scored(spark, d), MS, "ent", "kl", "label_id"), MS)


_COV = (0.8, 0.9, 0.95)
cte("s_cov", "SELECT unnest([0.8::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE]) AS planned_coverage")
cte("s_cp", "SELECT method, seed, ent, row_number() OVER (PARTITION BY method, seed ORDER BY ent, label_id) AS rnk, count(*) OVER (PARTITION BY method, seed) AS nn"
    " FROM s_rows WHERE \"partition\" = 'calibration_p'")
cte("s_thr", "SELECT method, seed, planned_coverage, ent AS threshold FROM s_cp CROSS JOIN s_cov"
    " WHERE rnk = greatest(1, least(round_even(planned_coverage*nn, 0), nn))::BIGINT")


@query("h09_referral_thresholds", sql(
    f"SELECT t.method, t.seed::BIGINT AS seed, {r('planned_coverage', 'planned_coverage')}, {r('threshold', 'threshold')},"
    f" {big('sum((ent <= threshold)::INT)', 'n_accepted')}, {big('sum((ent > threshold)::INT)', 'n_referred')},"
    f" {r('avg((ent <= threshold)::INT)', 'realised_coverage')} FROM s_thr t JOIN s_cp c ON t.method=c.method AND t.seed=c.seed"
    " GROUP BY t.method, t.seed, planned_coverage, threshold"))
def h09(spark, d):
    return cv.thresholds(scored(spark, d, ("calibration_p",)), MS, "ent", "label_id", _COV)


_GA = ("SELECT t.method, t.seed, planned_coverage, threshold, group_id, count(*) AS n, sum(kl) AS s, sum((ent<=threshold)::INT) AS na,"
       " sum(CASE WHEN ent<=threshold THEN kl END) AS sa FROM s_rows x JOIN s_thr t ON x.method=t.method AND x.seed=t.seed"
       " WHERE \"partition\"='test' GROUP BY ALL")
cte("s_ref", "SELECT method, seed, planned_coverage, threshold, sum(n)::BIGINT AS n_rows, sum(na)::BIGINT AS n_accepted,"
    " sum(sa)/sum(na) AS accepted_risk, (sum(s)-coalesce(sum(sa),0))/nullif(sum(n)-sum(na),0) AS referred_risk, sum(s)/sum(n) AS whole_risk,"
    " avg(sa/nullif(na,0)) AS accepted_group_risk, avg(s/n) AS whole_group_risk, count(*) AS n_groups, sum((na>0)::INT)::BIGINT AS n_groups_accepted"
    f" FROM ({_GA}) GROUP BY ALL")


@query("h10_referral_summary", sql(
    f"SELECT {G}, {r('planned_coverage', 'planned_coverage')}, {r('threshold', 'threshold')}, n_rows, n_accepted, (n_rows-n_accepted)::BIGINT AS n_referred,"
    f" {r('n_accepted/n_rows', 'actual_coverage')}, " + ", ".join(r(c, c) for c in (
        "accepted_risk", "referred_risk", "whole_risk", "accepted_group_risk", "whole_group_risk"))
    + ", n_groups, n_groups_accepted, CASE WHEN n_accepted > 0 THEN 'PASS' ELSE 'NOT_ESTIMABLE' END AS status FROM s_ref"))
def h10(spark, d):
    thr = cv.thresholds(scored(spark, d, ("calibration_p",)), MS, "ent", "label_id", _COV)
    return cv.referral_summary(scored(spark, d, ("test",)), thr, MS, "ent", "kl", "group_id")


# one-vs-rest ----------------------------------------------------------------------------
cte("s_ovr", "SELECT method, seed, label_id, group_id, y, " + "unnest([0,1,2,3,4,5])::BIGINT AS class, unnest([c0,c1,c2,c3,c4,c5]) AS score FROM s_rows WHERE y >= 0")
cte("s_ovd", "SELECT method, seed, class, score, count(*) AS n_at, sum((y=class)::INT) AS pos_at FROM s_ovr GROUP BY ALL")
cte("s_ovc", "SELECT *, sum(n_at) OVER w AS cn, sum(pos_at) OVER w AS cp, sum(n_at) OVER (PARTITION BY method, seed, class) AS an,"
    " sum(pos_at) OVER (PARTITION BY method, seed, class) AS ap FROM s_ovd WINDOW w AS (PARTITION BY method, seed, class ORDER BY score DESC)")
cte("s_auc", "SELECT method, seed, class, max(ap)::BIGINT AS n_pos, (max(an)-max(ap))::BIGINT AS n_neg,"
    " CASE WHEN max(ap) > 0 AND max(an) > max(ap) THEN (sum((an-cn+(n_at+1)/2.0::DOUBLE)*pos_at) - max(ap)*(max(ap)+1)/2.0)/(max(ap)::DOUBLE*(max(an)-max(ap))) END AS auroc,"
    " CASE WHEN max(ap) > 0 AND max(an) > max(ap) THEN sum(pos_at/nullif(ap,0)::DOUBLE*(cp/cn::DOUBLE)) END AS average_precision FROM s_ovc GROUP BY ALL")


def _running(spark, d):
    """Running counts per distinct score; the votes are stored once for the passes over them."""
    votes = stored(sv.labels(spark, d).select("label_id", "n", *[f"v{k}" for k in range(6)]), "votes")
    return running_counts(score_rows(sv.predictions_of(sv.spread(votes))), MS, "label_id")


@query("h11_auroc_one_vs_rest", sql(
    f"SELECT {G}, class, n_pos, n_neg, {r('auroc', 'auroc')}, {r('avg(auroc) OVER (PARTITION BY method, seed)', 'macro_auroc')} FROM s_auc"))
def h11(spark, d):
    a = cv.auroc_ap(_running(spark, d), MS).drop("average_precision")
    return a.withColumn("macro_auroc", F.avg("auroc").over(Window.partitionBy(*MS)))


@query("h13_average_precision", sql(
    f"SELECT {G}, class, {r('average_precision', 'average_precision')}, {r('avg(average_precision) OVER (PARTITION BY method, seed)', 'macro_ap')} FROM s_auc"))
def h13(spark, d):
    a = cv.auroc_ap(_running(spark, d), MS).select(*MS, "class", "average_precision")
    return a.withColumn("macro_ap", F.avg("average_precision").over(Window.partitionBy(*MS)))


@query("h14_roc_points", sql(f"SELECT {G}, class, {r('score', 'score')}, {r('(cn-cp)/nullif(an-ap,0)', 'fpr')}, {r('cp/nullif(ap,0)', 'tpr')} FROM s_ovc"))
def h14(spark, d):
    return cv.roc_points(_running(spark, d), MS)


@query("h15_precision_recall_points", sql(
    f"SELECT {G}, class, {r('score', 'score')}, {r('cp/cn', 'precision')}, {r('cp/nullif(ap,0)', 'recall')} FROM s_ovc"))
def h15(spark, d):
    return cv.pr_points(_running(spark, d), MS)


# Spearman -------------------------------------------------------------------------------
cte("s_dis", "SELECT method, seed, label_id, group_id, band, d_hat, round(d_obs, 9) AS d_obs FROM s_rows WHERE d_obs IS NOT NULL")
cte("s_rk", "SELECT method, seed, k, d_hat, d_obs, rank() OVER (PARTITION BY method, seed, k ORDER BY d_hat) + (count(*) OVER (PARTITION BY method, seed, k, d_hat) - 1)/2.0::DOUBLE AS ra,"
    " rank() OVER (PARTITION BY method, seed, k ORDER BY d_obs) + (count(*) OVER (PARTITION BY method, seed, k, d_obs) - 1)/2.0::DOUBLE AS rb"
    " FROM (SELECT *, unnest(['overall', band]) AS k FROM s_dis)")
cte("s_spear", "SELECT method, seed, k AS band, CASE WHEN min(d_obs) < max(d_obs) AND min(d_hat) < max(d_hat) THEN corr(ra, rb) END AS spearman FROM s_rk GROUP BY ALL")


def disagreement_rows(spark, d, **kw):
    """Rows with an observed disagreement, on a 1e-9 grid so that equal vote patterns tie exactly."""
    s = scored(spark, d, **kw).where(F.col("d_obs").isNotNull())
    return s.select(*MS, "label_id", "group_id", "band", "d_hat", F.round("d_obs", 9).alias("d_obs"))


@query("h12_spearman", sql(f"SELECT {G}, {r('spearman', 'spearman')} FROM s_spear WHERE band = 'overall'"))
def h12(spark, d):
    return rk.spearman(disagreement_rows(spark, d), MS, "d_hat", "d_obs")


@query("h16_disagreement_reliability", sql(
    f"SELECT {G}, band, bin, count(*) AS n_rows, {r('avg(d_hat)', 'mean_predicted')}, {r('avg(d_obs)', 'mean_observed')} FROM ("
    "SELECT *, ntile(8) OVER (PARTITION BY method, seed, band ORDER BY d_hat, label_id) - 1 AS bin FROM s_dis) GROUP BY method, seed, band, bin"))
def h16(spark, d):
    b = cv.equal_count_bins(disagreement_rows(spark, d), [*MS, "band"], "d_hat", "label_id", 8)
    return b.groupBy(*MS, "band", "bin").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("d_hat").alias("mean_predicted"),
                                             F.avg("d_obs").alias("mean_observed"))


@query("h16_disagreement_reliability_intervals")
def h16_intervals(spark, d):
    """The same bins with an interval of the observed mean; the bins of a replicate share its draws."""
    from ..operators import resample as rs

    keys = [*MS, "band"]
    b = cv.equal_count_bins(disagreement_rows(spark, d), keys, "d_hat", "label_id", 8)
    per = b.groupBy(*keys, "bin", "group_id").agg(F.sum("d_obs").alias("s"), F.count(F.lit(1)).alias("c"))
    return rs.bootstrap_statistic(per, keys, "group_id", ["s", "c"], lambda: F.when(F.col("c") > 0, F.col("s") / F.col("c")), within=["bin"])


@query("h17_empirical_cdf", sql(
    "SELECT DISTINCT \"partition\", " + r("local_valid", "local_valid") + ", count(*) OVER (PARTITION BY \"partition\", local_valid) AS n_at, "
    + r("cume_dist() OVER (PARTITION BY \"partition\" ORDER BY local_valid)", "share") + " FROM s_labels"))
def h17(spark, d):
    return cv.ecdf(sv.labels(spark, d).select("partition", "local_valid"), ["partition"], "local_valid")


cte("s_pv", "SELECT method, seed, \"partition\" AS family, group_id, min(abs(round(d_obs, 9) - d_hat))::DOUBLE AS p FROM s_rows WHERE d_obs IS NOT NULL GROUP BY ALL")


@query("h18_holm_adjust", sql(
    f"SELECT {G}, family, group_id, {r('p', 'p')}, {r('least(1.0, max((m - i + 1) * p) OVER (PARTITION BY method, seed, family ORDER BY p, group_id ROWS UNBOUNDED PRECEDING))', 'p_adjusted')} FROM ("
    "SELECT *, row_number() OVER (PARTITION BY method, seed, family ORDER BY p, group_id) AS i, count(*) OVER (PARTITION BY method, seed, family) AS m FROM s_pv)"))
def h18(spark, d):
    """A family for every partition of every method and seed."""
    from ..operators.resample import holm_adjust

    s = scored(spark, d).where(F.col("d_obs").isNotNull())
    p = s.groupBy(*MS, F.col("partition").alias("family"), "group_id").agg(
        F.min(F.abs(F.round("d_obs", 9) - F.col("d_hat"))).alias("p"))
    return holm_adjust(p, [*MS, "family"], "p", "group_id")


@query("h19_top_run_per_config", sql(
    f"SELECT config, run_id, {r('tune_kl', 'tune_kl')}, overall FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY tune_kl, run_id) AS i,"
    " row_number() OVER (ORDER BY tune_kl, run_id) = 1 AS overall FROM s_runs WHERE status='PASS' AND tune_kl IS NOT NULL AND epochs = 3) WHERE i = 1"))
def h19(spark, d):
    from ..operators.runs import best_run

    ok = sv.runs(spark, d).where((F.col("status") == "PASS") & F.col("tune_kl").isNotNull() & (F.col("epochs") == 3))
    return best_run(ok, "config", "tune_kl", "run_id")


@query("h20_best_epoch", sql(
    f"SELECT run_id, arg_min(epoch, (loss, epoch)) AS best_epoch, {r('min(loss)', 'best_loss')}, max(epoch) AS last_epoch, {r('arg_max(loss, epoch)', 'last_loss')} FROM s_revents GROUP BY 1"))
def h20(spark, d):
    e = sv.run_events(spark, d)
    return e.groupBy("run_id").agg(
        F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"), F.min("loss").alias("best_loss"),
        F.max("epoch").alias("last_epoch"), F.max_by("loss", "epoch").alias("last_loss"))


# score selection --------------------------------------------------------------------------
cte("s_sc", "SELECT method, seed, label_id, kl, unnest(['entropy','one_minus_max','d_hat']) AS score_name, unnest([ent, omx, d_hat]) AS score FROM s_rows WHERE \"partition\"='tune'")
cte("s_sc2", "SELECT *, row_number() OVER w AS rnk, count(*) OVER (PARTITION BY method, seed, score_name) AS nn, sum(kl) OVER (PARTITION BY method, seed, score_name ORDER BY score, label_id ROWS UNBOUNDED PRECEDING) AS ck FROM s_sc WINDOW w AS (PARTITION BY method, seed, score_name ORDER BY score, label_id)")
cte("s_sc3", f"SELECT method, seed, score_name, bucket, coverage, ck/rnk AS risk FROM s_sc2 CROSS JOIN s_grid WHERE rnk = {_K}")
cte("s_sc4", "SELECT method, seed, score_name, sum(a) AS aurc FROM (SELECT method, seed, score_name, (coverage - lag(coverage) OVER w)*(risk + lag(risk) OVER w)/2.0 AS a FROM s_sc3 WINDOW w AS (PARTITION BY method, seed, score_name ORDER BY bucket)) GROUP BY ALL")


@query("h21_referral_score_selection", sql(
    f"SELECT {G}, score_name, {r('aurc', 'aurc')}, (row_number() OVER (PARTITION BY method, seed ORDER BY aurc, score_name) = 1) AS selected FROM s_sc4"))
def h21(spark, d):
    s = scored(spark, d, ("tune",))
    names = ("entropy", "one_minus_max", "d_hat")
    long = s.select(*MS, "label_id", "kl", F.explode(F.array(*[
        F.struct(F.lit(n).alias("score_name"), referral_score(n).alias("score")) for n in names])).alias("z"))
    long = long.select(*MS, "label_id", "kl", "z.score_name", "z.score")
    by = [*MS, "score_name"]
    a = cv.aurc(cv.risk_coverage(long, by, "score", "kl", "label_id"), by).select(*by, "aurc")
    w = Window.partitionBy(*MS).orderBy("aurc", "score_name")  # three rows per method and seed
    return a.withColumn("selected", F.row_number().over(w) == 1)


@query("h22_curve_interpolation", sql(
    f"SELECT p.method, p.seed::BIGINT AS seed, {r('planned_coverage', 'planned_coverage')}, {r('ac', 'actual_coverage')},"
    f" {r('a.risk + (CASE WHEN b.risk IS NULL THEN 0.0 ELSE greatest(0.0, (ac - a.coverage)/(b.coverage - a.coverage)) END)*(coalesce(b.risk, a.risk) - a.risk)', 'risk_at')}"
    " FROM (SELECT *, n_accepted/n_rows AS ac, greatest(0, least(floor((n_accepted/n_rows - 0.5::DOUBLE)*100 + 1e-9::DOUBLE), 50))::BIGINT AS cell FROM s_ref) p"
    " JOIN s_rc a ON a.method=p.method AND a.seed=p.seed AND a.bucket=p.cell LEFT JOIN s_rc b ON b.method=p.method AND b.seed=p.seed AND b.bucket=p.cell+1"))
def h22(spark, d):
    pts = h10(spark, d).select(*MS, "planned_coverage", "actual_coverage")
    curve = cv.risk_coverage(scored(spark, d), MS, "ent", "kl", "label_id")
    return cv.interpolate_curve(pts, curve, MS, "actual_coverage", "risk")


@query("h23_complete_ordering", sql(
    f"SELECT {G}, label_id, {r('kl', 'kl')} FROM s_rows ORDER BY method, seed, label_id"))
def h23(spark, d):
    """Ordered only at the sink: a range-partitioned sort, not a single task."""
    return scored(spark, d).select(*MS, "label_id", "kl").orderBy(*MS, "label_id")


