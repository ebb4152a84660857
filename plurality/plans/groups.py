"""Aggregation queries (G)."""

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import curves as cv
from ..operators import groups as gp
from ..operators import hardlabels as hl
from ..operators import ranking as rk
from ..operators import runs as rn
from ..operators import splits as sp
from ..operators.scoring import score_rows, strata_rows, target_entropy, vote_band
from ..session import cut_lineage, stored
from ..sources import standins as sv
from ..sources.tables import table
from .gates import STRATA_SQL, tertiles
from .ranking import disagreement_rows
from .registry import query
from .sqlkit import big, cte, first_argmax, kl, klist, ksum, majority, r, sql
from .views import scored

MS = ["method", "seed"]
G = "method, seed::BIGINT AS seed"


@query("g01_group_means", sql(f"SELECT {G}, group_id, {r('avg(kl)', 'kl')}, count(*) AS rows_in_group FROM s_rows GROUP BY ALL"))
def g01(spark, d):
    return gp.group_means(scored(spark, d), MS, "group_id", ["kl"])


cte("s_gm", "SELECT method, seed, group_id, avg(kl) AS gkl, sum(kl) AS skl, count(*) AS nr FROM s_rows GROUP BY ALL")


@query("g02_group_weighted_mean", sql(
    f"SELECT method, {r('avg(gk)', 'group_kl')}, {r('avg(rk)', 'row_kl')}, {big('sum(nr)', 'n_rows')}, max(ng) AS n_groups FROM ("
    "SELECT method, seed, avg(gkl) AS gk, sum(skl)/sum(nr) AS rk, sum(nr) AS nr, count(*) AS ng FROM s_gm GROUP BY ALL) GROUP BY 1 ORDER BY 2"))
def g02(spark, d):
    per = gp.group_weighted(scored(spark, d), MS, "group_id", ["kl"], row_means=True)
    return per.groupBy("method").agg(
        F.avg("group_kl").alias("group_kl"), F.avg("row_kl").alias("row_kl"), F.sum("n_rows").alias("n_rows"),
        F.max("n_groups").alias("n_groups")).orderBy("group_kl")


@query("g03_group_row_weights", sql(
    "SELECT label_id, " + r("1.0::DOUBLE / ((SELECT count(DISTINCT group_id) FROM s_labels) * count(*) OVER (PARTITION BY group_id)) * 1000.0", "weight_per_mille") + " FROM s_labels"))
def g03(spark, d):
    w = gp.group_weights(sv.labels(spark, d).select("label_id", "group_id"), "group_id")
    return w.select("label_id", (F.col("weight") * 1000.0).alias("weight_per_mille"))


@query("g04_partition_summary", sql(
    "SELECT \"partition\", count(*) AS n_rows, count(DISTINCT group_id) AS n_groups, count(DISTINCT recording_id) AS n_recordings,"
    " count(DISTINCT spectrogram_id) AS n_spectrograms, " + r("count(*) / (SELECT count(*) FROM s_labels)", "row_share") + ", "
    + klist(r("sum(v#)/sum(n)", "share#")) + " FROM s_labels GROUP BY 1"))
def g04(spark, d):
    return sp.partition_summary(sv.labels(spark, d), ["group_id", "recording_id", "spectrogram_id"]).withColumnsRenamed(
        {"n_group_id": "n_groups", "n_recording_id": "n_recordings", "n_spectrogram_id": "n_spectrograms"})


@query("g05_majority_counts", sql(
    "SELECT \"partition\", " + klist("sum((yy = #)::INT)::BIGINT AS class#") + ", sum((yy < 0)::INT)::BIGINT AS ties FROM s_h GROUP BY 1"))
def g05(spark, d):
    y = sv.labels(spark, d).withColumn("y", fn.unique_majority(fn.cols("v")))
    return y.groupBy("partition").agg(*[F.count_if(F.col("y") == k).alias(f"class{k}") for k in range(6)],
                                      F.count_if(F.col("y") < 0).alias("ties"))


_MEM = " UNION ".join(f"SELECT '{k}' AS key, {k} AS member, \"partition\" FROM s_labels" for k in ("group_id", "recording_id", "spectrogram_id"))


@query("g06_leakage_audit", sql(
    "SELECT a.key, a.\"partition\" AS part_a, b.\"partition\" AS part_b, count(*) AS shared FROM s_mem a JOIN s_mem b"
    " ON a.key = b.key AND a.member = b.member GROUP BY ALL", s_mem=_MEM))
def g06(spark, d):
    return sp.leakage_audit(sv.labels(spark, d), ["group_id", "recording_id", "spectrogram_id"])


_PC = ("SELECT \"partition\", unnest([0,1,2,3,4,5])::BIGINT AS class, unnest([v0,v1,v2,v3,v4,v5]) AS v, unnest([q0,q1,q2,q3,q4,q5]) AS q, group_id, yy, n FROM s_h")


@query("g07_class_partition_stats", sql(
    "SELECT \"partition\", class, count(*) AS n_rows, " + r("sum(q)/count(*)", "mass_share") + ", " + r("sum(v)/sum(n)", "vote_share")
    + ", count(DISTINCT CASE WHEN v > 0 THEN group_id END) AS groups_voting, sum((yy = class)::INT)::BIGINT AS majority_rows,"
    " count(DISTINCT CASE WHEN yy = class THEN group_id END) AS majority_groups FROM s_pc GROUP BY 1, 2", s_pc=_PC))
def g07(spark, d):
    t = sv.targets(sv.labels(spark, d)).withColumn("y", fn.unique_majority(fn.cols("v")))
    ex = t.select("partition", "group_id", "n", "y", F.posexplode(F.array(*[
        F.struct(F.col(f"v{k}").alias("v"), F.col(f"q{k}").alias("q")) for k in range(6)])).alias("class", "z"))
    hit = F.col("y") == F.col("class")
    return ex.groupBy("partition", "class").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("z.q").alias("mass_share"),
        (F.sum("z.v") / F.sum("n")).alias("vote_share"),
        F.count_distinct(F.when(F.col("z.v") > 0, F.col("group_id"))).alias("groups_voting"),
        F.count_if(hit).alias("majority_rows"), F.count_distinct(F.when(hit, F.col("group_id"))).alias("majority_groups"))


_BD = ("SELECT label_id, group_id, n, h, round(CASE WHEN n > 1 THEN 1.0 - " + ksum("v#*(v#-1)") + "::DOUBLE/(n*(n-1.0::DOUBLE)) END, 9) AS dd, "
       "CASE WHEN n = 1 THEN 'n=1' WHEN n <= 4 THEN 'n=2-4' WHEN n <= 9 THEN 'n=5-9' ELSE 'n>=10' END AS band FROM s_h")


@query("g08_band_ambiguity", sql(
    "SELECT b.band, n_rows, n_groups, " + ", ".join(r(c, c) for c in ("h_median", "h_mean", "h_max", "h_group", "d_median", "d_mean", "d_max", "d_group"))
    + ", CASE WHEN d_mean IS NULL THEN 'NOT_ESTIMABLE' ELSE 'PASS' END AS d_status FROM (SELECT band, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups,"
    " median(h) AS h_median, avg(h) AS h_mean, max(h) AS h_max, median(dd) AS d_median, avg(dd) AS d_mean, max(dd) AS d_max FROM s_bd GROUP BY 1) b"
    " JOIN (SELECT band, avg(mh) AS h_group, avg(md) AS d_group FROM (SELECT band, group_id, avg(h) AS mh, avg(dd) AS md FROM s_bd GROUP BY 1, 2) GROUP BY 1) g ON b.band = g.band", s_bd=_BD))
def g08(spark, d):
    t = sv.targets(sv.labels(spark, d)).select(
        "group_id", vote_band(F.col("n")).alias("band"), target_entropy(fn.cols("q")).alias("h"),
        F.round(fn.disagreement(fn.cols("v")), 9).alias("dd"))
    # vote patterns give few distinct values: count them, then take weighted medians
    pat = t.groupBy("band", "h", "dd").agg(F.count(F.lit(1)).alias("f"))
    f = F.col("f")
    seen = F.when(F.col("dd").isNotNull(), f).otherwise(0)
    stats = pat.groupBy("band").agg(
        F.sum(f).alias("n_rows"), F.percentile("h", F.lit(0.5), f).alias("h_median"),
        (F.sum(F.col("h") * f) / F.sum(f)).alias("h_mean"), F.max("h").alias("h_max"),
        F.percentile("dd", F.lit(0.5), f).alias("d_median"),
        (F.sum(F.col("dd") * f) / F.nullif(F.sum(seen), F.lit(0))).alias("d_mean"), F.max("dd").alias("d_max"))
    per = gp.group_weighted(t, ["band"], "group_id", ["h", "dd"]).select(
        "band", "n_groups", F.col("group_h").alias("h_group"), F.col("group_dd").alias("d_group"))
    return stats.join(per, "band").withColumn(
        "d_status", F.when(F.col("d_mean").isNull(), "NOT_ESTIMABLE").otherwise("PASS"))


cte("s_cm0", "SELECT method, seed, y, yhat, count(*) AS n, count(DISTINCT group_id) AS n_groups FROM s_rows WHERE y >= 0 GROUP BY ALL")
cte("s_cm", "SELECT g.method, g.seed, g.y, g.yhat, coalesce(c.n, 0)::BIGINT AS n, coalesce(c.n_groups, 0)::BIGINT AS n_groups FROM"
    " (SELECT method, seed, a::BIGINT AS y, b::BIGINT AS yhat FROM (SELECT DISTINCT method, seed FROM s_cm0), (SELECT unnest(range(0,6)) AS a), (SELECT unnest(range(0,6)) AS b)) g"
    " LEFT JOIN s_cm0 c ON c.method=g.method AND c.seed=g.seed AND c.y=g.y AND c.yhat=g.yhat")
cte("s_pcl", "SELECT method, seed, class, max(total) AS total, sum(rowc)::DOUBLE AS support, sum(colc)::DOUBLE AS predicted, sum(tp)::DOUBLE AS tp FROM ("
    "SELECT method, seed, y AS class, n AS rowc, 0 AS colc, CASE WHEN y=yhat THEN n ELSE 0 END AS tp, sum(n) OVER (PARTITION BY method, seed) AS total FROM s_cm"
    " UNION ALL SELECT method, seed, yhat, 0, n, 0, 0 FROM s_cm) GROUP BY ALL")
cte("s_pcm", "SELECT *, tp/nullif(support,0) AS recall, tp/nullif(predicted,0) AS precision, 2.0*tp/nullif(support+predicted,0) AS f1,"
    " (total-support-predicted+tp)/nullif(total-support,0) AS specificity, support/total AS prevalence FROM s_pcl")


def _cm(spark, d):
    return hl.confusion(scored(spark, d), MS, "group_id")


@query("g09_confusion_matrix", sql(
    f"SELECT {G}, y, yhat, n, n_groups, {r('n/nullif(sum(n) OVER (PARTITION BY method, seed, y), 0)', 'row_share')} FROM s_cm"))
def g09(spark, d):
    return hl.row_normalised(_cm(spark, d), MS)


@query("g10_per_class_metrics", sql(
    f"SELECT {G}, class, {big('support', 'support')}, {big('predicted', 'predicted')}, {big('tp', 'tp')}, {big('total', 'total')}, "
    + ", ".join(r(c, c) for c in ("recall", "precision", "f1", "specificity", "prevalence")) + " FROM s_pcm"))
def g10(spark, d):
    return hl.per_class(_cm(spark, d), MS)


cte("s_hard", "SELECT method, seed, max(total)::BIGINT AS n_rows, sum(tp)/max(total) AS accuracy, avg(recall) AS balanced_accuracy, avg(precision) AS macro_precision,"
    " avg(f1) AS macro_f1, count(recall) AS n_recall, count(precision) AS n_precision, count(f1) AS n_f1,"
    " CASE WHEN (max(total)*max(total)-sum(support*support))*(max(total)*max(total)-sum(predicted*predicted)) > 0 THEN (sum(tp)*max(total)-sum(support*predicted))"
    "/sqrt((max(total)*max(total)-sum(support*support))::DOUBLE*(max(total)*max(total)-sum(predicted*predicted))) END AS mcc,"
    " (sum(tp)/max(total) - sum(support*predicted)/(max(total)::DOUBLE*max(total)))/nullif(1.0 - sum(support*predicted)/(max(total)::DOUBLE*max(total)), 0) AS kappa FROM s_pcm GROUP BY ALL")


@query("g11_hard_metrics", sql(
    f"SELECT {G}, n_rows, " + ", ".join(r(c, c) for c in ("accuracy", "balanced_accuracy", "macro_precision", "macro_f1"))
    + ", " + r("balanced_accuracy", "macro_recall") + ", n_recall, n_precision, n_f1, 'PASS' AS status FROM s_hard"))
def g11(spark, d):
    return hl.hard_summary(hl.per_class(_cm(spark, d), MS), MS).drop("mcc", "kappa")


@query("g12_multiclass_mcc", sql(f"SELECT {G}, {r('mcc', 'mcc')} FROM s_hard"))
def g12(spark, d):
    return hl.hard_summary(hl.per_class(_cm(spark, d), MS), MS).select(*MS, "mcc")


@query("g13_cohen_kappa", sql(f"SELECT {G}, {r('kappa', 'kappa')} FROM s_hard"))
def g13(spark, d):
    return hl.hard_summary(hl.per_class(_cm(spark, d), MS), MS).select(*MS, "kappa")


cte("s_dm", "SELECT method, seed, coalesce(band, 'overall') AS band, count(*) AS n_rows, count(d_obs) AS n_estimable, avg(d_obs) AS mean_observed,"
    " CASE WHEN count(d_obs) > 0 THEN avg(CASE WHEN d_obs IS NOT NULL THEN d_hat END) ELSE avg(d_hat) END AS mean_predicted,"
    " avg((d_hat-d_obs)*(d_hat-d_obs)) AS mse FROM s_rows GROUP BY GROUPING SETS ((method, seed), (method, seed, band))")


@query("g14_disagreement_by_band", sql(
    "SELECT m.method, m.seed::BIGINT AS seed, m.band, n_rows, n_estimable, " + ", ".join(r(c, c) for c in ("mean_observed", "mean_predicted", "mse", "spearman"))
    + ", CASE WHEN n_estimable > 0 THEN 'PASS' ELSE 'NOT_ESTIMABLE' END AS status FROM s_dm m LEFT JOIN s_spear s ON s.method=m.method AND s.seed=m.seed AND s.band=m.band"))
def g14(spark, d):
    s = scored(spark, d)
    seen = F.col("d_obs").isNotNull()
    gap = F.col("d_hat") - F.col("d_obs")
    base = s.select(*MS, "band", "d_hat", "d_obs").groupingSets(
        [[F.col("method"), F.col("seed")], [F.col("method"), F.col("seed"), F.col("band")]], "method", "seed", "band"
    ).agg(F.count(F.lit(1)).alias("n_rows"), F.count("d_obs").alias("n_estimable"), F.avg("d_obs").alias("mean_observed"),
          F.coalesce(F.avg(F.when(seen, F.col("d_hat"))), F.avg("d_hat")).alias("mean_predicted"),
          F.avg(gap * gap).alias("mse")).withColumn("band", F.coalesce("band", F.lit("overall")))
    both = disagreement_rows(spark, d).withColumn("band", F.explode(F.array(F.lit("overall"), F.col("band"))))
    rho = rk.spearman(both, [*MS, "band"], "d_hat", "d_obs")
    return base.join(rho, [*MS, "band"], "left").withColumn(
        "status", F.when(F.col("n_estimable") > 0, "PASS").otherwise("NOT_ESTIMABLE"))


@query("g15_kl_by_vote_stratum", sql(
    f"SELECT {G}, band, {r('avg(gk)', 'group_kl')}, {r('sum(sk)/sum(nr)', 'row_kl')}, {big('sum(nr)', 'n_rows')}, count(*) AS n_groups FROM ("
    "SELECT method, seed, band, group_id, avg(kl) AS gk, sum(kl) AS sk, count(*) AS nr FROM s_rows GROUP BY ALL) GROUP BY method, seed, band"))
def g15(spark, d):
    return gp.group_weighted(scored(spark, d), [*MS, "band"], "group_id", ["kl"], row_means=True)


_SOFT = ("kl", "ce", "sse", "brier")


@query("g16_evaluation_summary", sql(
    "SELECT b.method, b.seed::BIGINT AS seed, b.n_rows, n_groups, " + ", ".join(r(c, c) for c in (
        "group_kl", "row_kl", "row_ce", "row_sse", "row_brier", "gate_mean", "gate_std", "accuracy", "balanced_accuracy", "macro_f1", "mcc", "kappa", "ece"))
    + " FROM (SELECT method, seed, count(*) AS n_rows, avg(kl) AS row_kl, avg(ce) AS row_ce, avg(sse) AS row_sse, avg(brier) AS row_brier, avg(gate) AS gate_mean,"
    " stddev_samp(gate) AS gate_std FROM s_rows GROUP BY ALL) b JOIN (SELECT method, seed, avg(gkl) AS group_kl, count(*) AS n_groups FROM s_gm GROUP BY ALL) g"
    " ON g.method=b.method AND g.seed=b.seed JOIN s_hard h ON h.method=b.method AND h.seed=b.seed JOIN s_ece e ON e.method=b.method AND e.seed=b.seed"))
def g16(spark, d):
    keep = [*MS, "label_id", "group_id", "gate", "y", "yhat", *_SOFT, "confidence", "observed"]
    s = cut_lineage(cv.confidence_rows(scored(spark, d)).select(*keep))  # three summaries read the same rows
    soft = s.groupBy(*MS, "group_id").agg(
        F.count(F.lit(1)).alias("c"), *[F.sum(m).alias(m) for m in _SOFT], F.sum("gate").alias("g1"),
        F.sum(F.col("gate") * F.col("gate")).alias("g2"))
    n = F.sum("c")
    var = (F.sum("g2") - F.sum("g1") * F.sum("g1") / n) / F.nullif(n - 1, F.lit(0))
    base = soft.groupBy(*MS).agg(
        n.alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.avg(F.col("kl") / F.col("c")).alias("group_kl"),
        *[(F.sum(m) / n).alias(f"row_{m}") for m in _SOFT], (F.sum("g1") / n).alias("gate_mean"),
        F.sqrt(var).alias("gate_std"))
    hard = hl.hard_summary(hl.per_class(hl.confusion(s, MS), MS), MS).select(
        *MS, "accuracy", "balanced_accuracy", "macro_f1", "mcc", "kappa")
    binned = cv.equal_count_bins(s.select(*MS, "label_id", "confidence", "observed"), MS, "confidence", "label_id", 10)
    e = cv.ece(cv.bin_table(binned, MS), MS).select(*MS, "ece")
    return base.join(hard, MS).join(e, MS)


@query("g17_per_group_losses", sql(
    f"SELECT method, group_id, {r('avg(gkl)', 'kl')}, count(*) AS n_seeds FROM s_gm GROUP BY 1, 2"))
def g17(spark, d):
    per = gp.group_means(scored(spark, d), MS, "group_id", ["kl"])
    return per.groupBy("method", "group_id").agg(F.avg("kl").alias("kl"), F.count(F.lit(1)).alias("n_seeds"))


# temperature effect -------------------------------------------------------------------------
cte("s_te0", "SELECT method, seed, group_id, " + klist("q#") + ", " + klist("c#") + ", kl, sse, brier, " + klist("exp((ln(c#) - ln(greatest(c0,c1,c2,c3,c4,c5)))/1.5::DOUBLE) AS e#") + " FROM s_rows")
cte("s_te1", "SELECT *, " + klist("greatest(e#/(e0+e1+e2+e3+e4+e5), 1e-7::DOUBLE) AS z#") + " FROM s_te0")
cte("s_te2", "SELECT *, " + klist("z#/(z0+z1+z2+z3+z4+z5) AS t#") + " FROM s_te1")
cte("s_te3", f"SELECT method, seed, group_id, kl AS kl_before, {kl('q', 't')} AS kl_after, sse AS sse_before, {ksum('(t#-q#)*(t#-q#)')} AS sse_after,"
    f" brier AS brier_before, 1.0 - 2.0*{ksum('q#*t#')} + {ksum('t#*t#')} AS brier_after FROM s_te2")
_TE = [f"{m}_{w}" for m in ("kl", "sse", "brier") for w in ("before", "after")]


def tempered(s, t):
    """Rows with the same metrics at a temperature next to the raw ones."""
    s = s.withColumns({f"t{k}": x for k, x in enumerate(fn.temper(fn.cols("c"), t))})
    return s.withColumns({f"t{k}": x for k, x in enumerate(fn.clip_renorm(fn.cols("t")))})


@query("g18_temperature_effect", sql(
    f"SELECT {G}, " + ", ".join(r(f"avg(g_{c})", f"group_{c}") for c in _TE) + ", " + ", ".join(r(f"sum(r_{c})/sum(nr)", f"row_{c}") for c in _TE)
    + ", " + big("sum(nr)", "n_rows") + ", count(*) AS n_groups FROM (SELECT method, seed, group_id, count(*) AS nr, "
    + ", ".join(f"avg({c}) AS g_{c}, sum({c}) AS r_{c}" for c in _TE) + " FROM s_te3 GROUP BY ALL) GROUP BY method, seed"))
def g18(spark, d):
    s = tempered(scored(spark, d), 1.5)
    q, t = fn.cols("q"), fn.cols("t")
    s = s.select(*MS, "group_id", F.col("kl").alias("kl_before"), fn.kl(q, t).alias("kl_after"),
                 F.col("sse").alias("sse_before"), fn.squared_error(q, t).alias("sse_after"),
                 F.col("brier").alias("brier_before"), fn.expected_brier(q, t).alias("brier_after"))
    return gp.group_weighted(s, MS, "group_id", _TE, row_means=True)


@query("g19_seed_summary", sql(
    f"SELECT method, {r('avg(k)', 'kl_mean')}, {r('stddev_samp(k)', 'kl_sd')}, count(*) AS n_seeds FROM (SELECT method, seed, avg(gkl) AS k FROM s_gm GROUP BY 1, 2) GROUP BY 1"))
def g19(spark, d):
    per = gp.group_weighted(scored(spark, d), MS, "group_id", ["kl"]).withColumnRenamed("group_kl", "kl")
    return gp.seed_summary(per, ["method"], "kl")


# run tables -----------------------------------------------------------------------------------
@query("g20_ledger_totals", sql(
    f"SELECT coalesce(stage, 'total') AS stage, {r('sum(hours)', 'hours')}, count(*) AS n_jobs, sum((status <> 'PASS')::INT)::BIGINT AS n_not_pass,"
    f" {r('CASE WHEN stage IS NULL THEN 1000.0 - sum(hours) END', 'remaining')} FROM s_runs GROUP BY ROLLUP (stage)"))
def g20(spark, d):
    t = sv.runs(spark, d).rollup("stage").agg(
        F.sum("hours").alias("hours"), F.count(F.lit(1)).alias("n_jobs"), F.count_if(F.col("status") != "PASS").alias("n_not_pass"))
    return t.withColumn("remaining", F.when(F.col("stage").isNull(), 1000.0 - F.col("hours"))).withColumn(
        "stage", F.coalesce("stage", F.lit("total")))


@query("g21_configuration_table", sql(
    f"SELECT config, epochs, {r('avg(tune_kl)', 'kl_mean')}, {r('min(tune_kl)', 'kl_min')}, {r('max(tune_kl)', 'kl_max')}, count(DISTINCT seed_no) AS n_seeds FROM s_runs"
    " WHERE status = 'PASS' AND tune_kl IS NOT NULL GROUP BY 1, 2"))
def g21(spark, d):
    ok = sv.runs(spark, d).where((F.col("status") == "PASS") & F.col("tune_kl").isNotNull())
    return ok.groupBy("config", "epochs").agg(F.avg("tune_kl").alias("kl_mean"), F.min("tune_kl").alias("kl_min"),
                                              F.max("tune_kl").alias("kl_max"), F.count_distinct("seed_no").alias("n_seeds"))


_SWEEP = "s_runs WHERE status = 'PASS' AND fraction = 1.0"


@query("g22_byte_sweep", sql(
    f"SELECT a.encoding, a.bins, {r('mean', 'mean')}, {r('sd', 'sd')}, n, bytes, {r('mean_delta', 'mean_delta')}, {r('sd_delta', 'sd_delta')}, n_pairs FROM ("
    f"SELECT encoding, bins, avg(tune_kl) AS mean, stddev_samp(tune_kl) AS sd, count(tune_kl) AS n, min(4*64*bins*2 + 4*64*bins//8)::BIGINT AS bytes FROM {_SWEEP} GROUP BY 1, 2) a JOIN ("
    "SELECT bins, avg(va-vb) AS mean_delta, stddev_samp(va-vb) AS sd_delta, count(*) AS n_pairs FROM (SELECT bins, seed_no, avg(CASE WHEN encoding='foveated' THEN tune_kl END) AS va,"
    f" avg(CASE WHEN encoding='uniform' THEN tune_kl END) AS vb FROM {_SWEEP} GROUP BY 1, 2) WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY 1) p ON a.bins = p.bins"))
def g22(spark, d):
    t = sv.runs(spark, d).where((F.col("status") == "PASS") & (F.col("fraction") == 1.0))
    size = 4 * 64 * F.col("bins") * 2 + F.floor(4 * 64 * F.col("bins") / 8)
    a = rn.mean_sd(t, ["encoding", "bins"], "tune_kl", F.min(size).alias("bytes"))
    p = rn.paired_contrast(t, F.col("encoding") == "foveated", F.col("encoding") == "uniform", ["seed_no"], "tune_kl", ["bins"])
    return a.join(p, "bins")


@query("g23_learning_curve", sql(
    f"SELECT config, fraction, {r('mean', 'mean')}, {r('sd', 'sd')}, n, {r('regr_slope(mean, log2(fraction*1000.0)) OVER (PARTITION BY config)', 'slope')} FROM ("
    "SELECT config, fraction, avg(tune_kl) AS mean, stddev_samp(tune_kl) AS sd, count(tune_kl) AS n FROM s_runs WHERE status='PASS' GROUP BY 1, 2)"))
def g23(spark, d):
    t = sv.runs(spark, d).where(F.col("status") == "PASS")
    lc = rn.mean_sd(t, ["config", "fraction"], "tune_kl")
    slope = lc.groupBy("config").agg(F.regr_slope("mean", F.log2(F.col("fraction") * 1000.0)).alias("slope"))
    return lc.join(slope, "config")


@query("g24_multiseed_ablation", sql(
    f"SELECT config, min(params) AS params, {r('avg(k)', 'mean')}, {r('stddev_samp(k)', 'sd')}, count(k) AS n, {r('min(k)', 'best')} FROM ("
    "SELECT config, seed_no, arg_max(tune_kl, run_id) AS k, any_value(params) AS params FROM s_runs WHERE status='PASS' AND epochs = 2 GROUP BY 1, 2) GROUP BY 1"))
def g24(spark, d):
    """Reruns of a (config, seed) are reduced to the latest first, so every seed counts once."""
    t = sv.runs(spark, d).where((F.col("status") == "PASS") & (F.col("epochs") == 2))
    last = rn.latest_per_key(t.select("config", "seed_no", "run_id", "tune_kl", "params"), ["config", "seed_no"], ["run_id"])
    return rn.mean_sd(last, ["config"], "tune_kl", F.min("params").alias("params"), F.min("tune_kl").alias("best"))


cte("s_dh", "SELECT method, seed, group_id, label_id, kl, ent, d_hat, row_number() OVER (PARTITION BY method, seed ORDER BY d_hat, label_id) AS rnk,"
    " count(*) OVER (PARTITION BY method, seed) AS nn, sum(kl) OVER (PARTITION BY method, seed ORDER BY d_hat, label_id ROWS UNBOUNDED PRECEDING) AS ck FROM s_rows")
cte("s_dhc", "SELECT method, seed, bucket, coverage, ck/rnk AS risk FROM s_dh CROSS JOIN s_grid WHERE rnk = greatest(1, least(round_even(coverage*nn, 0), nn))::BIGINT")
cte("s_dha", "SELECT method, seed, sum(a) AS aurc_d FROM (SELECT method, seed, (coverage - lag(coverage) OVER w)*(risk + lag(risk) OVER w)/2.0 AS a FROM s_dhc WINDOW w AS (PARTITION BY method, seed ORDER BY bucket)) GROUP BY ALL")


@query("g25_vote_head_comparison", sql(
    "SELECT s.method, " + r("avg(k)", "kl_mean") + ", " + r("stddev_samp(k)", "kl_sd") + ", " + r("avg(spearman)", "spearman_mean") + ", " + r("avg(mse)", "mse_mean") + ", "
    + r("avg(aurc)", "aurc_entropy") + ", " + r("avg(aurc_d)", "aurc_d_hat") + " FROM (SELECT method, seed, avg(gkl) AS k FROM s_gm GROUP BY 1, 2) s"
    " JOIN (SELECT * FROM s_spear WHERE band='overall') p ON p.method=s.method AND p.seed=s.seed JOIN (SELECT * FROM s_dm WHERE band='overall') m ON m.method=s.method AND m.seed=s.seed"
    " JOIN s_aurc a ON a.method=s.method AND a.seed=s.seed JOIN s_dha h ON h.method=s.method AND h.seed=s.seed GROUP BY 1"))
def g25(spark, d):
    votes = stored(sv.labels(spark, d).select("label_id", "group_id", "n", *[f"v{k}" for k in range(6)]), "votes")
    s = score_rows(sv.predictions_of(sv.spread(votes))).select(*MS, "label_id", "group_id", "kl", "ent", "d_hat", "d_obs")
    gap = F.col("d_hat") - F.col("d_obs")
    k = gp.group_weighted(s.withColumn("mse", gap * gap), MS, "group_id", ["kl", "mse"], row_means=True)
    seen = s.where(F.col("d_obs").isNotNull()).withColumn("d_obs", F.round("d_obs", 9))
    rho = rk.spearman(seen, MS, "d_hat", "d_obs")
    long = s.select(*MS, "label_id", "kl", F.explode(F.array(
        F.struct(F.lit("aurc_entropy").alias("nm"), F.col("ent").alias("score")),
        F.struct(F.lit("aurc_d_hat").alias("nm"), F.col("d_hat").alias("score")))).alias("z")).select(
        *MS, "label_id", "kl", "z.nm", "z.score")
    area = cv.aurc(cv.risk_coverage_of_cuts(long, [*MS, "nm"], "score", "kl", "label_id"), [*MS, "nm"])
    wide = area.groupBy(*MS).pivot("nm", ["aurc_entropy", "aurc_d_hat"]).agg(F.first("aurc"))
    j = k.join(rho, MS).join(wide, MS)
    return j.groupBy("method").agg(
        F.avg("group_kl").alias("kl_mean"), F.stddev_samp("group_kl").alias("kl_sd"), F.avg("spearman").alias("spearman_mean"),
        F.avg("row_mse").alias("mse_mean"), F.avg("aurc_entropy").alias("aurc_entropy"), F.avg("aurc_d_hat").alias("aurc_d_hat"))


@query("g26_gate_quantiles", sql(
    f"SELECT {G}, {r('avg(gate)', 'mean')}, {r('stddev_pop(gate)', 'sd')}, " + ", ".join(
        r(f"quantile_cont(gate, {p}::DOUBLE)", f"q{int(p * 100):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM s_pred WHERE \"partition\"='test' GROUP BY method, seed"))
def g26(spark, d):
    p = sv.predictions(spark, d, ("test",)).select(*MS, "gate")
    qs = (0.05, 0.25, 0.5, 0.75, 0.95)
    q = rk.exact_quantiles(p, MS, "gate", qs)
    wide = q.groupBy(*MS).agg(*[F.max(F.when(F.col("prob") == x, F.col("quantile"))).alias(f"q{int(x * 100):02d}") for x in qs])
    return p.groupBy(*MS).agg(F.avg("gate").alias("mean"), F.stddev_pop("gate").alias("sd")).join(wide, MS)


@query("g27_entropy_tertiles", sql(f"SELECT {r('t1', 't1')}, {r('t2', 't2')} FROM s_tert"))
def g27(spark, d):
    return tertiles(spark, d)


def _share(cond):
    return F.avg(cond.cast("int"))


@query("g28_missingness_audit", sql(
    "SELECT \"partition\", count(*) AS n_rows, count(DISTINCT group_id) AS n_groups, " + ", ".join(
        f"{r(f'avg({v}_valid)', f'{v}_mean')}, {r(f'avg(({v}_valid >= 1.0)::INT)', f'{v}_full')}, {r(f'avg(({v}_valid < 0.95)::INT)', f'{v}_low')}, sum(({v}_valid = 0)::INT)::BIGINT AS {v}_none"
        for v in ("local", "context")) + ", sum((local_valid = 0 AND context_valid = 0)::INT)::BIGINT AS both_none FROM s_labels GROUP BY 1"))
def g28(spark, d):
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct("group_id").alias("n_groups")]
    for v in ("local", "context"):
        c = F.col(f"{v}_valid")
        aggs += [F.avg(c).alias(f"{v}_mean"), _share(c >= 1.0).alias(f"{v}_full"), _share(c < 0.95).alias(f"{v}_low"),
                 F.count_if(c == 0).alias(f"{v}_none")]
    aggs.append(F.count_if((F.col("local_valid") == 0) & (F.col("context_valid") == 0)).alias("both_none"))
    return sv.labels(spark, d).groupBy("partition").agg(*aggs)


@query("g29_cohort_flow", sql(
    "SELECT stage, n_rows, n_groups, (SELECT count(*) FROM s_labels) = (SELECT count(*) FROM s_labels WHERE NOT (local_valid=0 AND context_valid=0)) + (SELECT count(*) FROM s_labels WHERE local_valid=0 AND context_valid=0) AS reconciles FROM ("
    "SELECT '1 source' AS stage, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups FROM s_labels UNION ALL SELECT '2 quarantined', count(*), count(DISTINCT group_id) FROM s_labels WHERE local_valid=0 AND context_valid=0"
    " UNION ALL SELECT '3 eligible ' || \"partition\", count(*), count(DISTINCT group_id) FROM s_labels WHERE NOT (local_valid=0 AND context_valid=0) GROUP BY \"partition\")"))
def g29(spark, d):
    return sp.cohort_flow(sv.labels(spark, d), "group_id")


@query("g30_strata_reconciliation", sql(
    "SELECT family, count(DISTINCT stratum) AS n_strata, count(*) AS n_rows, count(*) = (SELECT count(*) FROM s_labels) AS reconciles FROM (SELECT stratum, split_part(stratum, ':', 1) AS family FROM ("
    "SELECT " + STRATA_SQL + " AS stratum FROM s_h CROSS JOIN s_tert)) GROUP BY 1"))
def g30(spark, d):
    t = sv.targets(sv.labels(spark, d)).withColumn("y", fn.unique_majority(fn.cols("v")))
    q = tertiles(spark, d)
    s = strata_rows(t, q.select("t1").scalar(), q.select("t2").scalar(), F.least("local_valid", "context_valid"))
    per = s.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    total = t.agg(F.count(F.lit(1))).scalar()
    return per.groupBy(F.split_part("stratum", F.lit(":"), F.lit(1)).alias("family")).agg(
        F.count(F.lit(1)).alias("n_strata"), F.sum("n").alias("n_rows")).withColumn("reconciles", F.col("n_rows") == total)


# perturbed predictions: the gate of each row moves its heads ------------------------------------
cte("s_cond", "SELECT label_id, group_id, \"partition\", " + klist("q#") + f", {majority('v')} AS y, unnest(['clean','local_removed','context_removed']) AS condition, unnest([gate, 1.0::DOUBLE, 0.0::DOUBLE]) AS g, " + klist("l#") + ", " + klist("x#") + " FROM s_heads")
cte("s_cond2", "SELECT *, " + klist("(1.0-g)*l# + g*x# AS m#") + " FROM s_cond")
cte("s_cond3", f"SELECT *, {kl('q', 'm')} AS kl, {first_argmax('m')} AS top FROM s_cond2")
cte("s_pair", "SELECT a.condition, a.label_id, a.group_id, a.\"partition\", a.kl, a.kl - c.kl AS dkl, (a.top <> c.top)::INT AS flip, a.y, a.top, sqrt(greatest(" + ksum(
    "(0.5::DOUBLE*a.m#*(ln(a.m#)-ln((a.m#+c.m#)*0.5::DOUBLE)) + 0.5::DOUBLE*c.m#*(ln(c.m#)-ln((a.m#+c.m#)*0.5::DOUBLE)))") + ", 0.0)) AS js"
    " FROM s_cond3 a JOIN s_cond3 c ON a.label_id = c.label_id WHERE c.condition = 'clean'")


def conditions(spark, d):
    """Clean rows and two forced-view conditions, with each row's change against clean.

    The clean prediction is carried next to the perturbed one before the conditions fan out, so
    comparing them needs no join.
    """
    h = sv.heads(spark, d).withColumn("y", fn.unique_majority(fn.cols("v")))
    clean = fn.mix_views(fn.cols("l"), fn.cols("x"), F.col("gate"))
    h = h.withColumns({f"b{k}": c for k, c in enumerate(clean)})
    gates = F.array(*[F.struct(F.lit(nm).alias("condition"), g.alias("g")) for nm, g in (
        ("clean", F.col("gate")), ("local_removed", fn.routed_gate(F.col("gate"), F.lit(1.0), F.lit(1.0), "context")),
        ("context_removed", fn.routed_gate(F.col("gate"), F.lit(1.0), F.lit(1.0), "local")))])
    f = h.withColumn("z", F.explode(gates)).withColumns({"condition": F.col("z.condition"), "g": F.col("z.g")})
    f = f.withColumns({f"m{k}": c for k, c in enumerate(fn.mix_views(fn.cols("l"), fn.cols("x"), F.col("g")))})
    q, m, b = fn.cols("q"), fn.cols("m"), fn.cols("b")
    return f.withColumns({
        "kl": fn.kl(q, m), "kl0": fn.kl(q, b), "top": fn.first_argmax(m),
        "flip": (fn.first_argmax(m) != fn.first_argmax(b)).cast("int"), "js": fn.js_distance(m, b)}).withColumn(
        "dkl", F.col("kl") - F.col("kl0"))


@query("g31_robustness_table", sql(
    f"SELECT condition, {r('avg(gk)', 'group_kl')}, {r('avg(gd)', 'group_dkl')}, {r('sum(fl)/sum(nr)', 'flip_share')}, {r('sum(sj)/sum(nr)', 'js_mean')}, {r('sum(er)/sum(ny)', 'majority_error')}, {big('sum(nr)', 'n_rows')} FROM ("
    "SELECT condition, group_id, avg(kl) AS gk, avg(dkl) AS gd, sum(flip) AS fl, sum(js) AS sj, count(*) AS nr, sum((y >= 0 AND y <> top)::INT) AS er, sum((y >= 0)::INT) AS ny FROM s_pair GROUP BY 1, 2) GROUP BY 1"))
def g31(spark, d):
    c = conditions(spark, d)
    hard = F.col("y") >= 0
    per = c.groupBy("condition", "group_id").agg(
        F.avg("kl").alias("gk"), F.avg("dkl").alias("gd"), F.sum("flip").alias("fl"), F.sum("js").alias("sj"),
        F.count(F.lit(1)).alias("nr"), F.count_if(hard & (F.col("y") != F.col("top"))).alias("er"), F.count_if(hard).alias("ny"))
    n = F.sum("nr")
    return per.groupBy("condition").agg(
        F.avg("gk").alias("group_kl"), F.avg("gd").alias("group_dkl"), (F.sum("fl") / n).alias("flip_share"),
        (F.sum("sj") / n).alias("js_mean"), (F.sum("er") / F.sum("ny")).alias("majority_error"), n.alias("n_rows"))


@query("g31_robustness_intervals")
def g31_intervals(spark, d):
    """Paired change of every condition with its interval; conditions share the draws of the groups."""
    from ..operators import resample as rs

    per = conditions(spark, d).groupBy("condition", "group_id").agg(F.avg("dkl").alias("gd"))
    return rs.group_mean_bootstrap(per, ["condition"], "group_id", "gd")


@query("g32_development_table", sql(
    f"SELECT r.run_id, r.config, r.seed_no, r.status, r.epochs, r.params, {r('r.tune_kl', 'tune_kl')}, e.best_epoch, {r('e.best_loss', 'best_loss')}, e.examples_seen FROM s_runs r LEFT JOIN ("
    "SELECT run_id, arg_min(epoch, (loss, epoch)) AS best_epoch, min(loss) AS best_loss, sum(examples)::BIGINT AS examples_seen FROM s_revents GROUP BY 1) e ON r.run_id = e.run_id ORDER BY config, seed_no, r.run_id"))
def g32(spark, d):
    e = sv.run_events(spark, d).groupBy("run_id").agg(
        F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"), F.min("loss").alias("best_loss"),
        F.sum("examples").alias("examples_seen"))
    t = sv.runs(spark, d).select("run_id", "config", "seed_no", "status", "epochs", "params", "tune_kl")
    return t.join(e, "run_id", "left").orderBy("config", "seed_no", "run_id")


@query("g33_cost_quality", sql(
    f"SELECT a.method, {r('k', 'group_kl')}, {r('median_v', 'latency_median')}, {r('p95', 'latency_p95')} FROM (SELECT method, avg(gkl) AS k FROM s_gm GROUP BY 1) a JOIN ("
    "SELECT 'm' || (1 + user_id % 3)::VARCHAR AS method, quantile_cont(value, 0.5::DOUBLE) AS median_v, quantile_cont(value, 0.95::DOUBLE) AS p95 FROM events GROUP BY 1) b ON a.method = b.method"))
def g33(spark, d):
    per = gp.group_weighted(scored(spark, d), MS, "group_id", ["kl"])
    k = per.groupBy("method").agg((F.sum(F.col("group_kl") * F.col("n_groups")) / F.sum("n_groups")).alias("group_kl"))
    lat = table(spark, d, "events").select(
        F.concat(F.lit("m"), F.pmod(F.col("user_id"), F.lit(3)) + 1).alias("method"), "value")
    q = rk.exact_quantiles(lat, ["method"], "value", (0.5, 0.95)).groupBy("method").agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("latency_median"),
        F.max(F.when(F.col("prob") == 0.95, F.col("quantile"))).alias("latency_p95"))
    return k.join(q, "method")


@query("g33_cost_quality_intervals")
def g33_intervals(spark, d):
    """Loss of every method with its interval next to its parameter count, that of the runs that stand for the method."""
    from ..operators import resample as rs

    per = gp.group_means(scored(spark, d), ["method"], "group_id", ["kl"])
    ci = rs.group_mean_bootstrap(per, ["method"], "group_id", "kl").select("method", "point", "ci_low", "ci_high", "n_groups", "n_replicates")
    params = sv.runs(spark, d).select(F.concat(F.lit("m"), F.pmod(F.col("params"), F.lit(3)) + 1).alias("method"), "params")
    return ci.join(params.groupBy("method").agg(F.min("params").alias("n_parameters")), "method", "left")


@query("g34_class_feasibility", sql(
    "SELECT \"partition\", class, sum((yy = class)::INT)::BIGINT AS pos_rows, sum((yy <> class)::INT)::BIGINT AS neg_rows, count(DISTINCT CASE WHEN yy = class THEN group_id END) AS pos_groups,"
    " count(DISTINCT CASE WHEN yy <> class THEN group_id END) AS neg_groups, least(count(DISTINCT CASE WHEN yy = class THEN group_id END), count(DISTINCT CASE WHEN yy <> class THEN group_id END)) < 30 AS low_support"
    " FROM s_pc WHERE yy >= 0 GROUP BY 1, 2", s_pc=_PC))
def g34(spark, d):
    t = sv.labels(spark, d).withColumn("y", fn.unique_majority(fn.cols("v"))).where(F.col("y") >= 0)
    # one row per (partition, group, class of the row); classes expand after that reduction
    per = t.groupBy("partition", "group_id", "y").agg(F.count(F.lit(1)).alias("c"))
    ex = per.withColumn("class", F.explode(F.array(*[F.lit(k).cast("bigint") for k in range(6)])))
    pos = F.col("y") == F.col("class")
    out = ex.groupBy("partition", "class").agg(
        F.sum(F.when(pos, F.col("c")).otherwise(0)).alias("pos_rows"), F.sum(F.when(~pos, F.col("c")).otherwise(0)).alias("neg_rows"),
        F.count_distinct(F.when(pos, F.col("group_id"))).alias("pos_groups"),
        F.count_distinct(F.when(~pos, F.col("group_id"))).alias("neg_groups"))
    return out.withColumn("low_support", F.least("pos_groups", "neg_groups") < 30)


