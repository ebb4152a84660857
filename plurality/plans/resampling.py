"""Resampling inference queries (I), reliability intervals (H05), statistic callback."""

from pyspark.sql import functions as F

from ..operators import curves as cv
from ..operators import groups as gp
from ..operators import resample as rs
from ..operators.scoring import strata_rows
from ..session import cut_lineage, stored
from ..sources import standins as sv
from .gates import tertiles
from .registry import query
from .sqlkit import cte, md5i, r, sql
from .views import scored

MS = ["method", "seed"]
R_TINY = 8  # of the rank statistics, which list their draws


def draw_sql(n_rep: int, group_count: str, src: str = "", keys: str = "") -> str:
    """Replicate draws: (keys, r, gi); ``group_count`` is a column or scalar expression."""
    h = md5i("'20260907'", "r::VARCHAR", "j::VARCHAR")
    return (f"SELECT {keys}{', ' if keys else ''}r, ({h}) % ng AS gi FROM (SELECT {keys}{', ' if keys else ''}r, ng, unnest(range(0, ng)) AS j FROM "
            f"(SELECT {keys}{', ' if keys else ''}{group_count} AS ng {src}), (SELECT unnest(range(0, {n_rep})) AS r))")


_CI = ("quantile_cont(value, 0.025::DOUBLE) AS ci_low, quantile_cont(value, 0.975::DOUBLE) AS ci_high, avg(value) AS boot_mean,"
       " stddev_samp(value) AS boot_sd, count(*) - count(value) AS n_dropped, count(*) AS n_replicates")
CI = ["ci_low", "ci_high", "boot_mean", "boot_sd"]


def _deltas(spark, d, a="m1", b="m2", **kw):
    s = scored(spark, d, methods=tuple(m for m in sv.METHODS if m[0] in (a, b)), **kw)
    return rs.paired_differences(s, [], "group_id", "seed", "kl", F.col("method") == a, F.col("method") == b)


def _paired_cols(extra=()):
    return [*extra, "point", "n_groups", *CI, "n_dropped", "n_replicates", "mean_a", "mean_b", "relative_effect",
            "decision", "wholly_below_zero", "crosses_zero"]


@query("i01_paired_cluster_bootstrap")
def i01(spark, d):
    return rs.paired_bootstrap(_deltas(spark, d), [], "group_id").select(*_paired_cols())


def ratio(a, b):
    """A statistic of sums, null where nothing is left to divide by."""
    return lambda: F.when(F.col(b) > 0, F.col(a) / F.col(b))


@query("i02_cluster_bootstrap_statistic")
def i02(spark, d):
    """Accuracy of every method and seed."""
    s = scored(spark, d).where(F.col("y") >= 0)
    per = s.groupBy(*MS, "group_id").agg(F.sum((F.col("y") == F.col("yhat")).cast("int")).alias("hits"), F.count(F.lit(1)).alias("c"))
    return rs.bootstrap_statistic(per, MS, "group_id", ["hits", "c"], ratio("hits", "c"))


@query("i03_group_mean_ci")
def i03(spark, d):
    per = gp.group_means(scored(spark, d), MS, "group_id", ["kl"]).drop("rows_in_group")
    return rs.group_mean_bootstrap(per, MS, "group_id", "kl")


@query("i04_paired_primary_decision")
def i04(spark, d):
    """Both contrasts out of one pass over per-(method, seed, group) losses."""
    per = gp.group_means(scored(spark, d), MS, "group_id", ["kl"])
    side = F.array(
        F.when(F.col("method") == "m2", F.struct(F.lit("m2-m1").alias("contrast"), F.lit("a").alias("side"))),
        F.when(F.col("method") == "m1", F.struct(F.lit("m2-m1").alias("contrast"), F.lit("b").alias("side"))),
        F.when(F.col("method") == "m1", F.struct(F.lit("m1-m3").alias("contrast"), F.lit("a").alias("side"))),
        F.when(F.col("method") == "m3", F.struct(F.lit("m1-m3").alias("contrast"), F.lit("b").alias("side"))))
    ex = per.select("group_id", "seed", "kl", F.explode(F.filter(side, lambda x: x.isNotNull())).alias("z")).select(
        "group_id", "seed", "kl", "z.contrast", "z.side")
    dl = rs.paired_differences(ex, ["contrast"], "group_id", "seed", "kl", F.col("side") == "a", F.col("side") == "b")
    return rs.paired_bootstrap(dl, ["contrast"], "group_id").select(*_paired_cols(["contrast"]))


@query("i05_strata_analysis")
def i05(spark, d):
    q = cut_lineage(tertiles(spark, d))  # one row, read for each of its columns
    s = scored(spark, d, methods=sv.METHODS[:2])
    # a label's rows share its strata: they are summed first, per method and seed, so that one row per label meets them
    own = ["label_id", "group_id", "n", "y", *[f"q{k}" for k in range(6)], "local_valid", "context_valid"]
    arms = [(f"{side}{i}", (F.col("method") == m) & (F.col("seed") == x)) for side, m in (("a", "m1"), ("b", "m2")) for i, x in enumerate(sv.SEEDS)]
    loss = [(name, F.when(arm, F.col("kl"))) for name, arm in arms]
    s = s.groupBy(*own).agg(*[F.sum(x).alias(f"s_{c}") for c, x in loss], *[F.count(x).alias(f"c_{c}") for c, x in loss], F.count_if(arms[0][1]).alias("nr"))
    st = strata_rows(s, q.select("t1").scalar(), q.select("t2").scalar(), F.least("local_valid", "context_valid"))
    sums = [f"{x}_{c}" for c, _ in arms for x in "sc"] + ["nr"]
    per = st.groupBy("stratum", "group_id").agg(*[F.sum(c).alias(c) for c in sums])

    def over_seeds(side):
        means = F.array(*[F.when(F.col(f"c_{side}{i}") > 0, F.col(f"s_{side}{i}") / F.col(f"c_{side}{i}")) for i in range(len(sv.SEEDS))])
        have = F.filter(means, lambda x: x.isNotNull())
        return F.when(F.size(have) > 0, F.aggregate(have, F.lit(0.0), lambda x, y: x + y) / F.size(have))

    dl = per.select("stratum", "group_id", over_seeds("a").alias("la"), over_seeds("b").alias("lb"), "nr").withColumn("delta", F.col("la") - F.col("lb"))
    dl = stored(dl, "strata")  # read for the points, both means, the rows and the replicates
    rows = dl.groupBy("stratum").agg(F.sum("nr").alias("n_rows"))
    b = rs.paired_bootstrap(dl, ["stratum"], "group_id", draws_of=rs.ListedDraws).join(rows, "stratum")
    ok = F.col("n_rows") >= 10
    return b.select("stratum", "n_rows", "n_groups", *[F.when(ok, F.col(c)).alias(c) for c in ("point", "ci_low", "ci_high", "mean_a", "mean_b")],
                    F.when(ok, "PASS").otherwise("NOT_ESTIMABLE").alias("status"), rs.low_support(F.col("n_groups")).alias("low_support"))


# ranking statistics under resampling -----------------------------------------------------------
def auroc_statistic(rows, keys, weights):
    """Weighted AUROC per class for each weight: multiplicities enter both the ranks and the counts."""
    sums = [(f"{m}_{i}", F.sum(F.col(w) * F.col(f"{m}_at"))) for i, w in enumerate(weights) for m in ("n", "pos")]
    c = rows.groupBy(*keys, "class", "score").agg(*[s.alias(a) for a, s in sums])
    return cv.auroc_many(c, keys, len(weights))


_OG = "SELECT class, score, group_id, (y = class)::INT AS pos FROM s_ovr WHERE method = 'm1' AND seed = 101"
_OGI = "SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS gi FROM (SELECT DISTINCT group_id FROM s_og)"
_OM = "SELECT r, group_id, count(*) AS m FROM s_dr JOIN s_ogi USING (gi) GROUP BY 1, 2"
_OW = "SELECT r, class, score, sum(m) AS n_at, sum(m*pos) AS pos_at FROM s_og JOIN s_om USING (group_id) GROUP BY 1, 2, 3 UNION ALL SELECT -1, class, score, count(*), sum(pos) FROM s_og GROUP BY 2, 3"
_OC = "SELECT *, sum(n_at) OVER w AS cn, sum(n_at) OVER (PARTITION BY r, class) AS an, sum(pos_at) OVER (PARTITION BY r, class) AS ap FROM s_ow WINDOW w AS (PARTITION BY r, class ORDER BY score DESC)"
_OA = "SELECT r, class, CASE WHEN max(ap) > 0 AND max(an) > max(ap) THEN (sum((an-cn+(n_at+1)/2.0::DOUBLE)*pos_at) - max(ap)*(max(ap)+1)/2.0)/(max(ap)::DOUBLE*(max(an)-max(ap))) END AS value FROM s_oc GROUP BY 1, 2"


@query("i06_auroc_interval", sql(
    "SELECT class, " + ", ".join(r(c, c) for c in ["point", *CI]) + ", n_dropped, n_replicates FROM (SELECT class, value AS point FROM s_oa WHERE r = -1) JOIN"
    f" (SELECT class, {_CI} FROM s_oa WHERE r >= 0 GROUP BY 1) USING (class)",
    s_og=_OG, s_ogi=_OGI, s_om=_OM, s_ow=_OW, s_oc=_OC, s_oa=_OA, s_dr=draw_sql(R_TINY, "count(*)", "FROM s_ogi")))
def i06(spark, d):
    c = cv.one_vs_rest(scored(spark, d, methods=sv.METHODS[:1], seeds=(101,)), ["group_id"])
    return rs.bootstrap_rows(c, [], "group_id", auroc_statistic, R_TINY)


@query("i06_recall_intervals")
def i06_recall(spark, d):
    """Recall of every class for every method and seed; the classes of a replicate share its draws."""
    s = scored(spark, d).where(F.col("y") >= 0)
    per = s.groupBy(*MS, F.col("y").alias("class"), "group_id").agg(F.sum((F.col("y") == F.col("yhat")).cast("int")).alias("hits"), F.count(F.lit(1)).alias("c"))
    return rs.bootstrap_statistic(per, MS, "group_id", ["hits", "c"], ratio("hits", "c"), within=["class"])


_I7G = "SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS gi FROM (SELECT DISTINCT group_id FROM s_i7)"
_I7 = "SELECT label_id, group_id, ent, kl FROM s_rows WHERE method='m1' AND seed=101"
_I7D = draw_sql(R_TINY, "count(*)", "FROM s_i7g").replace("SELECT r,", "SELECT r, j,", 1)
_I7R = "SELECT r, j, ent, kl, row_number() OVER (PARTITION BY r ORDER BY ent, label_id, j) AS rnk, count(*) OVER (PARTITION BY r) AS nn FROM (SELECT d.r, d.j, i.* FROM s_i7d d JOIN s_i7g USING (gi) JOIN s_i7 i USING (group_id) UNION ALL SELECT -1, group_id, i.* FROM s_i7 i)"
_I7C = ("SELECT r, bucket, avg(m) AS value FROM (SELECT r, bucket, j, avg(kl) AS m FROM s_i7r JOIN s_grid ON rnk <= greatest(1, least(round_even(coverage*nn, 0), nn))::BIGINT GROUP BY 1, 2, 3) GROUP BY 1, 2")


@query("i07_risk_curve_band", sql(
    "SELECT bucket, " + ", ".join(r(c, c) for c in ["point", *CI]) + ", n_dropped, n_replicates FROM (SELECT bucket, value AS point FROM s_i7c WHERE r = -1) JOIN"
    f" (SELECT bucket, {_CI} FROM s_i7c WHERE r >= 0 GROUP BY 1) USING (bucket)", s_i7=_I7, s_i7g=_I7G, s_i7d=_I7D, s_i7r=_I7R, s_i7c=_I7C))
def i07(spark, d):
    """A group drawn twice is two groups: its rows are copied once per draw."""
    s = scored(spark, d, methods=sv.METHODS[:1], seeds=(101,)).select("label_id", "group_id", "ent", "kl")
    m = rs.multiplicities(rs.group_index(s, [], "group_id"), [], "group_id", R_TINY).select("group_id", "replicate", "m")
    j = s.join(m, "group_id").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    j = j.select("replicate", F.struct("label_id", "copy").alias("k"), F.struct("group_id", "copy").alias("g"), "ent", "kl")
    reps = cv.risk_coverage(j, ["replicate"], "ent", "kl", "k", group="g")
    point = cv.risk_coverage(s, [], "ent", "kl", "label_id", group="group_id").select("bucket", F.col("group_risk").alias("point"))
    return point.join(rs.percentile_ci(reps, ["bucket"], "group_risk"), "bucket")


cte("s_tgm", "SELECT method, seed, group_id, avg(kl) AS gkl FROM s_rows WHERE \"partition\" = 'tune' GROUP BY ALL")
cte("s_tgd", "SELECT group_id, avg(CASE WHEN method='m1' THEN gkl END) - avg(CASE WHEN method='m2' THEN gkl END) AS delta FROM s_tgm GROUP BY 1")
_Z = "2.8015852181129688::DOUBLE"


@query("i08_minimum_detectable_effect", sql(
    "SELECT \"partition\", scenario, count(DISTINCT group_id) AS n_groups, " + r(f"{_Z}*scenario/sqrt(count(DISTINCT group_id))", "mde")
    + " FROM s_labels CROSS JOIN (SELECT unnest([0.1::DOUBLE, 0.2, 0.3]) AS scenario) GROUP BY 1, 2"))
def i08(spark, d):
    n = sv.labels(spark, d).groupBy("partition").agg(F.count_distinct("group_id").alias("n_groups"))
    s = n.withColumn("scenario", F.explode(F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3))))
    return s.withColumn("mde", rs.minimum_detectable_effect(F.col("scenario"), F.col("n_groups")))


@query("i09_paired_sd", sql(
    f"SELECT {r('avg(delta)', 'mean')}, {r('stddev_samp(delta)', 'sd')}, count(*) AS n_groups, {r(f'{_Z}*stddev_samp(delta)/sqrt(count(*))', 'mde')} FROM s_tgd"))
def i09(spark, d):
    dl = _deltas(spark, d, parts=("tune",))
    s = dl.agg(F.avg("delta").alias("mean"), F.stddev_samp("delta").alias("sd"), F.count(F.lit(1)).alias("n_groups"))
    return s.withColumn("mde", rs.minimum_detectable_effect(F.col("sd"), F.col("n_groups")))


# reliability with intervals ----------------------------------------------------------------------
@query("h05_reliability_intervals")
def h05(spark, d):
    """Observed frequency of every bin of every method and seed; the bins of a replicate share its draws."""
    rows = cv.confidence_rows(scored(spark, d)).select(*MS, "label_id", "group_id", "confidence", "observed")
    b = cv.equal_count_bins(rows, MS, "confidence", "label_id", 10)
    per = b.groupBy(*MS, "bin", "group_id").agg(F.sum("observed").alias("s"), F.count(F.lit(1)).alias("c"))
    return rs.bootstrap_statistic(per, MS, "group_id", ["s", "c"], ratio("s", "c"), within=["bin"])


@query("o01_user_statistic")
def o01(spark, d):
    """A caller's own statistic, here the root mean squared error, as an expression over sums."""
    per = scored(spark, d).groupBy(*MS, "group_id").agg(F.sum("sse").alias("s2"), F.count(F.lit(1)).alias("c"))
    return rs.bootstrap_statistic(per, MS, "group_id", ["s2", "c"], lambda: F.sqrt(F.col("s2") / F.nullif(F.col("c"), F.lit(0.0))))


