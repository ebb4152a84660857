"""Splitting, sampling and graph queries (J), completeness gate (N01), smoke subset."""

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import ranking as rk
from ..operators import splits as sp
from ..operators.scoring import target_entropy
from ..sources import standins as sv
from .registry import query
from .sqlkit import cte, klist, md5i, r, sql

SEED = 20260907

_E = "SELECT group_id*2 AS a, recording_id*2+1 AS b FROM s_links"
_EE = "SELECT a, b FROM s_e UNION SELECT b, a FROM s_e"
_RE = "SELECT DISTINCT a AS node, a AS root FROM s_ee UNION SELECT s_ee.b, s_re.root FROM s_re JOIN s_ee ON s_ee.a = s_re.node"
_CC = "SELECT node, min(root) AS root FROM s_re GROUP BY 1"
_REC = dict(s_e=_E, s_ee=_EE, s_re=_RE, s_cc=_CC)


def components(spark, d):
    e = sv.links(spark, d).select((F.col("group_id") * 2).alias("a"), (F.col("recording_id") * 2 + 1).alias("b"))
    return sp.connected_components(e, "a", "b")


@query("j01_connected_components", sql(
    "SELECT node, dense_rank() OVER (ORDER BY root) - 1 AS component FROM s_cc", recursive=True, **_REC))
def j01(spark, d):
    return sp.component_ids(components(spark, d))


_JL = "SELECT l.*, coalesce(c.root, l.group_id*2) AS component FROM s_labels l LEFT JOIN s_cc c ON c.node = l.group_id*2"
_JS = ("SELECT component, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups, " + klist("sum(v#)::DOUBLE/sum(n)*count(*) AS mass#") + " FROM s_jl GROUP BY 1")
_MX = "greatest(" + klist("round(mass#, 9)") + ")"
_JD = ("SELECT *, (CASE " + " ".join(f"WHEN round(mass{k}, 9) = {_MX} THEN {k}" for k in range(6)) + " END)::BIGINT AS stratum, "
       + md5i("'20260907'", "component::VARCHAR") + " AS draw FROM s_js")
_JA = ("SELECT component, n_rows, stratum, CASE WHEN mid < 0.6::DOUBLE THEN 'train' WHEN mid < 0.7::DOUBLE THEN 'tune' WHEN mid < 0.75::DOUBLE THEN 'calibration_t' WHEN mid < 0.8::DOUBLE THEN 'calibration_p' ELSE 'test' END AS \"partition\""
       " FROM (SELECT *, (sum(n_rows) OVER (PARTITION BY stratum ORDER BY draw, component ROWS UNBOUNDED PRECEDING) - n_rows/2.0::DOUBLE)/sum(n_rows) OVER (PARTITION BY stratum) AS mid FROM s_jd)")
_ALL = dict(_REC, s_jl=_JL, s_js=_JS, s_jd=_JD, s_ja=_JA)


def _with_component(spark, d):
    cc = components(spark, d).select((F.col("node") / 2).cast("bigint").alias("group_id"), "root",
                                     (F.pmod(F.col("node"), F.lit(2)) == 0).alias("is_group")).where("is_group").drop("is_group")
    t = sv.labels(spark, d).join(cc, "group_id", "left")
    return t.withColumn("component", F.coalesce("root", F.col("group_id") * 2)).drop("root")


@query("j02_stratified_split", sql("SELECT component, n_rows, stratum, \"partition\" FROM s_ja", recursive=True, **_ALL))
def j02(spark, d):
    return sp.stratified_allocation(sp.component_stats(_with_component(spark, d), "component", "group_id"), "component")


@query("j03_component_statistics", sql(
    "SELECT component, n_rows, n_groups, " + klist(r("mass#", "mass#")) + ", n_rows >= (SELECT quantile_cont(n_rows::DOUBLE, 0.95::DOUBLE) FROM s_js) AS large FROM s_js", recursive=True, **_ALL))
def j03(spark, d):
    from ..session import cut_lineage

    s = cut_lineage(sp.component_stats(_with_component(spark, d), "component", "group_id"))
    # component sizes are few distinct whole numbers: counted first
    q = s.groupBy("n_rows").agg(F.count(F.lit(1)).alias("f")).agg(F.percentile("n_rows", F.lit(0.95), F.col("f"))).scalar()
    return s.withColumn("large", F.col("n_rows") >= q)


@query("j04_split_digest", sql(
    "SELECT n, substr(sha256(concat_ws('|', n::VARCHAR, a::VARCHAR, b::VARCHAR)), 1, 16) AS digest FROM (SELECT count(*) AS n, sum("
    + md5i("'20260907'", "component::VARCHAR", "\"partition\"") + ")::BIGINT AS a, sum(" + md5i("'b'", "'20260907'", "component::VARCHAR", "\"partition\"") + ")::BIGINT AS b FROM s_ja)",
    recursive=True, **_ALL))
def j04(spark, d):
    return sp.assignment_digest(j02(spark, d), "component", "partition", SEED)


@query("j05_subsample_groups", sql(
    "SELECT label_id, group_id FROM s_labels WHERE group_id IN (SELECT group_id FROM (SELECT group_id, row_number() OVER (ORDER BY h, group_id) AS rk, count(*) OVER () AS g FROM (SELECT DISTINCT group_id, "
    + md5i("'20260907'", "group_id::VARCHAR") + " AS h FROM s_labels)) WHERE rk <= greatest(1, round_even(0.5::DOUBLE*g, 0)))"))
def j05(spark, d):
    return sp.subsample_groups(sv.labels(spark, d).select("label_id", "group_id"), "group_id", 0.5, SEED)


_T = "SELECT label_id, group_id, " + md5i("'20260907'", "label_id::VARCHAR") + " AS h FROM s_labels WHERE \"partition\" = 'test'"


@query("j06_even_subset", sql(
    "SELECT label_id, group_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY h, label_id) AS rk FROM s_t) WHERE rk <= greatest(1, 1024 // (SELECT count(DISTINCT group_id) FROM s_t))"
    " ORDER BY h, label_id LIMIT 1024", s_t=_T))
def j06(spark, d):
    t = sv.labels(spark, d).where(F.col("partition") == "test").select("label_id", "group_id")
    return sp.even_subset(t, "group_id", "label_id", 1024, 10, SEED)


@query("j07_balanced_cases", sql(
    "SELECT label_id, yy AS class, band FROM (SELECT *, row_number() OVER (PARTITION BY yy, band ORDER BY dr, label_id) AS rk FROM (SELECT label_id, yy, CASE WHEN h <= (SELECT median(h) FROM s_h WHERE yy >= 0) THEN 'low' ELSE 'high' END AS band, "
    + md5i("'20260907'", "label_id::VARCHAR") + " AS dr FROM s_h WHERE yy >= 0)) WHERE rk <= 4"))
def j07(spark, d):
    t = sv.targets(sv.labels(spark, d)).select("label_id", fn.unique_majority(fn.cols("v")).alias("class"),
                                              target_entropy(fn.cols("q")).alias("h")).where(F.col("class") >= 0)
    med = t.groupBy("h").agg(F.count(F.lit(1)).alias("f")).agg(F.percentile("h", F.lit(0.5), F.col("f"))).scalar()
    t = t.withColumn("band", F.when(F.col("h") <= med, "low").otherwise("high"))
    return sp.balanced_cases(t, ["class", "band"], "label_id", 4, SEED).select("label_id", "class", "band")


cte("s_smoke", "SELECT recording_id FROM (SELECT DISTINCT recording_id, " + md5i("'20260907'", "recording_id::VARCHAR") + " AS h FROM s_labels) ORDER BY h, recording_id LIMIT 20")


@query("a15_smoke_subset", sql(
    "SELECT label_id, recording_id, row_number() OVER (ORDER BY label_id) - 1 AS \"row\" FROM s_labels WHERE recording_id IN (SELECT recording_id FROM s_smoke)"))
def a15(spark, d):
    t = sv.labels(spark, d).select("label_id", "recording_id")
    keep = sp.hash_sample(t, "recording_id", 20, SEED)
    return rk.row_index(t.join(keep, "recording_id", "left_semi"), "label_id", 2048).drop("shard", "pos")


@query("n01_final_runs_gate", sql(
    "SELECT config, string_agg(s::VARCHAR, ',' ORDER BY s) AS seeds, CASE WHEN (SELECT count(*) FROM (SELECT group_id FROM s_labels GROUP BY 1 HAVING count(DISTINCT \"partition\") > 1)) > 0 THEN 'BLOCKED' WHEN string_agg(s::VARCHAR, ',' ORDER BY s) = '1,2,3' AND min(whole) THEN 'PASS' ELSE 'INCOMPLETE' END AS status FROM ("
    "SELECT config, seed_no AS s, bool_or(bins = 32) AS whole FROM s_runs WHERE status='PASS' AND epochs = 3 AND fraction = 1.0 GROUP BY 1, 2) GROUP BY 1"))
def n01(spark, d):
    from ..operators.runs import completeness_gate, leaked_members

    ok = sv.runs(spark, d).where((F.col("status") == "PASS") & (F.col("epochs") == 3) & (F.col("fraction") == 1.0))
    return completeness_gate(ok, "config", "seed_no", F.col("bins") == 32, (1, 2, 3), leaked_members(sv.labels(spark, d), ["group_id"]))
