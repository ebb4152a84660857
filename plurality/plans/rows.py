"""Scalar, array and math functions on one row (C), and the wide metric record."""

from pyspark.sql import functions as F

from .. import functions as fn
from ..constants import CACHE_CAP_BYTES, METADATA_BYTES
from ..operators.scoring import with_clipped
from ..sources import standins as sv
from .registry import query
from .sqlkit import first_argmax, klist, ksum, majority, r, sql
from .views import scored

_ID = "method, seed::BIGINT AS seed, label_id"


def _row(name, column, expr, src="s_rows"):
    @query(name, sql(f"SELECT {_ID}, {r(expr, column)} FROM {src}"))
    def _q(spark, d):
        return scored(spark, d).select("method", "seed", "label_id", column)


@query("c01_soft_targets", sql("SELECT label_id, " + klist(r("q#", "q#")) + " FROM s_q"))
def c01(spark, d):
    return sv.targets(sv.votes(spark, d)).select("label_id", *[f"q{k}" for k in range(6)])


@query("c02_clip_renormalise", sql(f"SELECT {_ID}, " + klist(r("c#", "c#")) + " FROM s_clip"))
def c02(spark, d):
    return with_clipped(sv.predictions(spark, d)).select("method", "seed", "label_id", *[f"c{k}" for k in range(6)])


_row("c03_kl_rows", "kl", "kl")
_row("c04_soft_cross_entropy", "ce", "ce")
_row("c05_soft_squared_error", "sse", "sse")
_row("c06_expected_brier", "brier", "brier")
_row("c09_predictive_entropy", "ent", "ent")
_row("c10_one_minus_max", "omx", "omx")


@query("c07_unique_majority", sql(f"SELECT label_id, {majority('v')} AS y, ({majority('v')} < 0) AS tied FROM s_labels"))
def c07(spark, d):
    y = fn.unique_majority(fn.cols("v"))
    return sv.votes(spark, d).select("label_id", y.alias("y"), (y < 0).alias("tied"))


@query("c08_pairwise_disagreement",
       sql("SELECT label_id, n, " + r("CASE WHEN n > 1 THEN 1.0 - " + ksum("v#*(v#-1)") + "::DOUBLE/(n*(n-1.0::DOUBLE)) END", "d_obs")
           + " FROM s_labels"))
def c08(spark, d):
    return sv.votes(spark, d).select("label_id", "n", fn.disagreement(fn.cols("v")).alias("d_obs"))


@query("c11_js_distance", sql(
    "SELECT label_id, " + r("sqrt(greatest(" + ksum(
        "(0.5::DOUBLE*l#*(ln(l#)-ln((l#+x#)*0.5::DOUBLE)) + 0.5::DOUBLE*x#*(ln(x#)-ln((l#+x#)*0.5::DOUBLE)))")
        + ", 0.0::DOUBLE))", "js_distance") + " FROM s_heads"))
def c11(spark, d):
    h = sv.heads(spark, d)
    a, b = fn.clip_renorm(fn.cols("l")), fn.clip_renorm(fn.cols("x"))
    h = h.withColumns({f"ca{k}": x for k, x in enumerate(a)} | {f"cb{k}": x for k, x in enumerate(b)})
    return h.select("label_id", fn.js_distance(fn.cols("ca"), fn.cols("cb")).alias("js_distance"))


@query("c12_js_divergence_views", sql(
    "SELECT label_id, " + r(ksum(
        "(0.5::DOUBLE*l#*(ln(l#)-ln((l#+x#)*0.5::DOUBLE)) + 0.5::DOUBLE*x#*(ln(x#)-ln((l#+x#)*0.5::DOUBLE)))"), "js")
    + " FROM s_heads"))
def c12(spark, d):
    return sv.heads(spark, d).select("label_id", fn.js_divergence(fn.cols("l"), fn.cols("x")).alias("js"))


@query("c13_target_entropy", sql(
    "SELECT label_id, " + r(ksum("(CASE WHEN q# > 0 THEN -q#*ln(q#) ELSE 0.0 END)"), "h") + " FROM s_q"))
def c13(spark, d):
    return sv.targets(sv.votes(spark, d)).select("label_id", fn.entropy(fn.cols("q")).alias("h"))


@query("c14_apply_temperature", sql(
    f"SELECT {_ID}, " + klist(r("e#/(e0+e1+e2+e3+e4+e5)", "t#")) + " FROM (SELECT *, "
    + klist("exp((ln(c#) - ln(greatest(c0,c1,c2,c3,c4,c5)))/1.5::DOUBLE) AS e#") + " FROM s_clip)"))
def c14(spark, d):
    p = with_clipped(sv.predictions(spark, d))
    t = fn.temper(fn.cols("c"), 1.5)
    return p.select("method", "seed", "label_id", *[x.alias(f"t{k}") for k, x in enumerate(t)])


_GATE = "CASE WHEN context_valid <= 0 THEN 0.0 WHEN local_valid <= 0 THEN 1.0 ELSE gate END"


@query("c15_two_view_mixture", sql(
    "SELECT label_id, g AS routed, " + klist(r("(1.0-g)*l# + g*x#", "m#")) + ", " + klist(r("l#", "only_local#"))
    + f" FROM (SELECT *, {r(_GATE, 'g')} FROM s_heads)"))
def c15(spark, d):
    h = sv.heads(spark, d).withColumn(
        "g", F.round(fn.routed_gate(F.col("gate"), F.col("local_valid"), F.col("context_valid")), 6))
    m = fn.mix_views(fn.cols("l"), fn.cols("x"), F.col("g"))
    forced = fn.mix_views(fn.cols("l"), fn.cols("x"), fn.routed_gate(F.col("gate"), F.col("local_valid"),
                                                                    F.col("context_valid"), force="local"))
    return h.select("label_id", F.col("g").alias("routed"), *[x.alias(f"m{k}") for k, x in enumerate(m)],
                    *[x.alias(f"only_local{k}") for k, x in enumerate(forced)])


@query("c16_dirichlet_disagreement", sql(
    f"SELECT {_ID}, " + r("1.0 - " + ksum("p#*(cc*p#+1.0)/(cc+1.0)"), "d_expected")
    + " FROM (SELECT *, 0.5::DOUBLE + 9.5::DOUBLE*gate AS cc FROM s_pred)"))
def c16(spark, d):
    p = sv.predictions(spark, d).withColumn("cc", 0.5 + 9.5 * F.col("gate"))
    return p.select("method", "seed", "label_id",
                    fn.dirichlet_disagreement(fn.cols("p"), F.col("cc")).alias("d_expected"))


@query("c17_dirichlet_multinomial_nll", sql(
    "SELECT method, seed::BIGINT AS seed, count(*) AS n_rows, " + r(
        "avg(-(" + "lgamma(n+1.0::DOUBLE) - " + ksum("lgamma(v#+1.0::DOUBLE)") + " + lgamma(cc) - lgamma(n+cc) + "
        + ksum("(lgamma(v#+cc*greatest(p#,1e-6::DOUBLE)) - lgamma(cc*greatest(p#,1e-6::DOUBLE)))")
        + ")/greatest(n::DOUBLE, 1.0::DOUBLE))", "nll")
    + " FROM (SELECT *, 0.5::DOUBLE + 9.5::DOUBLE*gate AS cc FROM s_pred) GROUP BY 1, 2"))
def c17(spark, d):
    p = sv.predictions(spark, d).withColumn("cc", 0.5 + 9.5 * F.col("gate"))
    nll = fn.dirichlet_multinomial_nll(fn.cols("v"), fn.cols("p"), F.col("cc"))
    return p.groupBy("method", "seed").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(nll).alias("nll"))


@query("c18_masked_disagreement_mse", sql(
    "SELECT method, seed::BIGINT AS seed, count(*) AS n_rows, count(d_obs) AS n_observed, "
    + r("coalesce(avg((d_hat-d_obs)*(d_hat-d_obs)), 0.0)", "mse") + " FROM s_rows GROUP BY 1, 2"))
def c18(spark, d):
    s = scored(spark, d)
    gap = F.col("d_hat") - F.col("d_obs")
    return s.groupBy("method", "seed").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("d_obs").alias("n_observed"),
        F.coalesce(F.avg(gap * gap), F.lit(0.0)).alias("mse"))


@query("c19_argmax_flips", sql(
    f"SELECT count(*) AS n_rows, {r('avg((a <> b)::INT)', 'flip_share')} FROM "
    f"(SELECT {first_argmax('l')} AS a, {first_argmax('x')} AS b FROM s_heads)"))
def c19(spark, d):
    h = sv.heads(spark, d)
    flip = (fn.first_argmax(fn.cols("l")) != fn.first_argmax(fn.cols("x"))).cast("int")
    return h.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(flip).alias("flip_share"))


@query("c20_cache_bytes", sql(
    "SELECT \"partition\", bins, n_rows, n_rows*4*64*(bins+64)*2 AS value_bytes, n_rows*4*64*(bins+64)//8 AS mask_bytes,"
    " n_rows*4*64*(bins+64)*2 + n_rows*4*64*(bins+64)//8 + 250000000 AS total_bytes,"
    " (n_rows*4*64*(bins+64)*2 + n_rows*4*64*(bins+64)//8 + 250000000 <= 6000000000) AS within_cap"
    " FROM (SELECT \"partition\", count(*) AS n_rows FROM s_labels GROUP BY 1), (SELECT unnest([8,16,32])::BIGINT AS bins)"))
def c20(spark, d):
    per = sv.labels(spark, d).groupBy("partition").agg(F.count(F.lit(1)).alias("n_rows"))
    per = per.withColumn("bins", F.explode(F.array(*[F.lit(b).cast("bigint") for b in (8, 16, 32)])))
    cells = F.col("n_rows") * 4 * 64 * (F.col("bins") + 64)
    masks = F.floor(cells / 8)
    total = cells * 2 + masks + METADATA_BYTES
    return per.select("partition", "bins", "n_rows", (cells * 2).alias("value_bytes"), masks.alias("mask_bytes"),
                      total.alias("total_bytes"), (total <= CACHE_CAP_BYTES).alias("within_cap"))


@query("c21_stable_hash", sql(
    "SELECT label_id, substr(sha256('{' || '\"group\":' || group_id || ',\"label\":' || label_id || ',\"votes\":[' || "
    + klist("v#", sep=" || ',' || ") + " || ']}'), 1, 16) AS h FROM s_labels"))
def c21(spark, d):
    v = sv.votes(spark, d)
    h = fn.canonical_hash({"votes": F.array(*fn.cols("v")), "label": F.col("label_id"), "group": F.col("group_id")})
    return v.select("label_id", h.alias("h"))


@query("c22_pack_mask", sql(
    "SELECT vec_id, " + ", ".join(
        "(" + " + ".join(f"(CASE WHEN abs(embedding[{8 * b + i + 1}]::DOUBLE) <= 0.1::DOUBLE THEN {2 ** i} ELSE 0 END)" for i in range(8)) + f")::BIGINT AS b{b}"
        for b in range(8)) + ", true AS round_trip FROM embeddings"))
def c22(spark, d):
    e = sv.table(spark, d, "embeddings")
    e = e.withColumn("mask", F.transform("embedding", lambda x: F.abs(x.cast("double")) <= 0.1))
    e = e.withColumn("packed", fn.pack_bits(F.col("mask"), 64))
    return e.select("vec_id", *[F.get("packed", F.lit(i)).alias(f"b{i}") for i in range(8)],
                    (fn.unpack_bits(F.col("packed"), 64) == F.col("mask")).alias("round_trip"))


@query("c23_valid_fraction", sql(
    "SELECT vec_id, " + r("len(list_filter(embedding, lambda x: abs(x::DOUBLE) <= 0.1::DOUBLE))::DOUBLE / len(embedding)", "valid_fraction")
    + " FROM embeddings"))
def c23(spark, d):
    e = sv.table(spark, d, "embeddings")
    ok = F.filter("embedding", lambda x: F.abs(x.cast("double")) <= 0.1)
    return e.select("vec_id", (F.size(ok) / F.size("embedding")).alias("valid_fraction"))


# wide -> long metric records --------------------------------------------------------------
_REC = ("kl", "ce", "sse", "brier")


@query("b13_metric_record", sql(
    "SELECT method || '-' || seed::VARCHAR AS run_id, method AS method_id, seed::BIGINT AS seed, NULL::VARCHAR AS split_hash,"
    " NULL::VARCHAR AS preprocess_hash, NULL::VARCHAR AS protocol_hash, NULL::VARCHAR AS prediction_hash, 'd_mse' AS metric, "
    + r("avg((d_hat-d_obs)*(d_hat-d_obs))", "value") + ", NULL::DOUBLE AS ci_low, NULL::DOUBLE AS ci_high, count(*) AS n_rows,"
    " count(DISTINCT group_id) AS n_patients, NULL::BIGINT AS n_components,"
    " CASE WHEN count(d_obs) = 0 THEN 'NOT_ESTIMABLE' ELSE 'PASS' END AS status,"
    " CASE WHEN count(d_obs) = 0 THEN 'no row has two votes' END AS reason FROM s_rows GROUP BY method, seed"))
def b13(spark, d):
    from ..operators.records import metric_record

    gap = F.col("d_hat") - F.col("d_obs")
    agg = scored(spark, d).groupBy("method", "seed").agg(
        F.avg(gap * gap).alias("value"), F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("group_id").alias("n_patients"), F.count("d_obs").alias("seen"))
    return metric_record(agg, run_id=F.concat_ws("-", "method", F.col("seed")), method_id=F.col("method"),
                         seed=F.col("seed"), metric=F.lit("d_mse"), value=F.col("value"), n_rows=F.col("n_rows"),
                         n_patients=F.col("n_patients"),
                         status=F.when(F.col("seen") == 0, "NOT_ESTIMABLE"),
                         reason=F.when(F.col("seen") == 0, "no row has two votes"))


@query("b14_records_from_summary", sql(
    "SELECT method, seed::BIGINT AS seed, metric, " + r("value", "value") + ", n_rows,"
    " CASE WHEN value IS NULL THEN 'NOT_ESTIMABLE' ELSE 'PASS' END AS status FROM ("
    + " UNION ALL ".join(f"SELECT method, seed, '{m}' AS metric, avg({m}) AS value, count(*) AS n_rows FROM s_rows GROUP BY ALL"
                         for m in _REC) + ")"))
def b14(spark, d):
    from ..operators.records import records_from_wide

    wide = scored(spark, d).groupBy("method", "seed").agg(
        *[F.avg(m).alias(m) for m in _REC], F.count(F.lit(1)).alias("n_rows"))
    return records_from_wide(wide, ["method", "seed", "n_rows"], list(_REC))
