"""Projections, filters, predicates and data-quality gates (A02, B)."""

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import gates as gt
from ..operators.records import suppress
from ..operators.scoring import strata_rows, target_entropy
from ..sources import standins as sv
from ..sources.tables import table
from .registry import query
from .sqlkit import big, cte, klist, ksum, majority, r, sql


def _cnt(cond: str, alias: str) -> str:
    return f"coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0)::BIGINT AS {alias}"


@query("a02_alias_canonicalisation", sql(
    "SELECT " + _cnt("abs(a-b) > 1e-8::DOUBLE + 1e-5::DOUBLE*abs(b)", "n_mismatch") + ", count(*) AS n_rows, " + r("sum(a)", "total")
    + " FROM (SELECT spectrogram_offset_seconds AS a, spectrogram_offset_seconds + CASE WHEN order_status = 'P' THEN 0.5::DOUBLE ELSE 0.0 END AS b FROM s_labels)"))
def a02(spark, d):
    """The misspelt column is off by half a second where the order is pending."""
    t = sv.labels(spark, d).select("spectrogram_offset_seconds", "order_status").withColumn(
        "spectogram_offset_seconds",
        F.col("spectrogram_offset_seconds") + F.when(F.col("order_status") == "P", 0.5).otherwise(0.0))
    off = gt.alias_mismatches(t, "spectrogram_offset_seconds", "spectogram_offset_seconds")
    kept = t.drop("spectogram_offset_seconds").agg(F.count(F.lit(1)).alias("n_rows"),
                                                   F.sum("spectrogram_offset_seconds").alias("total"))
    return kept.withColumn("n_mismatch", off.scalar())


# raw vote columns with planted defects: negative where the order is pending and large,
# fractional where it is of low priority, empty where it is urgent and small
cte("s_dirty", "SELECT label_id, n, " + ", ".join(
    f"(CASE WHEN priority='1-URGENT' AND n < 3 THEN 0 ELSE v{k} END)::DOUBLE"
    + (" - (CASE WHEN order_status='P' AND n > 6 THEN 3 ELSE 0 END)" if k == 0 else "")
    + (" + (CASE WHEN priority='5-LOW' AND n = 2 THEN 0.5::DOUBLE ELSE 0.0 END)" if k == 1 else "")
    + f" AS r{k}" for k in range(6)) + " FROM s_labels")


def _dirty(spark, d):
    t = sv.labels(spark, d)
    empty = (F.col("priority") == "1-URGENT") & (F.col("n") < 3)
    out = {f"r{k}": F.when(empty, 0).otherwise(F.col(f"v{k}")).cast("double") for k in range(6)}
    out["r0"] = out["r0"] - F.when((F.col("order_status") == "P") & (F.col("n") > 6), 3).otherwise(0)
    out["r1"] = out["r1"] + F.when((F.col("priority") == "5-LOW") & (F.col("n") == 2), 0.5).otherwise(0.0)
    return t.withColumns(out)


@query("b01_vote_predicates", sql(
    "SELECT count(*) AS n_rows, 0::BIGINT AS non_finite, " + _cnt(klist("r# < 0", sep=" OR "), "negative") + ", "
    + _cnt(klist("r# <> floor(r#)", sep=" OR "), "fractional") + ", " + _cnt(ksum("r#") + " <= 0", "zero_sum") + " FROM s_dirty"))
def b01(spark, d):
    return gt.count_rules(_dirty(spark, d), gt.vote_rules(fn.cols("r")))


@query("b02_label_key_uniqueness", sql(
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"))
def b02(spark, d):
    return gt.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("b03_required_columns_non_null", sql(
    "SELECT count(*) AS n_rows, " + _cnt("l_orderkey IS NULL", "null_o_orderkey") + ", " + _cnt("l_shipmate IS NULL", "null_quality")
    + " FROM (SELECT o_orderkey AS l_orderkey, quality AS l_shipmate FROM orders LEFT JOIN labels ON o_orderkey = doc_id)"))
def b03(spark, d):
    """Orders matched to document labels by key: the label is missing for most of them."""
    o, lab = table(spark, d, "orders"), table(spark, d, "labels")
    return gt.null_ids(o.join(lab, o.o_orderkey == lab.doc_id, "left"), ["o_orderkey", "quality"])


@query("b04_offset_gates", sql(
    "SELECT \"partition\", count(*) AS n_rows, 0::BIGINT AS not_finite, " + _cnt("e < 0", "below_zero") + ", "
    + _cnt("abs(e*200.0::DOUBLE - round_even(e*200.0::DOUBLE, 0)) > 1e-6::DOUBLE", "off_grid") + " FROM (SELECT \"partition\","
    " offset_seconds - 1.0::DOUBLE + CASE WHEN order_status = 'P' THEN 0.001::DOUBLE ELSE 0.0 END AS e FROM s_labels) GROUP BY 1"))
def b04(spark, d):
    t = sv.labels(spark, d).withColumn(
        "e", F.col("offset_seconds") - 1.0 + F.when(F.col("order_status") == "P", 0.001).otherwise(0.0))
    return gt.count_rules(t, gt.offset_rules(F.col("e")), ["partition"])


@query("b05_identical_windows", sql(
    "SELECT " + big("sum(CASE WHEN n > 1 THEN n ELSE 0 END)", "shared_rows") + ", " + _cnt("n > 1", "shared_windows")
    + " FROM (SELECT count(*) AS n FROM s_labels GROUP BY spectrogram_id, spectrogram_offset_seconds)"))
def b05(spark, d):
    return gt.shared_window_rows(sv.labels(spark, d), ["spectrogram_id", "spectrogram_offset_seconds"])


@query("b06_cohort_profile", sql(
    "SELECT count(*) AS n_rows, count(DISTINCT group_id) AS n_groups, count(DISTINCT recording_id) AS n_recordings,"
    " count(DISTINCT spectrogram_id) AS n_spectrograms, min(n) AS n_min, max(n) AS n_max, " + _cnt("n = 1", "single_vote") + ", "
    + _cnt("n >= 10", "ten_or_more") + ", " + _cnt(majority("v") + " < 0", "tied") + ", "
    + klist("sum(v#)::BIGINT AS mass#")
    + ", (SELECT max(c) FROM (SELECT count(DISTINCT group_id) AS c FROM s_labels GROUP BY recording_id)) AS groups_per_recording"
      ", (SELECT max(c) FROM (SELECT count(DISTINCT group_id) AS c FROM s_labels GROUP BY spectrogram_id)) AS groups_per_spectrogram"
      ", (SELECT max(c) FROM (SELECT count(DISTINCT spectrogram_id) AS c FROM s_labels GROUP BY recording_id)) AS spectrograms_per_recording FROM s_labels"))
def b06(spark, d):
    t = sv.labels(spark, d)
    # one distinct pass over the id triple feeds every distinct count and fan-out
    ids = t.select("group_id", "recording_id", "spectrogram_id").distinct()

    def fan(per, of):
        return ids.groupBy(per).agg(F.count_distinct(of).alias("c")).agg(F.max("c")).scalar()

    v = fn.cols("v")
    return t.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("group_id").alias("n_groups"),
        F.count_distinct("recording_id").alias("n_recordings"),
        F.count_distinct("spectrogram_id").alias("n_spectrograms"),
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.count_if(F.col("n") == 1).alias("single_vote"),
        F.count_if(F.col("n") >= 10).alias("ten_or_more"), F.count_if(fn.n_at_max(v) > 1).alias("tied"),
        *[F.sum(f"v{k}").alias(f"mass{k}") for k in range(6)],
    ).withColumns({"groups_per_recording": fan("recording_id", "group_id"),
                   "groups_per_spectrogram": fan("spectrogram_id", "group_id"),
                   "spectrograms_per_recording": fan("recording_id", "spectrogram_id")})


_FI = "(['Seizure','LPD','GPD','LRDA','GRDA','Other'])[1 + CASE " + " ".join(
    f"WHEN v{k} = greatest(v0,v1,v2,v3,v4,v5) THEN {k}" for k in range(6)) + " END]"


@query("b07_consensus_audit", sql(
    "SELECT " + _cnt(f"{majority('v')} >= 0 AND {_FI} <> consensus", "mismatch_unique") + ", " + _cnt(f"{majority('v')} < 0", "tied_rows") + ", "
    + _cnt(f"{majority('v')} < 0 AND {_FI} <> consensus", "tied_off_order")
    + f", bool_and({majority('v')} >= 0 OR {_FI} = consensus) AS ties_follow_order FROM s_labels"))
def b07(spark, d):
    return gt.consensus_audit(sv.labels(spark, d))


@query("b08_probability_predicates", sql(
    "SELECT method, count(*) AS n_rows, 0::BIGINT AS target_negative, " + _cnt("abs(q0+q1+q2+q3+q4+q5 - 1.0) > 1e-6::DOUBLE", "target_sum_off") + ", "
    + _cnt("p0 - 0.02::DOUBLE < 0", "prediction_negative") + ", 0::BIGINT AS prediction_sum_zero FROM s_pred GROUP BY 1"))
def b08(spark, d):
    """Predictions shifted down in the first class, so that some turn negative."""
    p = sv.predictions(spark, d)
    shifted = [F.col("p0") - 0.02, F.col("p1") + 0.02, *fn.cols("p")[2:]]
    return gt.count_rules(p, gt.probability_rules(fn.cols("q"), shifted), ["method"])


@query("b09_partition_filter", sql(
    "SELECT label_id, group_id, \"partition\" FROM s_labels WHERE \"partition\" IN ('train', 'tune')"))
def b09(spark, d):
    return gt.select_partitions(sv.labels(spark, d), ["train", "tune"]).select("label_id", "group_id", "partition")


@query("b10_quarantine_filter", sql(
    "SELECT \"partition\", count(*) AS n_source, " + _cnt("local_valid = 0 AND context_valid = 0", "n_quarantined") + ", "
    + _cnt("NOT (local_valid = 0 AND context_valid = 0)", "n_kept") + " FROM s_labels GROUP BY 1"))
def b10(spark, d):
    t = sv.labels(spark, d)
    src = t.groupBy("partition").agg(F.count(F.lit(1)).alias("n_source"))
    kept = gt.drop_unusable(t).groupBy("partition").agg(F.count(F.lit(1)).alias("n_kept"))
    return src.join(kept, "partition", "left").fillna(0).withColumn(
        "n_quarantined", F.col("n_source") - F.col("n_kept"))


cte("s_h", "SELECT *, round(" + ksum("(CASE WHEN q# > 0 THEN -q#*ln(q#) ELSE 0.0 END)") + ", 9) AS h, least(local_valid, context_valid) AS vf,"
    f" {majority('v')} AS yy FROM s_q")
cte("s_tert", "SELECT quantile_cont(h, 1.0::DOUBLE/3) AS t1, quantile_cont(h, 2.0::DOUBLE/3) AS t2 FROM s_h WHERE \"partition\" = 'tune'")
_BAND = "CASE WHEN n = 1 THEN 'n=1' WHEN n <= 4 THEN 'n=2-4' WHEN n <= 9 THEN 'n=5-9' ELSE 'n>=10' END"
STRATA_SQL = (f"unnest(['votes:' || {_BAND}, CASE WHEN h <= t1 THEN 'entropy:low' WHEN h <= t2 THEN 'entropy:mid' ELSE 'entropy:high' END,"
              " CASE WHEN vf < 0.95 THEN 'valid:lt_0.95' ELSE 'valid:ge_0.95' END,"
              " CASE WHEN yy >= 0 THEN 'majority:' || yy::VARCHAR ELSE 'majority:tied' END])")


def tertiles(spark, d):
    """Entropy tertiles of the tune partition; entropies of vote patterns are counted per value first."""
    t = sv.targets(sv.labels(spark, d)).where(F.col("partition") == "tune")
    c = t.select(target_entropy(fn.cols("q")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    return c.agg(F.percentile("h", F.lit(1.0 / 3), F.col("f")).alias("t1"),
                 F.percentile("h", F.lit(2.0 / 3), F.col("f")).alias("t2"))


@query("b11_analysis_strata", sql(
    "SELECT stratum, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups FROM (SELECT group_id, " + STRATA_SQL
    + " AS stratum FROM s_h CROSS JOIN s_tert) GROUP BY 1"))
def b11(spark, d):
    t = sv.targets(sv.labels(spark, d)).withColumn("y", fn.unique_majority(fn.cols("v")))
    q = tertiles(spark, d)
    s = strata_rows(t, q.select("t1").scalar(), q.select("t2").scalar(),
                    F.least("local_valid", "context_valid"))
    return s.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("group_id").alias("n_groups"))


@query("b12_run_filters", sql(
    f"SELECT run_id, config, seed_no, {r('tune_kl', 'tune_kl')} FROM s_runs WHERE status = 'PASS' AND epochs = 3 AND config IN ('c2','c3','c5') AND fraction = 1.0"))
def b12(spark, d):
    t = sv.runs(spark, d)
    return t.where((F.col("status") == "PASS") & (F.col("epochs") == 3) & F.col("config").isin("c2", "c3", "c5")
                   & (F.col("fraction") == 1.0)).select("run_id", "config", "seed_no", "tune_kl")


@query("b15_small_cell_suppression", sql(
    "SELECT group_nation, band, n_groups, CASE WHEN n_groups >= 10 THEN n_rows END AS n_rows, " + r("CASE WHEN n_groups >= 10 THEN mean_n END", "mean_n")
    + ", n_groups < 10 AS suppressed FROM (SELECT c_nationkey AS group_nation, " + _BAND + " AS band, count(*) AS n_rows, avg(n) AS mean_n,"
    " count(DISTINCT group_id) AS n_groups FROM s_labels JOIN customer ON group_id = c_custkey GROUP BY 1, 2)").replace(
        "SELECT group_nation,", "SELECT group_nation::BIGINT AS group_nation,", 1))
def b15(spark, d):
    from ..operators.scoring import vote_band

    t = sv.labels(spark, d).join(table(spark, d, "customer"), F.col("group_id") == F.col("c_custkey"))
    cells = t.groupBy(F.col("c_nationkey").alias("group_nation"), vote_band(F.col("n")).alias("band")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("n").alias("mean_n"), F.count_distinct("group_id").alias("n_groups"))
    return suppress(cells, "n_groups", ["n_rows", "mean_n"])


@query("b16_status_vocabulary", sql(
    "SELECT status, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'PASS' WHEN 'error' THEN 'FAIL' WHEN 'signup' THEN 'RUNNING' ELSE event_type END AS status FROM events)"
    " WHERE status NOT IN ('PLANNED','RUNNING','PASS','FAIL','INCOMPLETE','NOT_RUN','BLOCKED') GROUP BY 1"))
def b16(spark, d):
    t = F.col("event_type")
    e = table(spark, d, "events").select(
        F.when(t == "view", "PASS").when(t == "error", "FAIL").when(t == "signup", "RUNNING").otherwise(t).alias("status"))
    return gt.bad_statuses(e).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
