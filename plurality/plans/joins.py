"""Join queries (F), set operations (K), key gather."""

from pyspark.sql import functions as F

from ..operators import joins as jn
from ..operators import runs as rn
from ..operators.ranking import ordered_prefix
from ..operators.resample import paired_differences
from ..sources import standins as sv
from ..sources.tables import table
from .groups import conditions
from .registry import query
from .sqlkit import cte, klist, r, sql
from .views import scored


@query("f01_inner_join_file_tables", sql(
    "SELECT label_id, recording_rows, spectrogram_rows FROM s_labels JOIN (SELECT l_partkey, count(*) AS recording_rows FROM lineitem GROUP BY 1) ON recording_id = l_partkey"
    " JOIN (SELECT l_suppkey, count(*) AS spectrogram_rows FROM lineitem GROUP BY 1) ON spectrogram_id = l_suppkey"))
def f01(spark, d):
    li = table(spark, d, "lineitem")
    rec = li.groupBy(F.col("l_partkey").alias("recording_id")).agg(F.count(F.lit(1)).alias("recording_rows"))
    spec = li.groupBy(F.col("l_suppkey").alias("spectrogram_id")).agg(F.count(F.lit(1)).alias("spectrogram_rows"))
    return sv.labels(spark, d).join(rec, "recording_id").join(spec, "spectrogram_id").select(
        "label_id", "recording_rows", "spectrogram_rows")




@query("f02_left_join_split", sql("SELECT l.label_id, s.part FROM s_labels l LEFT JOIN s_split s ON l.label_id = s.label_id",
                                  s_split="SELECT label_id, \"partition\" AS part FROM s_labels WHERE order_status <> 'P'"))
def f02(spark, d):
    t = sv.labels(spark, d)
    split = t.where(F.col("order_status") != "P").select("label_id", F.col("partition").alias("part"))
    return t.select("label_id").join(split, "label_id", "left")


@query("f03_inner_join_quality", sql(
    "SELECT l.label_id, l.group_id, " + r("q.local_valid", "local_valid") + ", " + r("q.context_valid", "context_valid") + " FROM s_labels l JOIN s_labels q ON l.label_id = q.label_id"))
def f03(spark, d):
    t = sv.labels(spark, d)
    quality = t.select("label_id", "local_valid", "context_valid")
    return sv.votes(spark, d).select("label_id", "group_id").join(quality, "label_id")


@query("f04_one_to_one_alignment", sql(
    "SELECT sum((a>0 AND b>0)::INT)::BIGINT AS common, sum((b=0)::INT)::BIGINT AS only_a, sum((a=0)::INT)::BIGINT AS only_b, sum((a>1 OR b>1)::INT)::BIGINT AS repeated FROM ("
    "SELECT k, sum(a) AS a, sum(b) AS b FROM (SELECT o_orderkey AS k, 1 AS a, 0 AS b FROM orders UNION ALL SELECT label_id, 0, 1 FROM s_labels) GROUP BY 1)"))
def f04(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    b = sv.labels(spark, d).select(F.col("label_id").alias("k"))
    return jn.alignment_counts(a, b, ["k"])


@query("f05_target_agreement", sql(
    "SELECT b.method, b.seed::BIGINT AS seed, count(*) AS n_common, 0::BIGINT AS n_mismatch FROM s_pred a JOIN s_pred b ON b.label_id = a.label_id WHERE a.method='m1' AND a.seed=101 AND NOT (b.method='m1' AND b.seed=101) GROUP BY 1, 2"))
def f05(spark, d):
    """The targets of every other method and seed against those of the first."""
    votes = [f"v{k}" for k in range(6)]
    p = sv.predictions(spark, d).select("method", "seed", "label_id", *votes)
    first = (F.col("method") == sv.METHODS[0][0]) & (F.col("seed") == sv.SEEDS[0])
    return jn.target_mismatches(p.where(~first), p.where(first), ["label_id"], votes, ["method", "seed"])


@query("f06_matched_seed_contrast", sql(
    f"SELECT fraction, {r('avg(va-vb)', 'mean_delta')}, {r('stddev_samp(va-vb)', 'sd_delta')}, count(*) AS n_pairs FROM (SELECT fraction, seed_no, avg(CASE WHEN config='c3' THEN tune_kl END) AS va,"
    " avg(CASE WHEN config='c1' THEN tune_kl END) AS vb FROM s_runs WHERE status='PASS' GROUP BY 1, 2) WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY 1"))
def f06(spark, d):
    t = sv.runs(spark, d).where(F.col("status") == "PASS")
    return rn.paired_contrast(t, F.col("config") == "c3", F.col("config") == "c1", ["seed_no"], "tune_kl", ["fraction"])


@query("f07_semi_join", sql(
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)"))
def f07(spark, d):
    keep = table(spark, d, "customer").where(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(keep, "o_custkey", "left_semi")


cte("s_lrow", "SELECT *, row_number() OVER (ORDER BY label_id) - 1 AS rk FROM s_labels")


def asked_ids(spark, d, step):
    """For every event the id of an existing label, picked by its place among all."""
    places = ordered_prefix(sv.labels(spark, d).select("label_id"), [], ["label_id"]).select("label_id", (F.col("rank") - 1).alias("rk"), "n_total")
    n = places.agg(F.max("n_total")).scalar()
    asked = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.pmod(F.col("event_id") * step, n).alias("rk"))
    return asked.join(places.select("rk", "label_id"), "rk").select("pos", "label_id")


@query("f08_ordered_key_lookup", sql(
    "SELECT e.event_id AS pos, l.label_id, l.group_id, " + r("l.local_valid", "local_valid") + " FROM events e JOIN s_lrow l ON l.rk = (e.event_id * 7) % (SELECT count(*) FROM s_lrow)"))
def f08(spark, d):
    ids = asked_ids(spark, d, 7)
    return jn.gather(ids, sv.labels(spark, d).select("label_id", "group_id", "local_valid"), "label_id")


@query("f09_dimension_maps", sql(
    "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"))
def f09(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")


@query("f10_paired_method_join", sql(
    f"SELECT seed::BIGINT AS seed, group_id, {r('la', 'la')}, {r('lb', 'lb')}, {r('la-lb', 'delta')} FROM (SELECT seed, group_id, avg(CASE WHEN method='m1' THEN gkl END) AS la, avg(CASE WHEN method='m2' THEN gkl END) AS lb FROM s_gm GROUP BY 1, 2)"))
def f10(spark, d):
    """Every seed on its own; a group without one of the two methods raises."""
    s = scored(spark, d, methods=sv.METHODS[:2]).withColumn("one", F.lit(1))
    per = paired_differences(s, ["seed"], "group_id", "one", "kl", F.col("method") == "m1", F.col("method") == "m2")
    return per.select("seed", "group_id", "la", "lb", "delta")


@query("f11_clean_against_perturbed", sql(
    f"SELECT condition, label_id, {r('dkl', 'dkl')}, {r('js', 'js')}, flip::BIGINT AS flip FROM s_pair"))
def f11(spark, d):
    return conditions(spark, d).select("condition", "label_id", "dkl", "js", "flip")


@query("a13_gather_rows", sql(
    "SELECT e.event_id AS pos, l.label_id, " + klist("l.v#") + " FROM events e JOIN s_lrow l ON l.rk = (e.event_id * 13) % (SELECT count(*) FROM s_lrow) ORDER BY pos"))
def a13(spark, d):
    ids = asked_ids(spark, d, 13)
    rows = sv.votes(spark, d).select("label_id", *[f"v{k}" for k in range(6)])
    return jn.gather(ids, rows, "label_id").orderBy("pos")


# set operations ------------------------------------------------------------------------------
@query("k01_key_intersection", sql("SELECT o_orderkey AS k FROM orders INTERSECT SELECT doc_id FROM labels"))
def k01(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).intersect(table(spark, d, "labels").select("doc_id"))


@query("k02_key_difference", sql("SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem"))
def k02(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).subtract(table(spark, d, "lineitem").select("l_orderkey"))


@query("k03_union_of_records", sql(
    f"SELECT 'raw' AS calibration, method, seed::BIGINT AS seed, {r('avg(kl)', 'kl')}, NULL::DOUBLE AS brier FROM s_rows GROUP BY 2, 3 UNION ALL SELECT 'scored', method, seed::BIGINT, {r('avg(kl)')}, {r('avg(brier)')} FROM s_rows GROUP BY 2, 3"))
def k03(spark, d):
    s = scored(spark, d).groupBy("method", "seed").agg(F.avg("kl").alias("kl"), F.avg("brier").alias("brier"))
    a = s.drop("brier").withColumn("calibration", F.lit("raw"))
    return a.unionByName(s.withColumn("calibration", F.lit("scored")), allowMissingColumns=True)


@query("k04_distinct_configurations", sql("SELECT DISTINCT config, epochs, fraction FROM s_runs"))
def k04(spark, d):
    return sv.runs(spark, d).select("config", "epochs", "fraction").dropDuplicates(["config", "epochs", "fraction"])


@query("k05_keyed_upsert", sql(
    f"SELECT run_id, version, status, {r('value', 'value')} FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY version DESC) AS i FROM ("
    "SELECT run_id, 1::BIGINT AS version, 'OLD' AS status, hours AS value FROM s_runs WHERE status <> 'RUNNING' UNION ALL SELECT run_id, 2::BIGINT, 'NEW', tune_kl FROM s_runs WHERE status = 'PASS')) WHERE i = 1"))
def k05(spark, d):
    t = sv.runs(spark, d)
    old = t.where(F.col("status") != "RUNNING").select("run_id", F.lit(1).cast("bigint").alias("version"), F.lit("OLD").alias("status"), F.col("hours").alias("value"))
    new = t.where(F.col("status") == "PASS").select("run_id", F.lit(2).cast("bigint").alias("version"), F.lit("NEW").alias("status"), F.col("tune_kl").alias("value"))
    return rn.latest_per_key(old.unionByName(new), ["run_id"], ["version"])


