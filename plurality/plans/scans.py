"""Scan and sink queries (A)."""

from pyspark.sql import functions as F

from ..operators.runs import latest_per_key
from ..session import scratch_path
from ..sources import sinks as sk
from ..sources import standins as sv
from ..sources.tables import table
from .registry import query
from .spectral import wide_signal
from .sqlkit import klist, r, sql
from .views import scored

LABEL_SCHEMA = ("label_id bigint, group_id bigint, recording_id bigint, spectrogram_id bigint, offset_seconds double, "
                "spectrogram_offset_seconds double, v0 bigint, v1 bigint, v2 bigint, v3 bigint, v4 bigint, v5 bigint, consensus string")
_COLS = [x.split()[0] for x in LABEL_SCHEMA.split(", ")]


@query("a01_label_table_scan", sql(
    "SELECT label_id, group_id, recording_id, spectrogram_id, " + r("offset_seconds", "offset_seconds") + ", " + r("spectrogram_offset_seconds", "spectrogram_offset_seconds") + ", " + klist("v#") + ", consensus FROM s_labels"))
def a01(spark, d):
    path = scratch_path(spark, "labels-csv")
    sk.write_csv(sv.labels(spark, d).select(*_COLS), path)
    return sk.read_csv(spark, path, LABEL_SCHEMA)


def _recordings(spark, d):
    """One Parquet folder per recording."""
    path = scratch_path(spark, "recordings")
    w = wide_signal(spark, d)
    sk.write_partitioned(w.repartition("recording_id"), path, ["recording_id"])
    return path


@query("a03_recording_scan", sql(
    "SELECT recording_id, count(DISTINCT sample) AS n_samples, " + ", ".join(r(f"sum(CASE WHEN channel={k} THEN x END)", f"total{k}") for k in range(5)) + " FROM s_sig GROUP BY 1"))
def a03(spark, d):
    df = spark.read.parquet(_recordings(spark, d))
    rec = F.regexp_extract(F.col("_metadata.file_path"), r"recording_id=(\d+)", 1).cast("bigint")
    return df.groupBy(rec.alias("recording_id")).agg(F.count(F.lit(1)).alias("n_samples"), *[F.sum(f"c{k}").alias(f"total{k}") for k in range(5)])


@query("a05_file_inventory", sql(
    "SELECT count(*) AS n_files, sum(n)::BIGINT AS rows_total, min(n) AS rows_min, max(n) AS rows_max, true AS all_sized FROM (SELECT count(DISTINCT sample) AS n FROM s_sig GROUP BY recording_id)"))
def a05(spark, d):
    path = _recordings(spark, d)
    rows = sk.file_rows(spark.read.parquet(path))
    size = sk.listing(spark, f"{path}/*/*.parquet")
    key = F.regexp_extract("path", r"recording_id=.*$", 0)
    j = rows.withColumn("k", key).join(size.withColumn("k", key).select("k", "bytes"), "k", "left")
    return j.agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_rows").alias("rows_total"), F.min("n_rows").alias("rows_min"),
                 F.max("n_rows").alias("rows_max"), F.every(F.coalesce(F.col("bytes") > 0, F.lit(False))).alias("all_sized"))


@query("a06_file_checksums")
def a06(spark, d):
    return sk.checksums(spark, f"{d}/*.parquet").withColumn("path", F.regexp_extract("path", r"([^/]*)$", 1))


@query("a07_missing_and_unreferenced", sql(
    "SELECT 'missing' AS kind, count(*) AS n FROM (SELECT DISTINCT recording_id FROM s_labels EXCEPT SELECT vec_id // 5 FROM embeddings) UNION ALL"
    " SELECT 'unreferenced', count(*) FROM (SELECT p_partkey FROM part EXCEPT SELECT recording_id FROM s_labels)"))
def a07(spark, d):
    ids = sv.labels(spark, d).select("recording_id").distinct()
    have = sv.signal_arrays(spark, d).select("recording_id").distinct()
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("recording_id"))
    a = ids.join(have, "recording_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("missing"))
    b = parts.join(ids, "recording_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("unreferenced"))
    return a.unionByName(b)


@query("a08_parquet_sink", sql(
    f"SELECT method, seed::BIGINT AS seed, count(*) AS n_rows, {r('avg(kl)', 'kl')} FROM s_rows WHERE \"partition\" = 'test' GROUP BY 1, 2"))
def a08(spark, d):
    path = scratch_path(spark, "predictions")
    sk.write_partitioned(scored(spark, d, ("test",)).select("method", "seed", "label_id", "kl"), path, ["method", "seed"])
    return spark.read.parquet(path).groupBy("method", "seed").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("kl").alias("kl"))


_AGG = "SELECT \"partition\", count(*) AS n_rows, " + r("avg(n)", "mean_votes") + " FROM s_labels GROUP BY 1"


@query("a09_csv_report_sink", sql(_AGG))
def a09(spark, d):
    path = scratch_path(spark, "report-csv")
    sk.write_csv(sv.labels(spark, d).groupBy("partition").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("n").alias("mean_votes")), path, report=True)
    return sk.read_csv(spark, path, "partition string, n_rows bigint, mean_votes double")


@query("a10_json_result_document", sql(
    "SELECT \"partition\", n_rows, mean_votes FROM (" + _AGG + ")"))
def a10(spark, d):
    path = scratch_path(spark, "report-json")
    per = sv.labels(spark, d).groupBy("partition").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("n").alias("mean_votes"))
    doc = per.agg(F.map_from_entries(F.collect_list(F.struct("partition", F.struct("n_rows", "mean_votes")))).alias("partitions"))
    sk.write_json(doc, path)
    back = sk.read_json(spark, path, "partitions map<string, struct<n_rows: bigint, mean_votes: double>>")
    return back.select(F.explode("partitions").alias("partition", "s")).select("partition", "s.n_rows", "s.mean_votes")


@query("a11_ledger_latest", sql(
    f"SELECT run_id, arg_max(stage, epoch) AS stage, max(epoch) AS epoch, {r('arg_max(loss, epoch)', 'loss')} FROM s_revents GROUP BY 1"))
def a11(spark, d):
    path = scratch_path(spark, "ledger")
    e = sv.run_events(spark, d).select("run_id", "epoch", "stage", "loss")
    sk.append_ledger(e.where("epoch <= 5"), path)
    sk.append_ledger(e.where("epoch > 5"), path)
    return latest_per_key(sk.read_json(spark, path, "run_id bigint, epoch bigint, stage string, loss double"), ["run_id"], ["epoch"])


@query("a12_event_log_scan", sql(
    f"SELECT run_id, count(*) AS n_events, arg_min(epoch, (loss, epoch)) AS best_epoch, {r('arg_max(loss, epoch)', 'last_loss')}, sum(examples)::BIGINT AS examples FROM s_revents GROUP BY 1"))
def a12(spark, d):
    path = scratch_path(spark, "events-json")
    sk.write_json(sv.run_events(spark, d).select("run_id", "epoch", "loss", "examples"), path)
    e = sk.read_json(spark, path, "run_id bigint, epoch bigint, loss double, examples bigint")
    return e.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_events"), F.min_by("epoch", F.struct("loss", "epoch")).alias("best_epoch"),
                                   F.max_by("loss", "epoch").alias("last_loss"), F.sum("examples").alias("examples"))


@query("a17_bytes_by_category")
def a17(spark, d):
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kind = (F.when(name.rlike("^(lineitem|orders|customer)"), "votes").when(name.rlike("^(embeddings|events)"), "signal")
            .when(name.rlike("^(documents|pages|conversations|benchmark|labels)"), "text").otherwise("dimension"))
    return sk.listing(spark, f"{d}/*.parquet").groupBy(kind.alias("category")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"))
