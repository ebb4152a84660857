"""Views over the driver tables that stand in for votes, predictions, signals and ledgers.

Each is a lazy DataFrame: Catalyst prunes the columns a query does not use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as fn
from ..constants import CLASS_NAMES, PARTITION_SHARES, PARTITIONS, SPLIT_SEED
from .tables import table

VOTE_KEYS = (("A", "F"), ("A", "O"), ("N", "F"), ("N", "O"), ("R", "F"), ("R", "O"))
METHODS = (("m1", 0.8, 1), ("m2", 1.2, 2), ("m3", 1.6, 3))  # name, noise, draw stream
SEEDS = (101, 202, 303)
SIGNAL_RATE = 8.0  # samples per second of the stand-in signal


def labels(spark: SparkSession, d: str) -> DataFrame:
    """One row per labelled window: ids, offsets, votes, validity shares, consensus, partition."""
    li = table(spark, d, "lineitem")
    per_order = li.groupBy("l_orderkey").agg(
        *[
            F.count_if((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b)).alias(f"v{k}")
            for k, (a, b) in enumerate(VOTE_KEYS)
        ],
        F.count(F.lit(1)).alias("n"),
        F.min("l_partkey").alias("recording_id"),
        F.min("l_suppkey").alias("spectrogram_id"),
        (F.count_if(F.col("l_discount") >= 0.02) / F.count(F.lit(1))).alias("local_valid"),
        (F.count_if(F.col("l_tax") >= 0.02) / F.count(F.lit(1))).alias("context_valid"),
    )
    o = table(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    out = per_order.join(o, per_order.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("label_id"),
        F.col("o_custkey").alias("group_id"),
        "recording_id", "spectrogram_id",
        *[f"v{k}" for k in range(6)], "n", "local_valid", "context_valid",
        (F.pmod(cents, F.lit(4000)) / 200.0).alias("offset_seconds"),
        (F.pmod(cents, F.lit(1200)) / 2.0).alias("spectrogram_offset_seconds"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderpriority").alias("priority"),
    )
    v = fn.cols("v")
    consensus = F.when(F.col("order_status") == "P", fn.last_argmax(v)).otherwise(fn.first_argmax(v))
    names = F.array(*[F.lit(c) for c in CLASS_NAMES])
    return out.withColumns({
        "consensus": F.get(names, consensus.cast("int")),
        "partition": partition_of(F.col("group_id")),
    })


def partition_of(group: F.Column) -> F.Column:
    """Partition by a seeded hash of the group, so that a group is never split."""
    u = fn.md5_unit("part", SPLIT_SEED, group.cast("string"))
    edge, chain = 0.0, None
    for name, share in list(zip(PARTITIONS, PARTITION_SHARES))[:-1]:
        edge = round(edge + share, 10)
        chain = F.when(u < edge, name) if chain is None else chain.when(u < edge, name)
    return chain.otherwise(PARTITIONS[-1])


def votes(spark: SparkSession, d: str) -> DataFrame:
    return labels(spark, d).select("label_id", "group_id", "n", *[f"v{k}" for k in range(6)])


def targets(df: DataFrame) -> DataFrame:
    return df.withColumns({f"q{k}": q for k, q in enumerate(fn.soft_targets(fn.cols("v")))})


def spread(df: DataFrame) -> DataFrame:
    """Keep the full task count: the rows are narrow, but each fans out into costly draws."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "label_id")


def _noisy(q: list, u: list, sigma: F.Column, floor: float = 0.05) -> list:
    raw = [(a + floor) * F.exp(sigma * (2.0 * b - 1.0)) for a, b in zip(q, u)]
    return raw


def predictions(spark: SparkSession, d: str, parts: tuple[str, ...] | None = None,
                methods: tuple = METHODS, seeds: tuple = SEEDS) -> DataFrame:
    """Class probabilities per (method, seed, label) as noisy vote shares, with d_hat and gate."""
    base = labels(spark, d)
    if parts:
        base = base.where(F.col("partition").isin(*parts))
    return predictions_of(spread(base), methods, seeds)


def predictions_of(base: DataFrame, methods: tuple = METHODS, seeds: tuple = SEEDS) -> DataFrame:
    """The predictions for a table of labels with their votes."""
    base = targets(base)
    m = F.explode(F.array(*[F.struct(F.lit(a).alias("method"), F.lit(s).alias("sigma"), F.lit(t).alias("stream"))
                            for a, s, t in methods]))
    fan = base.withColumn("m", m).withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    fan = fan.withColumns({"method": F.col("m.method"), "sigma": F.col("m.sigma"),
                           "h": fn.mix_state("label_id", F.col("seed"), F.col("m.stream"))}).drop("m")
    u = fn.mix_units(F.col("h"))
    fan = fan.withColumns({f"w{k}": w for k, w in enumerate(_noisy(fn.cols("q"), u, F.col("sigma")))})
    fan = fan.withColumn("wsum", fn.total(fn.cols("w")))
    fan = fan.withColumns({f"p{k}": F.col(f"w{k}") / F.col("wsum") for k in range(6)})
    evenness = 1.0 - fn.total([x * x for x in fn.cols("p")])
    fan = fan.withColumns({"d_hat": 0.7 * evenness + 0.3 * u[6], "gate": u[7]})
    return fan.drop("h", "sigma", "wsum", *[f"w{k}" for k in range(6)])


def heads(spark: SparkSession, d: str) -> DataFrame:
    """Two per-view distributions (local l0..l5, context x0..x5) per label with a gate."""
    base = targets(spread(labels(spark, d))).withColumns({
        "hl": fn.mix_state("label_id", F.lit(1), F.lit(11)),
        "hx": fn.mix_state("label_id", F.lit(1), F.lit(13)),
    })
    ul, ux = fn.mix_units(F.col("hl")), fn.mix_units(F.col("hx"))
    base = base.withColumns({
        **{f"a{k}": w for k, w in enumerate(_noisy(fn.cols("q"), ul, F.lit(1.0)))},
        **{f"b{k}": w for k, w in enumerate(_noisy(fn.cols("q"), ux, F.lit(1.4)))},
        "gate": ul[7],
    })
    sa, sb = fn.total(fn.cols("a")), fn.total(fn.cols("b"))
    base = base.withColumns({
        **{f"l{k}": F.col(f"a{k}") / sa for k in range(6)},
        **{f"x{k}": F.col(f"b{k}") / sb for k in range(6)},
    })
    return base.drop("hl", "hx", *[f"a{k}" for k in range(6)], *[f"b{k}" for k in range(6)])


def links(spark: SparkSession, d: str) -> DataFrame:
    """Group-recording link graph over every row of lineitem.

    Recordings are parts within a pair of neighbouring customers, so some pairs are linked and others not.
    """
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("group_id"),
        (F.floor(F.col("o_custkey") / 2) * 2000 + F.pmod(F.col("l_partkey"), F.lit(2000))).alias("recording_id")).distinct()


def signal_arrays(spark: SparkSession, d: str) -> DataFrame:
    """One array per recording and channel, five channels each, 64 samples long; out-of-range values are NaN."""
    e = table(spark, d, "embeddings")
    known = lambda v: F.when(F.abs(v.cast("double")) <= 0.3, v.cast("double")).otherwise(float("nan"))
    return e.select(
        F.floor(F.col("vec_id") / 5).cast("bigint").alias("recording_id"),
        F.pmod(F.col("vec_id"), F.lit(5)).cast("bigint").alias("channel"),
        F.transform("embedding", known).alias("x"))


def signal(spark: SparkSession, d: str) -> DataFrame:
    """The same signal, one row per sample; missing values are null."""
    s = signal_arrays(spark, d).select("recording_id", "channel", F.posexplode("x").alias("sample", "x"))
    return s.select("recording_id", "channel", F.col("sample").cast("bigint").alias("sample"), F.nanvl("x", F.lit(None).cast("double")).alias("x"))


def windows(spark: SparkSession, d: str) -> DataFrame:
    """Six overlapping windows per recording; the last one runs past the end."""
    e = table(spark, d, "embeddings")
    rec = e.select(F.floor(F.col("vec_id") / 5).cast("bigint").alias("recording_id")).distinct()
    return rec.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(40), F.lit(8)))).select(
        "recording_id", F.col("start").cast("bigint").alias("start"),
        (F.col("recording_id") * 100 + F.col("start")).alias("row"))


def window_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes of a recording: how its vectors' labels fall into six classes."""
    e = table(spark, d, "embeddings")
    return e.groupBy(F.floor(F.col("vec_id") / 5).cast("bigint").alias("recording_id")).agg(
        *[F.count_if(F.pmod(F.col("label"), F.lit(6)) == k).alias(f"v{k}") for k in range(6)],
        F.count(F.lit(1)).alias("n"))


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events with seconds since midnight and a day number."""
    e = table(spark, d, "events")
    return e.select(
        "event_id", "user_id", "event_type", "value",
        # wall-clock parts, so that the session time zone does not matter
        (F.unix_date(F.to_date("ts")) * F.lit(86400000000) + (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("bigint") * 1000000
         + (F.expr("extract(SECOND FROM ts)") * 1000000).cast("bigint")).alias("micros"),
    ).withColumns({
        "day": F.floor(F.col("micros") / 86400000000).cast("bigint"),
        "seconds": (F.pmod(F.col("micros"), F.lit(86400000000)) / 1000000.0),
    })


def spectro(spark: SparkSession, d: str) -> DataFrame:
    """Long spectrogram: per user and 2-hour slot, region = event type, four value buckets."""
    e = event_rows(spark, d)
    return e.select(
        F.col("user_id").alias("spectrogram_id"),
        F.floor(F.col("seconds") / 7200).cast("bigint").alias("slot"),
        F.col("event_type").alias("region"),
        value_bucket(F.col("value")).alias("freq"), "value",
    ).groupBy("spectrogram_id", "slot", "region", "freq").agg(F.sum("value").alias("power")).withColumn(
        "time", F.col("slot") * 2.0 + 1.0)


def value_bucket(v: F.Column) -> F.Column:
    """Frequency stand-in 1..4 Hz by size of the value."""
    return F.when(v < 20, 1.0).when(v < 50, 2.0).when(v < 90, 3.0).otherwise(4.0)


def run_events(spark: SparkSession, d: str) -> DataFrame:
    """Training-log stand-in: a run is a user, an epoch its event order, the loss its value."""
    from ..operators.ranking import ordered_prefix

    e = ordered_prefix(event_rows(spark, d), ["user_id"], ["event_id"])
    return e.select(
        F.col("user_id").alias("run_id"), "event_id", "micros", F.col("rank").alias("epoch"),
        F.col("value").alias("loss"),
        (F.pmod(F.col("event_id") * 7, F.lit(50)) + 1).alias("examples"),
        F.col("event_type").alias("stage"),
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Run table stand-in: config, seed, schedule and tune loss of every event-derived run."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.concat(F.lit("c"), F.pmod(F.col("user_id"), F.lit(8))).alias("config"),
        (F.pmod(F.col("event_id"), F.lit(3)) + 1).alias("seed_no"),
        F.when(F.col("event_type") == "error", "FAIL").when(F.col("event_type") == "signup", "RUNNING")
        .otherwise("PASS").alias("status"),
        (F.pmod(F.col("user_id"), F.lit(3)) + 1).alias("epochs"),
        F.get(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(1.0)),
              F.pmod(F.floor(F.col("event_id") / 3), F.lit(4)).cast("int")).alias("fraction"),
        F.when(F.pmod(F.col("user_id"), F.lit(2)) == 0, "foveated").otherwise("uniform").alias("encoding"),
        F.get(F.array(F.lit(8), F.lit(16), F.lit(32)),
              F.pmod(F.floor(F.col("event_id") / 12), F.lit(3)).cast("int")).cast("bigint").alias("bins"),
        F.when(F.col("event_type") != "signup", F.col("value") / 97.0).alias("tune_kl"),
        (F.pmod(F.col("user_id"), F.lit(8)) * 1000 + 450).alias("params"),
        (F.col("value") / 3600.0).alias("hours"),
        F.col("event_type").alias("stage"),
    )
