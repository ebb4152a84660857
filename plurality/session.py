"""Session helpers: local sessions for tests and benches, and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "plurality", **conf: str) -> SparkSession:
    """A local session. On a cluster the caller brings its own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", os.environ.get("PLURALITY_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only in local mode (tests, laptops) a fresh local folder is made where none is named, and
    recorded in the session, so that every later call sees the same one; a cluster must name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="run-plurality-")
        spark.conf.set("spark.checkpoint.dir", named)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder so that executor loss cannot undo it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for sinks that are read back."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, for plans that read them more than once; it is compressed, which a checkpoint is not."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more, on whatever file system it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: bytecode of a method beyond which HotSpot never compiles it
JIT_BYTES = 8000


def jit_sized(spark: SparkSession) -> None:
    """Have a whole stage of long expressions run as separate operators where its one method would be too long for HotSpot.

    Spark's own limit admits methods of 65,535 bytes, which are then interpreted row by row. A limit that the session was given stays.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(limit)) == 65535:
        spark.conf.set(limit, str(JIT_BYTES))


SMALL_ROWS = 200_000


def join_small(df: DataFrame, small: DataFrame, on: list[str], limit: int = SMALL_ROWS) -> DataFrame:
    """Inner join with a table of a few rows per key, such as one fitted number per method.

    The small side is materialised and counted; up to ``limit`` rows it is broadcast, so that
    the few keys do not gather the big side in as many tasks. Beyond that it is a plain join.
    """
    from pyspark.sql import functions as F

    small = cut_lineage(small)
    return df.join(F.broadcast(small) if small.count() <= limit else small, list(on))
