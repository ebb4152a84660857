"""Scans and sinks: CSV label tables, partitioned Parquet, CSV and JSON reports, append-only ledgers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header CSV under an explicit schema; a malformed row fails the read."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def write_csv(df: DataFrame, path: str, report: bool = False) -> None:
    """CSV with header. ``report`` marks a small aggregate that goes to one file."""
    (df.coalesce(1) if report else df).write.mode("overwrite").csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet by partition columns, rows clustered by them first to keep the file count down."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; Spark's commit protocol publishes all files or none."""
    df.write.mode("overwrite").json(path)


def append_ledger(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def file_rows(df: DataFrame) -> DataFrame:
    """Row count per file of a scan; no data column is read."""
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))


def listing(spark: SparkSession, pattern: str, recursive: bool = False) -> DataFrame:
    """(path, bytes) of files; the content column is pruned, so no file is opened."""
    r = spark.read.format("binaryFile")
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.load(pattern).select("path", F.col("length").alias("bytes"))


#: files up to so many bytes are read whole
WHOLE_BYTES = 64 << 20
#: of no use to split a file at
_NEVER = str(1 << 50)


def checksums(spark: SparkSession, pattern: str) -> DataFrame:
    """SHA-256 per file, of any size: the bytes of a larger file pass through a task in lines.

    Only a line, and a file whose name tells a compression (Spark's line reader would undo it), is limited to 2 GB.
    """
    def whole(b: DataFrame) -> DataFrame:
        return b.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    files = spark.read.format("binaryFile").load(pattern)
    large = [(r.path, r.length) for r in files.where(F.col("length") > WHOLE_BYTES).select("path", "length").collect()]
    if not large:
        return whole(files)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    squeezed = [p for p, _ in large if codecs.getCodec(jvm.org.apache.hadoop.fs.Path(p)) is not None]
    out = whole(files.where(F.col("length") <= WHOLE_BYTES))  # a condition that the source checks before it opens a file
    if squeezed:
        out = out.unionByName(whole(spark.read.format("binaryFile").option("__globPaths__", "false").load(squeezed)))
    if plain := [x for x in large if x[0] not in set(squeezed)]:
        out = out.unionByName(spark.createDataFrame(_in_lines(spark, plain), "path string, bytes bigint, sha256 string"))
    return out


def _first_bytes(spark: SparkSession, path: str) -> bytes:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(b for b in (stream.read() for _ in range(3)) if b >= 0)
    finally:
        stream.close()


def _in_lines(spark: SparkSession, files: Sequence[tuple[str, int]]) -> list[tuple[str, int, str]]:
    """(path, bytes, SHA-256) of files that a task each reads as lines, put together again batch by batch."""
    mark = b"\xef\xbb\xbf"  # the line reader leaves it out at the beginning of a file
    uri = {p: spark._jvm.org.apache.hadoop.fs.Path(p).toUri().toString() for p, _ in files}  # the scan's name of a file, perhaps without an empty authority
    names = [(x, p) for p, u in uri.items() for x in {u, u.replace("file:/", "file:///", 1), u.replace("file:///", "file:/", 1)}]
    keyed = {r.key: r.path for r in spark.createDataFrame(names, "name string, path string").select("path", F.xxhash64("name").alias("key")).collect()}
    length = {k: dict(files)[p] for k, p in keyed.items()}
    begins = {p: mark if _first_bytes(spark, p) == mark else b"" for p in uri}
    start = {k: begins[p] for k, p in keyed.items()}

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if key is None:
                key = batch.column(1)[0].as_py()
                sha, left = hashlib.sha256(start[key]), length[key] - len(start[key])
            for i in range(0, batch.num_rows, 4096):
                lines = batch.column(0).slice(i, 4096)
                part = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), b"\n")[0].as_buffer()
                sha.update(part)
                left -= part.size
                if left > 0:
                    sha.update(b"\n")
                    left -= 1
        if key is not None:
            if left:
                raise ValueError(f"a file changed while it was read, or was read in part: {left} bytes are left")
            yield pa.RecordBatch.from_pydict({"key": [key], "sha256": [sha.hexdigest()]})

    # a file must be one split and a split one file; a read takes its sizes from the session
    held = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in held:
            spark.conf.set(c, _NEVER)
        lines = spark.read.option("__globPaths__", "false").text([p for p, _ in files], lineSep="\n")
        rows = lines.select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("key"))
        found = rows.mapInArrow(digest, "key bigint, sha256 string").collect()
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    return [(keyed[r.key], length[r.key], r.sha256) for r in found]
