"""Text scans and publishing policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (ALLOWED_EXTENSIONS, FORBIDDEN_EXTENSIONS, FORBIDDEN_NAMES, IDENTIFIER_PATTERN, MAX_EXPORT_BYTES,
                         MAX_FILE_BYTES, SECRET_PATTERNS)

#: Names of columns that identify persons, recordings or rows
IDENTIFIER_COLUMNS = ("patient_id", "eeg_id", "eeg_sub_id", "spectrogram_id", "spectrogram_sub_id", "label_id", "component")


def pattern_scan(df: DataFrame, key: Sequence[str], text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, pattern, hits): every pattern counted over the whole text in one pass, rows with hits only."""
    found = F.array(*[
        F.struct(F.lit(name).alias("pattern"), F.regexp_count(F.col(text), F.lit(p)).cast("bigint").alias("hits"))
        for name, p in patterns.items()])
    hit = F.filter(found, lambda z: z["hits"] > 0)
    return df.select(*key, F.explode(hit).alias("z")).select(*key, "z.pattern", "z.hits")


def secret_patterns(extra: dict[str, str] | None = None) -> dict[str, str]:
    return {**{f"secret{i}": p for i, p in enumerate(SECRET_PATTERNS)}, **(extra or {})}


def identifier_values(df: DataFrame, key: Sequence[str], text: str, pattern: str = IDENTIFIER_PATTERN) -> DataFrame:
    """Identifier column names followed by a long number."""
    return df.select(*key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("found"))


def extension(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def listing_problems(files: DataFrame) -> DataFrame:
    """(path, problem) for a listing with path and bytes: forbidden, not allowed, too large."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    ext = extension(F.col("path"))
    problem = (F.when(name.isin(*FORBIDDEN_NAMES) | ext.isin(*FORBIDDEN_EXTENSIONS), "forbidden file")
               .when(~ext.isin(*ALLOWED_EXTENSIONS), "extension not allowed")
               .when(F.col("bytes") > MAX_FILE_BYTES, "file too large"))
    return files.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("path", "bytes", "problem")


def precheck(files: DataFrame, cap: int = MAX_EXPORT_BYTES) -> DataFrame:
    """One row: files, bytes, problems and the resulting status."""
    bad = listing_problems(files).agg(F.count(F.lit(1))).scalar()
    out = files.agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("total_bytes")).withColumn("n_problems", bad)
    over = F.col("total_bytes") > cap
    return out.withColumn("over_cap", over).withColumn(
        "status", F.when((F.col("n_problems") == 0) & ~over, "PASS").otherwise("FAIL"))


def non_finite_counts(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(bad(c)).alias(f"bad_{c}") for c in columns])


def identifier_columns(columns: Sequence[str], names: Sequence[str] = IDENTIFIER_COLUMNS) -> list[str]:
    """Columns of a table to be published that carry identifiers by their name."""
    return [c for c in columns if c.lower() in names or c.lower().endswith("_id")]


def path_like(value: Column) -> Column:
    """Whether a text is an absolute path of a file system or holds one."""
    return F.coalesce(value.rlike(r"(?:^|[\s\"'=(])(?:/(?:home|root|Users|mnt|data|tmp|var)/|[A-Za-z]:\\\\)"), F.lit(False))


def publishing_check(df: DataFrame, by: Sequence[str], numbers: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """What must be zero before a table is published: values that are not finite, texts with paths, identifier columns."""
    bad = non_finite_counts(df, by, numbers)
    paths = df.groupBy(*by).agg(*[F.count_if(path_like(F.col(c))).alias(f"paths_{c}") for c in texts])
    return bad.join(paths, list(by)).withColumn("id_columns", F.lit(len(identifier_columns([*by, *numbers, *texts]))).cast("bigint"))
