"""Exact global order inside large groups, without a one-task window.

``Window.partitionBy(method).orderBy(score)`` would sort a whole method in one task. Here the
rows are range-partitioned on (group keys, order keys), which splits any group, and any run of
equal scores, over many tasks; a table of per-partition totals (one row per partition and
group) then gives each partition its offset. The range-partitioned rows are checkpointed,
because range bounds are sampled and must not move between the two passes. The partitions are
sorted before the checkpoint, so that a row's place in it and its offset give the rank and the rows are
shuffled once; running sums of whole numbers are added up along the partition in the same way. Other
sums would lose digits to the keys before them, so these restart per key, which takes a second shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import SMALL_ROWS, cut_lineage, join_small


def ordered_prefix(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
                   sums: Mapping[str, Column] | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``rank`` (1-based), ``n_total`` and, per measure, ``cum_<m>`` (inclusive) and ``all_<m>``.

    ``order`` must end in a unique key for the ranks to be unique. The offset windows run over
    one row per (key, range partition), so even without keys they hold no more rows than there
    are partitions.
    """
    sums = dict(sums or {})
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not sums:
        return _ranked(df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order), by)
    marked = df.withColumns({f"__m_{k}": c for k, c in sums.items()}) if sums else df
    ranged = marked.repartitionByRange(n, *by, *order)
    if all(isinstance(marked.schema[f"__m_{k}"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) for k in sums):
        return _running(ranged.sortWithinPartitions(*by, *order), by, df.columns, list(sums))
    ranged = cut_lineage(ranged.withColumn("__pid", F.spark_partition_id()))

    per = ranged.groupBy(*by, "__pid").agg(
        F.count(F.lit(1)).alias("__cnt"), *[F.sum(f"__m_{k}").alias(f"__t_{k}") for k in sums])
    before = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    zero = F.lit(0)
    offsets = per.select(
        *by, "__pid",
        F.coalesce(F.sum("__cnt").over(before), zero).alias("__off"),
        F.sum("__cnt").over(whole).alias("n_total"),
        *[F.coalesce(F.sum(f"__t_{k}").over(before), zero).alias(f"__o_{k}") for k in sums],
        *[F.sum(f"__t_{k}").over(whole).alias(f"all_{k}") for k in sums])

    local = Window.partitionBy(*by, "__pid").orderBy(*order)
    running = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.select(
        *[c for c in ranged.columns if not c.startswith("__m_")],
        F.row_number().over(local).alias("__rn"),
        *[F.sum(f"__m_{k}").over(running).alias(f"__r_{k}") for k in sums])
    joined = placed.join(offsets, [*by, "__pid"])
    return joined.select(
        *df.columns, (F.col("__off") + F.col("__rn")).cast("bigint").alias("rank"), "n_total",
        *[(F.col(f"__o_{k}") + F.col(f"__r_{k}")).alias(f"cum_{k}") for k in sums],
        *[f"all_{k}" for k in sums])


def _ranked(ranged: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rank`` and ``n_total`` of rows that lie in order, over the partitions and within them."""
    placed = cut_lineage(ranged.withColumns({"__pid": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    per = placed.groupBy(*by, "__pid").agg(F.count(F.lit(1)).alias("__cnt"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*by, "__pid", (F.coalesce(F.sum("__cnt").over(before), F.lit(0)) - F.col("__first") + 1).alias("__off"),
                         F.sum("__cnt").over(Window.partitionBy(*by)).alias("n_total"))
    joined = join_small(placed, offsets, [*by, "__pid"])
    return joined.select(*ranged.columns, (F.col("__at") + F.col("__off")).cast("bigint").alias("rank"), "n_total")


def _running(ranged: DataFrame, by: Sequence[str], columns: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Ranks and running sums of rows that lie in order: sums run along the whole partition, over all its keys.

    What a key's first row had before it is taken off with the offsets. Whole numbers lose nothing by that; a null adds nothing.
    """
    measures = [f"__m_{k}" for k in sums]
    at = [ranged.columns.index(c) for c in measures]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = [0] * len(at)
        for batch in batches:
            out = []
            for j, i in enumerate(at):
                total = pc.add(pc.cumulative_sum(pc.fill_null(batch.column(i).cast(pa.int64()), 0)), carried[j])
                carried[j] = total[-1].as_py() if len(total) else carried[j]
                out.append(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], names=names)

    runs = [f"__r_{k}" for k in sums]
    names = [*ranged.columns, *runs]
    schema = T.StructType([*ranged.schema.fields, *[T.StructField(r, T.LongType()) for r in runs]])
    placed = ranged.mapInArrow(run, schema).withColumns({"__pid": F.spark_partition_id(), "__at": F.monotonically_increasing_id()})
    placed = cut_lineage(placed)
    zero = F.lit(0).cast("bigint")
    per = placed.groupBy(*by, "__pid").agg(
        F.count(F.lit(1)).alias("__cnt"), F.min("__at").alias("__first"), *[F.sum(m).alias(f"__t_{k}") for k, m in zip(sums, measures)],
        *[F.min_by(F.col(r) - F.coalesce(F.col(m), zero), "__at").alias(f"__s_{k}") for k, m, r in zip(sums, measures, runs)])
    before = Window.partitionBy(*by).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = per.select(
        *by, "__pid", (F.coalesce(F.sum("__cnt").over(before), zero) - F.col("__first") + 1).alias("__off"), F.sum("__cnt").over(whole).alias("n_total"),
        *[(F.coalesce(F.sum(f"__t_{k}").over(before), zero) - F.col(f"__s_{k}")).alias(f"__o_{k}") for k in sums],
        *[F.sum(f"__t_{k}").over(whole).alias(f"all_{k}") for k in sums])
    joined = join_small(placed, offsets, [*by, "__pid"])
    return joined.select(
        *columns, (F.col("__at") + F.col("__off")).cast("bigint").alias("rank"), "n_total",
        *[(F.col(f"__o_{k}") + F.col(f"__r_{k}")).alias(f"cum_{k}") for k in sums], *[f"all_{k}" for k in sums])


def global_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return ordered_prefix(df, by, order)


def row_index(df: DataFrame, key: str, shard_rows: int) -> DataFrame:
    """0-based dense row number by key, with shard and position inside the shard."""
    ranked = ordered_prefix(df, [], [key])
    row = F.col("rank") - 1
    return ranked.withColumns({
        "row": row, "shard": F.floor(row / shard_rows), "pos": F.pmod(row, F.lit(shard_rows)),
    }).drop("rank", "n_total")


def equal_count_bin(rank: Column, n: Column, k: int) -> Column:
    """0-based bin of a 1-based rank when n rows are split into k near-equal runs."""
    base = F.floor(n / k)
    rem = F.pmod(n, F.lit(k))
    head = rem * (base + 1)
    return F.when(rank <= head, F.floor((rank - 1) / (base + 1))).otherwise(
        rem + F.floor((rank - 1 - head) / F.greatest(base, F.lit(1)))).cast("bigint")


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Average rank of each distinct value per group: (by, value, n_at, avg_rank, n_total rows)."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_at"))
    p = ordered_prefix(counts, by, [value], {"n": F.col("n_at")})
    return p.select(*by, value, "n_at", (F.col("cum_n") - (F.col("n_at") - 1) / 2.0).alias("avg_rank"),
                    F.col("all_n").alias("n_rows"))


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles of any number of rows: (by, prob, quantile).

    Distinct values are counted first; the order positions are then read off running counts,
    so no task holds a whole group as ``percentile`` would.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_at"))
    p = ordered_prefix(counts, by, [value], {"n": F.col("n_at")})
    wants = []
    for pr in probs:
        h = (F.col("all_n") - 1) * F.lit(float(pr))
        for side, pos in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            inside = (pos >= F.col("cum_n") - F.col("n_at")) & (pos < F.col("cum_n"))
            wants.append(F.when(inside, F.struct(F.lit(float(pr)).alias("prob"), F.lit(side).alias("side"),
                                                 (h - F.floor(h)).alias("frac"))))
    hits = p.withColumn("w", F.explode(F.filter(F.array(*wants), lambda x: x.isNotNull())))
    return hits.groupBy(*by, F.col("w.prob").alias("prob")).agg(
        F.max(F.when(F.col("w.side") == "lo", F.col(value))).alias("lo"),
        F.max(F.when(F.col("w.side") == "hi", F.col(value))).alias("hi"),
        F.max("w.frac").alias("frac"),
    ).select(*by, "prob", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("frac")).alias("quantile"))


#: buckets of one round of refinement
BUCKETS = 4096


def histogram_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles without a sort: (by, prob, quantile, n).

    Each wanted position starts with its key's range. A round counts the values inside the range
    in ``BUCKETS`` even buckets, keeping each bucket's count, least and greatest value, and goes
    on with the bucket that holds the position; it ends when least and greatest are one value.
    Counts merge map-side, so a round shuffles at most ``BUCKETS`` rows per position and task
    whatever the number of values. A round narrows a range 4,096-fold, so few are needed. ``df`` is
    read once per round: pass a materialised one. Nulls and NaN are left out.
    """
    v = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*by, F.col(value).cast("double").alias("__v"))
    ends = cut_lineage(v.groupBy(*by).agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.count(F.lit(1)).alias("n")))
    h = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(x), F.ceil(x)) for x in h])))
    found = cut_lineage(ends.select(*by, "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.explode(places).alias("place")))
    keys = [*by, "place"]
    run = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while n_wide := (wide := found.where("lo < hi")).count():
        bounds = wide.select(*keys, F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "below")
        bounds = F.broadcast(bounds) if n_wide <= SMALL_ROWS else bounds  # a row per position of a key
        inside = (v.join(bounds, list(by)) if by else v.crossJoin(bounds)).where(F.col("__v").between(F.col("__lo"), F.col("__hi")))
        low, high = F.col("__lo"), F.col("__hi")
        # the width of two doubles may exceed the largest one; their halves' does not
        # a range of many magnitudes is cut by magnitude, else its small values would all share the first bucket round after round
        share = F.when((low > 0) & (high / 2 ** 20 > low), (F.ln("__v") - F.ln(low)) / (F.ln(high) - F.ln(low))).when(high - low < float("inf"), (F.col("__v") - low) / (high - low)).otherwise((F.col("__v") / 2 - low / 2) / (high / 2 - low / 2))
        bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).alias("bucket")
        counts = inside.groupBy(*keys, "below", bucket).agg(F.count(F.lit(1)).alias("c"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
        counts = counts.withColumn("upto", F.col("below") + F.sum("c").over(run))
        hit = counts.where((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("c") <= F.col("place")))
        found = cut_lineage(hit.select(*by, "lo", "hi", (F.col("upto") - F.col("c")).alias("below"), "place").unionByName(found.where("lo = hi")))
    at = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("place", "lo"))).alias("at"))
    n = ends.select(*by, "n")
    both = n.join(at, list(by)) if by else n.crossJoin(at)
    pick = lambda x: F.element_at("at", x)
    answers = [F.struct(F.lit(float(p)).alias("prob"), (pick(F.floor(x)) + (pick(F.ceil(x)) - pick(F.floor(x))) * (x - F.floor(x))).alias("quantile")) for p, x in zip(probs, h)]
    return both.select(*by, "n", F.explode(F.array(*answers)).alias("z")).select(*by, "z.prob", "z.quantile", "n")


def _midranks(pairs: DataFrame, by: Sequence[str], value: str, other: str) -> DataFrame:
    """``pairs`` with ``__mid``, the average rank of ``value`` among the rows that the pairs count (``__n`` each).

    Pairs are ordered by (value, other), so the pairs of one value are consecutive, perhaps over several partitions.
    Counts per value inside a partition and of the partitions before give each its first and last place.
    """
    p = ordered_prefix(pairs, by, [value, other], {"n": F.col("__n")})
    p = cut_lineage(p.withColumn("__part", F.spark_partition_id()))
    inside = p.groupBy(*by, value, "__part").agg(F.min(F.col("cum_n") - F.col("__n")).alias("__lo"), F.max("cum_n").alias("__hi"))
    run = Window.partitionBy(*by, value)
    ends = inside.select(*by, value, "__part", F.min("__lo").over(run).alias("__lo"), F.max("__hi").over(run).alias("__hi"))  # a value has one row per partition
    j = p.join(ends, [*by, value, "__part"])
    return j.withColumn("__mid", (F.col("__lo") + F.col("__hi") + 1) / 2.0).select(*pairs.columns, "__mid")


def _moments(df: DataFrame, by: Sequence[str], a: str, b: str, counts: DataFrame) -> DataFrame:
    """Sums of midranks where b has few values, whose ``counts`` are a small table: (by, n, sx, sy, sxy, sxx, syy).

    The midranks of b are a window over that table and go to the rows by broadcast; the rows become one per
    distinct a with the sums of b's midranks, and only these are ordered. A null is ranked but not summed.
    """
    run = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rb = counts.select(*by, b, (F.sum("__n").over(run) - (F.col("__n") - 1) / 2.0).alias("__rb")).where(F.col(b).isNotNull())
    y = F.col("__rb")
    per = df.select(*by, a, b).join(F.broadcast(rb), [*by, b], "left").groupBy(*by, a).agg(
        F.count(F.lit(1)).alias("__n"), F.count(y).alias("__w"), F.sum(y).alias("__y"), F.sum(y * y).alias("__yy"))
    p = ordered_prefix(per, by, [a], {"n": F.col("__n")}).where(F.col(a).isNotNull() & (F.col("__w") > 0))
    x, w = F.col("cum_n") - (F.col("__n") - 1) / 2.0, F.col("__w").cast("double")
    return p.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum("__y").alias("sy"), F.sum(x * F.col("__y")).alias("sxy"),
                              F.sum(w * x * x).alias("sxx"), F.sum("__yy").alias("syy"))


def spearman(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks; NULL for constant input or fewer than two rows.

    Where b has at most ``SMALL_ROWS`` values, all keys together, its ranks are broadcast (:func:`_moments`);
    pass the coarser measure as b. Otherwise rows become counts of distinct (a, b) pairs, so whatever follows
    grows with the pairs. The midranks of a are running sums over pairs in the order of a, spread over the pairs
    of one a by the same range partitioning; no shuffled join has a value as its key, so ties are never gathered in a task.
    """
    counts = cut_lineage(df.groupBy(*by, b).agg(F.count(F.lit(1)).alias("__n")))
    if counts.count() <= SMALL_ROWS:
        agg = _moments(df, by, a, b, counts)
    else:
        pairs = cut_lineage(df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("__n")))
        ra = _midranks(pairs, by, a, b).select(*by, a, b, "__n", F.col("__mid").alias("__ra"))
        j = _midranks(ra, by, b, a).withColumnRenamed("__mid", "__rb")
        x, y, w = F.col("__ra"), F.col("__rb"), F.col("__n").cast("double")
        agg = j.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"),
                                 F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"))
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    rho = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx) / F.sqrt(vy)
    return agg.select(*by, F.when((vx > 0) & (vy > 0), rho).alias("spearman"))
