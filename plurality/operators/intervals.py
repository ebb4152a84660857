"""Time and frequency bins, interval overlaps, window bounds and extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FOVEATED_SEGMENTS, SAMPLE_RATE_HZ, WINDOW_SECONDS
from ..session import join_small
from .ranking import ordered_prefix


# --- bin edges: short Python lists, at most a few dozen numbers --------------------------
def foveated_edges(n_bins: int = 32, scale: float = 1.0) -> list[float]:
    """Half of the bins on the labelled centre; 8, 16 or 32 bins only."""
    full = sum(n for _, _, n in FOVEATED_SEGMENTS)
    if n_bins not in (full // 4, full // 2, full):
        raise ValueError("foveated bins come in 8, 16 or 32")
    edges = [0.0]
    for lo, hi, n in FOVEATED_SEGMENTS:
        m = n * n_bins // full
        edges += [(lo + (hi - lo) * (i + 1) / m) * scale for i in range(m)]
    return edges


def uniform_edges(n_bins: int, lo: float, hi: float) -> list[float]:
    return [lo + (hi - lo) * i / n_bins for i in range(n_bins + 1)]


def edge_structs(edges: Sequence[float]) -> Column:
    """Constant array of (bin, lo, hi)."""
    return F.array(*[F.struct(F.lit(i).cast("bigint").alias("bin"), F.lit(float(a)).alias("lo"), F.lit(float(b)).alias("hi"))
                     for i, (a, b) in enumerate(zip(edges, edges[1:]))])


def overlapping_bins(lo: Column, hi: Column, edges: Sequence[float]) -> Column:
    """Array of (bin, weight): bins that [lo, hi) overlaps and by how much.

    The bins are a literal array, so the range join with them is an explode: no join, no shuffle.
    """
    hits = F.transform(edge_structs(edges), lambda e: F.struct(
        e["bin"].alias("bin"), (F.least(hi, e["hi"]) - F.greatest(lo, e["lo"])).alias("weight")))
    return F.filter(hits, lambda e: e["weight"] > 0)


def touched_range(lo: Column, hi: Column, edges: Sequence[float]) -> Column:
    """Struct (first, last) of the bins that [lo, hi) overlaps."""
    b = F.transform(overlapping_bins(lo, hi, edges), lambda e: e["bin"])
    return F.struct(F.array_min(b).alias("first"), F.array_max(b).alias("last"))


def center_weights(edges: Sequence[float], center: tuple[float, float]) -> list[float]:
    """Share of each bin inside the centre interval."""
    return [max(min(b, center[1]) - max(a, center[0]), 0.0) / (b - a) for a, b in zip(edges, edges[1:])]


def bin_of(x: Column, edges: Sequence[float]) -> Column:
    """Bin index of a point in [first edge, last edge), by comparisons in codegen."""
    out = F.lit(0)
    for e in edges[1:-1]:
        out = out + (x >= float(e)).cast("int")
    return F.when((x >= float(edges[0])) & (x < float(edges[-1])), out).cast("bigint")


# --- windows -------------------------------------------------------------------------------
def window_bounds(offset: Column, rate: int = SAMPLE_RATE_HZ, seconds: int = WINDOW_SECONDS) -> tuple[Column, Column]:
    start = F.rint(offset * rate).cast("bigint")
    return start, start + rate * seconds


#: windows that share one copy of a block and its neighbour; a block that more windows start in is copied
WINDOWS_PER_COPY = 64


def array_blocks(series: DataFrame, length: int, rec: str = "recording_id") -> DataFrame:
    """Blocks (rec, channel, block, x) of ``length`` samples from one array per recording and channel; no shuffle."""
    last = F.floor((F.size("x") - 1) / length).cast("bigint")
    b = series.where(F.size("x") > 0).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return b.select(rec, "channel", "block", F.expr(f"slice(x, cast(block * {length} + 1 as int), {length})").alias("x"))


def sample_blocks(samples: DataFrame, length: int, rec: str = "recording_id") -> DataFrame:
    """Blocks from one row per sample (rec, channel, sample, x); a null value becomes NaN, a sample without a row null."""
    at = F.pmod(F.col("sample"), F.lit(length)).cast("int")
    value = F.coalesce(F.col("x").cast("double"), F.lit(float("nan")))
    g = samples.groupBy(rec, "channel", F.floor(F.col("sample") / length).cast("bigint").alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct(at.alias("at"), value.alias("x")))).alias("m"), F.max(at).alias("last"))
    return g.select(rec, "channel", "block", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.col("m")[i]).alias("x"))


def extract_windows(blocks: DataFrame, windows: DataFrame, length: int, rec: str = "recording_id") -> DataFrame:
    """Fixed-length windows (rec, row, start, parts, channels): the stretches of each channel that a window covers.

    ``channels`` lists the channels that the recording has, in this window or elsewhere. ``parts`` holds (channel, pos, x): samples from position ``pos`` of the window on, NaN where
    the value and null where the sample is missing; positions in no part are out of range. A
    window never shifts or wraps.

    A window lies in the block it starts in and the next one, so each block is sent to itself
    and to the block before, both meet as one row per (rec, block), and windows join that row:
    no row per sample anywhere. Blocks in which no window starts are not shuffled, those in
    which more than ``WINDOWS_PER_COPY`` start are copied, so a hot block spreads over tasks.
    """
    w = windows.select(rec, "row", "start", F.floor(F.col("start") / length).cast("bigint").alias("__b"))
    per = w.groupBy(rec, "__b").agg(F.ceil(F.count(F.lit(1)) / WINDOWS_PER_COPY).cast("int").alias("__copies"))
    has = blocks.groupBy(rec).agg(F.sort_array(F.collect_set("channel")).alias("channels"))
    both = blocks.withColumn("__b", F.explode(F.array(F.col("block"), F.col("block") - 1)))
    per = per.join(has, rec, "left")
    both = join_small(both, per.drop("channels"), [rec, "__b"]).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    halo = both.groupBy(rec, "__b", "__copy").agg(F.collect_list(F.struct("channel", "block", "x")).alias("__near"))
    dealt = join_small(w, per, [rec, "__b"]).withColumn("__copy", F.pmod(F.xxhash64("row"), F.col("__copies")).cast("int"))
    near = dealt.join(halo, [rec, "__b", "__copy"], "left")
    first = f"greatest(start - p.block * {length}, 0)"
    part = f"struct(p.channel as channel, cast(p.block * {length} + {first} - start as int) as pos, slice(p.x, cast({first} + 1 as int), cast(greatest(least(start + {length} - p.block * {length}, size(p.x)) - {first}, 0) as int)) as x)"
    parts = F.expr(f"filter(transform(coalesce(__near, array()), p -> {part}), p -> size(p.x) > 0)")
    return near.select(rec, "row", "start", parts.alias("parts"), "channels")


def select_rows(rows: DataFrame, labels: DataFrame, key: str, lo: str, hi: str, span: float, block: float) -> DataFrame:
    """Rows whose [lo, hi) overlaps [offset, offset + span): coverage, count and first row per label.

    Both sides meet on (key, time block); a row longer than a block is listed in each it touches
    and the pair is kept only in the block where it first can meet, so no pair counts twice.
    """
    def blocks(a: Column, b: Column) -> Column:
        return F.sequence(F.floor(a / block), F.ceil(b / block) - 1)

    r = rows.withColumn("__b", F.explode(blocks(F.col(lo), F.col(hi))))
    e = labels.withColumn("__b", F.explode(blocks(F.col("offset"), F.col("offset") + span)))
    j = r.join(e, [key, "__b"])
    start = F.greatest(F.col(lo), F.col("offset"))
    stop = F.least(F.col(hi), F.col("offset") + span)
    return j.where((stop > start) & (F.floor(start / block) == F.col("__b"))).withColumn("covered", stop - start).drop("__b")


def spacing_check(df: DataFrame, key: str, time: str, tol: float = 1e-6) -> DataFrame:
    """Per key: rows, steps that do not increase, and steps unlike the first one.

    Positions come from the global order, neighbours from an equi-join on (key, position), so a
    long series is not windowed in one task.
    """
    r = ordered_prefix(df.select(key, time), [key], [time])
    nxt = r.select(key, (F.col("rank") - 1).alias("rank"), F.col(time).alias("__t1"))
    steps = r.select(key, "rank", time).join(nxt, [key, "rank"]).withColumn("dt", F.col("__t1") - F.col(time))
    first = steps.where("rank = 1").select(key, F.col("dt").alias("h"))
    s = steps.join(first, key).groupBy(key).agg(
        (F.count(F.lit(1)) + 1).alias("n_rows"), F.count_if(F.col("dt") <= 0).alias("not_increasing"),
        F.count_if(F.abs(F.col("dt") - F.col("h")) > tol).alias("off_spacing"), F.max("h").alias("spacing"))
    return s
