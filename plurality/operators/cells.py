"""Cells: pooling, robust normalisation, band features, completeness."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import LOG_FLOOR, NORMAL_CLIP
from ..session import cut_lineage, join_small
from .ranking import histogram_quantiles
from .splits import hash_sample


def pool_time_bins(cells: DataFrame, factor: int) -> DataFrame:
    """Merge adjacent time bins by the mean linear power of their valid cells."""
    keys = [c for c in cells.columns if c not in ("tbin", "value", "valid")]
    g = cells.groupBy(*keys, F.floor(F.col("tbin") / factor).alias("tbin")).agg(
        F.avg(F.when(F.col("valid"), F.exp("value"))).alias("m"), F.count_if("valid").alias("c"))
    ok = F.col("c") >= (factor + 1) // 2
    val = F.ln(F.greatest(F.coalesce("m", F.lit(0.0)), F.lit(LOG_FLOOR)))
    return g.select(*keys, "tbin", F.when(ok, val).otherwise(0.0).alias("value"), ok.alias("valid"))


def fit_normaliser(cells: DataFrame, by: Sequence[str] = ("view", "region"), floor: float = 1e-3) -> DataFrame:
    """Median and 1.4826 MAD of the valid cells; the deviation, else 1, where the MAD vanishes.

    Exact over every cell that is passed, by rounds of counting (:func:`histogram_quantiles`);
    the caller passes training rows only, materialised, and a bounded sample of them
    (:func:`fit_sample`) where it wants one.
    """
    v = cells.where("valid").select(*by, "value")
    med = histogram_quantiles(v, by, "value", (0.5,)).select(*by, F.col("quantile").alias("median"))
    dev = join_small(v, med, by).withColumn("dev", F.abs(F.col("value") - F.col("median")))
    mad = histogram_quantiles(dev, by, "dev", (0.5,)).select(*by, (F.col("quantile") * 1.4826).alias("mad"))
    sd = v.groupBy(*by).agg(F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n_cells"))
    s = med.join(mad, list(by)).join(sd, list(by))
    scale = F.when(F.col("mad") >= floor, F.col("mad")).when(F.col("sd") > floor, F.col("sd")).otherwise(1.0)
    return s.select(*by, "median", scale.alias("scale"), "n_cells")


def fit_sample(cells: DataFrame, rows: DataFrame, n_rows: int = 4000, max_cells: int = 2_000_000, seed: int = 20260907,
               by: Sequence[str] = ("view", "region")) -> DataFrame:
    """Valid cells of a bounded seeded sample: ``n_rows`` of ``rows``, and ``max_cells`` of each (view, region).

    Both are the smallest by a seeded hash, so the sample does not depend on partitioning. The
    cell bound is the hash at that position, found by counting; no group is sorted in a task.
    """
    c = cells.join(hash_sample(rows, "row", n_rows, seed), "row", "left_semi").where("valid")
    h = F.xxhash64(F.lit(seed), "row", "fbin", "tbin").cast("double")
    c = cut_lineage(c.withColumn("__h", h))
    n = c.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_cells)
    if n.isEmpty():
        return c.drop("__h")
    much = join_small(c, n, by)
    share = cut_lineage(n.select(*by, ((F.lit(max_cells) - 1) / (F.col("n") - 1)).alias("p")))
    limits = None
    for r in share.select("p").distinct().collect():  # as many as keys with too many cells, a handful
        here = join_small(much, share.where(F.col("p") == r["p"]), by)
        q = histogram_quantiles(here, by, "__h", (r["p"],)).select(*by, F.col("quantile").alias("limit"))
        limits = q if limits is None else limits.unionByName(q)
    kept = c.join(F.broadcast(limits), list(by), "left").where(F.col("limit").isNull() | (F.col("__h") <= F.col("limit")))
    return kept.drop("__h", "limit")


def normalise(cells: DataFrame, stats: DataFrame, by: Sequence[str] = ("view", "region")) -> DataFrame:
    """(x - median) / scale, clipped; invalid cells become 0 afterwards. The stats have one row per key."""
    x = (F.col("value") - F.col("median")) / F.col("scale")
    z = F.greatest(F.lit(-NORMAL_CLIP), F.least(x, F.lit(NORMAL_CLIP)))
    return join_small(cells, stats.select(*by, "median", "scale"), by).withColumn(
        "value", F.when(F.col("valid"), z).otherwise(0.0)).drop("median", "scale")


def valid_fractions(cells: DataFrame, keys: Sequence[str] = ("row",)) -> DataFrame:
    return cells.groupBy(*keys, "view").agg(F.avg(F.col("valid").cast("int")).alias("valid_fraction"))


def band_of(fbin, edges: Sequence[float], bands: Sequence[tuple]):
    """Band whose range holds the centre of the bin, as a Column over literal bins."""
    out = None
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        mid = (a + b) / 2
        name = next((n for n, lo, hi in bands if lo <= mid < hi), None)
        if name is not None:
            out = F.when(fbin == i, name) if out is None else out.when(fbin == i, name)
    return out


def band_features(cells: DataFrame, edges: Sequence[float], bands: Sequence[tuple], inner: dict[str, tuple[int, int]],
                  whole: Sequence[str] = ()) -> DataFrame:
    """Masked band means per view and region, and the centre against the rest (or against the whole).

    (keys, view, region, band, mean, contrast); ``inner`` gives the centre bins of each view.
    """
    mid = None
    for v, (a, b) in inner.items():
        c = (F.col("view") == v) & F.col("tbin").between(a, b - 1)
        mid = c if mid is None else mid | c
    keys = [c for c in ("condition", "recording_id", "row") if c in cells.columns]
    t = cells.withColumns({"band": band_of(F.col("fbin"), edges, bands), "mid": mid}).where(F.col("band").isNotNull())
    ok = F.col("valid")

    def mean(cond):
        n = F.count_if(cond)
        return F.coalesce(F.sum(F.when(cond, F.col("value"))), F.lit(0.0)) / F.greatest(n, F.lit(1))

    g = t.groupBy(*keys, "view", "region", "band").agg(
        mean(ok).alias("mean"), mean(ok & F.col("mid")).alias("center"), mean(ok & ~F.col("mid")).alias("outer"))
    rest = F.when(F.col("view").isin(*whole), F.col("mean")).otherwise(F.col("outer")) if whole else F.col("outer")
    return g.select(*keys, "view", "region", "band", "mean", (F.col("center") - rest).alias("contrast"))


def feature_vectors(features: DataFrame, cells: DataFrame, names: Sequence[tuple], views: Sequence[str]) -> DataFrame:
    """One row per window: every (view, region, band) mean and contrast and the valid fractions."""
    picks = []
    for v, r, b in names:
        hit = (F.col("view") == v) & (F.col("region") == r) & (F.col("band") == b)
        picks += [F.max(F.when(hit, F.col("mean"))).alias(f"{v}_{r}_{b}_mean"),
                  F.max(F.when(hit, F.col("contrast"))).alias(f"{v}_{r}_{b}_contrast")]
    keys = [c for c in ("condition", "recording_id", "row") if c in cells.columns]
    wide = features.groupBy(*keys).agg(*picks)
    frac = cells.groupBy(*keys).agg(*[
        F.avg(F.when(F.col("view") == v, F.col("valid").cast("int"))).alias(f"{v}_valid") for v in views])
    return wide.join(frac, keys)


@dataclass(frozen=True)
class ViewAxes:
    """A view's grid: regions, frequency edges, time bins, and the central time bins [a, b).

    The centre is held against the other time bins, or against all of them where ``whole``.
    """

    regions: tuple
    f_edges: tuple
    t_bins: int
    centre: tuple[int, int]
    whole: bool = False

    def bands(self, bands: Sequence[tuple]) -> dict[str, tuple[int, int]]:
        """Frequency bins [a, b) whose centres lie in each band; bands without one are left out."""
        mids = [(a + b) / 2 for a, b in zip(self.f_edges, self.f_edges[1:])]
        at = {n: [i for i, m in enumerate(mids) if lo <= m < hi] for n, lo, hi in bands}
        return {n: (i[0], i[-1] + 1) for n, i in at.items() if i}


def feature_names(views: dict[str, ViewAxes], bands: Sequence[tuple]) -> list[str]:
    """Columns of :func:`view_features`: mean and contrast by view, region and band, then the valid fractions."""
    return [f"{v}_{g}_{b}_{s}" for v, ax in views.items() for b in ax.bands(bands) for g in ax.regions for s in ("mean", "contrast")] + [f"{v}_valid" for v in views]


def normalise_grids(grids: DataFrame, stats: DataFrame, by: Sequence[str] = ("view", "region")) -> DataFrame:
    """:func:`normalise` on grids (keys, view, region, x, observed), inside their arrays."""
    z = lambda c: F.greatest(F.lit(-NORMAL_CLIP), F.least((c["x"] - F.col("median")) / F.col("scale"), F.lit(NORMAL_CLIP)))
    x = F.transform(F.arrays_zip("x", "observed"), lambda c: F.when(c["observed"], z(c)).otherwise(0.0))
    return join_small(grids, stats.select(*by, "median", "scale"), by).withColumn("x", x).drop("median", "scale")


def view_features(grids: DataFrame, views: dict[str, ViewAxes], bands: Sequence[tuple], keys: Sequence[str] = ("row",)) -> DataFrame:
    """One row per key with :func:`feature_names`, from normalised grids (keys, view, region, x, observed).

    Masked sums run over slices of the arrays, so no row per cell exists and only a few sums per
    grid are shuffled. A mean without valid cells is 0; so are the features of a view or
    region that a key lacks. Grids of other views or regions are passed over; repeated grids of one
    key, view and region count as more cells of it.
    """
    def sums(ax: ViewAxes, span: tuple[int, int], centre: bool) -> list[Column]:
        size = (span[1] - span[0]) * ax.t_bins

        def part(c: str) -> Column:
            x = F.slice(c, span[0] * ax.t_bins + 1, size)
            return F.filter(x, lambda v, i: (i % ax.t_bins).between(ax.centre[0], ax.centre[1] - 1)) if centre else x
        return [F.aggregate(part("x"), F.lit(0.0), lambda a, v: a + v), F.size(F.filter(part("observed"), lambda v: v)).cast("bigint")]

    aggs = []
    for v, ax in views.items():
        here = F.col("view") == v
        for b, span in ax.bands(bands).items():
            whole, centre = sums(ax, span, False), sums(ax, span, True)
            for g in ax.regions:
                hit = here & (F.col("region") == g)
                aggs += [F.coalesce(F.sum(F.when(hit, x)), F.lit(0)).alias(f"{v}_{g}_{b}_{n}") for n, x in zip(("s", "n", "cs", "cn"), whole + centre)]
        hit = here & F.col("region").isin(*ax.regions)
        aggs += [F.sum(F.when(hit, F.size(F.filter("observed", lambda o: o)))).alias(f"{v}_seen"), F.sum(F.when(hit, F.size("observed"))).alias(f"{v}_cells")]
    t = grids.groupBy(*keys).agg(*aggs)
    out = []
    for v, ax in views.items():
        for b in ax.bands(bands):
            for g in ax.regions:
                s, n, cs, cn = (F.col(f"`{v}_{g}_{b}_{k}`") for k in ("s", "n", "cs", "cn"))
                mean, centre = s / F.greatest(n, F.lit(1)), cs / F.greatest(cn, F.lit(1))
                rest = mean if ax.whole else (s - cs) / F.greatest(n - cn, F.lit(1))
                out += [mean.alias(f"{v}_{g}_{b}_mean"), (centre - rest).alias(f"{v}_{g}_{b}_contrast")]
    out += [F.coalesce(F.col(f"`{v}_seen`") / F.greatest(f"{v}_cells", F.lit(1)), F.lit(0.0)).alias(f"{v}_valid") for v in views]
    return t.select(*keys, *out)


def completeness(index: DataFrame, cells: DataFrame, views: Sequence[str], key: str = "row") -> DataFrame:
    """One row: windows lacking a view, and windows whose views are wholly invalid."""
    per = cells.groupBy(key).agg(*[F.max(F.when(F.col("view") == v, F.col("valid").cast("int"))).alias(f"any_{v}") for v in views],
                                 *[F.avg(F.when(F.col("view") == v, F.col("valid").cast("int"))).alias(f"frac_{v}") for v in views])
    j = index.select(key).join(per, key, "left")
    lacking = None
    empty = None
    for v in views:
        m, e = F.col(f"any_{v}").isNull(), F.coalesce(F.col(f"any_{v}") == 0, F.lit(False))
        lacking = m if lacking is None else lacking | m
        empty = e if empty is None else empty & e
    return j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(lacking).alias("n_incomplete"),
                 *[F.count_if(F.col(f"any_{v}") == 0).alias(f"all_invalid_{v}") for v in views],
                 F.count_if(empty).alias("all_invalid_both"),
                 *[F.avg(f"frac_{v}").alias(f"mean_{v}") for v in views], *[F.min(f"frac_{v}").alias(f"min_{v}") for v in views])


