"""Calibration bins, risk-coverage, thresholds, ROC and precision-recall."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..session import join_small
from .ranking import equal_count_bin, ordered_prefix
from .scorecells import cut_rows

GRID = 51  # coverages 0.50, 0.51, ..., 1.00


# --- calibration ---------------------------------------------------------------------
def confidence_rows(df: DataFrame, observed: str = "soft") -> DataFrame:
    """confidence = largest probability; observed = vote mass (soft) or hit indicator (majority)."""
    conf = fn.top_mass(fn.cols("c"))
    if observed == "majority":
        df = df.where(F.col("y") >= 0)
        obs = (F.col("yhat") == F.col("y")).cast("double")
    else:
        obs = fn.pick(fn.cols("q"), F.col("yhat"))
    return df.withColumns({"confidence": conf, "observed": obs})


def equal_count_bins(df: DataFrame, by: Sequence[str], score: str, key: str, k: int) -> DataFrame:
    ranked = ordered_prefix(df, by, [score, key])
    return ranked.withColumn("bin", equal_count_bin(F.col("rank"), F.col("n_total"), k)).drop("rank", "n_total")


def merged_bins(binned: DataFrame, by: Sequence[str], group: str, k: int, min_groups: int) -> DataFrame:
    """(by, bin, merged): neighbours joined until each run has ``min_groups`` distinct groups.

    A group repeats across bins, so counts cannot be added. Each group is reduced to the bit
    mask of the bins it touches; at most 2^k mask counts per key are left to fold, whatever
    the number of rows or groups.
    """
    if not 1 <= k <= 16:
        raise ValueError("bin masks are kept for at most 16 bins")
    masks = binned.groupBy(*by, group).agg(
        F.bit_or(F.expr("shiftleft(1, int(bin))")).alias("mask"))
    counts = masks.groupBy(*by, "mask").agg(F.count(F.lit(1)).alias("groups"))
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, groups = pdf["mask"].to_numpy(), pdf["groups"].to_numpy()
        present = 0
        for m in mask:
            present |= int(m)
        runs = [[b] for b in range(k) if present >> b & 1]

        def size(run: list) -> int:
            bits = sum(1 << b for b in run)
            return int(groups[(mask & bits) != 0].sum())

        while len(runs) > 1:
            sizes = [size(x) for x in runs]
            low = next((i for i, s in enumerate(sizes) if s < min_groups), None)
            if low is None:
                break
            left = sizes[low - 1] if low > 0 else None
            right = sizes[low + 1] if low + 1 < len(runs) else None
            at = low if left is None or (right is not None and right < left) else low - 1
            runs[at: at + 2] = [runs[at] + runs[at + 1]]
        rows = [(b, i) for i, run in enumerate(runs) for b in run]
        out = pd.DataFrame(rows, columns=["bin", "merged"])
        for c in by:
            out[c] = pdf[c].iloc[0]
        return out[[*by, "bin", "merged"]]

    keys = [f.simpleString().replace(":", " ", 1) for f in binned.select(*by).schema.fields]
    schema = ", ".join([*keys, "bin bigint", "merged bigint"])
    return counts.groupBy(*by).applyInPandas(fold, schema)


def bin_table(binned: DataFrame, by: Sequence[str], group: str | None = None, bin_col: str = "bin") -> DataFrame:
    aggs = [F.min("confidence").alias("lower"), F.max("confidence").alias("upper"),
            F.avg("confidence").alias("mean_confidence"), F.avg("observed").alias("mean_observed"),
            F.count(F.lit(1)).alias("n_rows")]
    if group:
        aggs.append(F.count_distinct(group).alias("n_groups"))
    return binned.groupBy(*by, bin_col).agg(*aggs)


def ece(bins: DataFrame, by: Sequence[str]) -> DataFrame:
    gap = F.abs(F.col("mean_confidence") - F.col("mean_observed"))
    return bins.groupBy(*by).agg(
        (F.sum(gap * F.col("n_rows")) / F.sum("n_rows")).alias("ece"), F.max(gap).alias("mce"),
        F.count(F.lit(1)).alias("n_bins"), F.sum("n_rows").alias("n_rows"))


def soft_ece(df: DataFrame, by: Sequence[str], key: str, k: int = 10, group: str | None = None,
             min_groups: int = 20, observed: str = "soft") -> DataFrame:
    """Expected calibration error in equal-count bins, merged when a group column is given."""
    rows = confidence_rows(df, observed).select(*by, key, "confidence", "observed", *([group] if group else []))
    binned = equal_count_bins(rows, by, "confidence", key, k)
    if group:
        binned = join_small(binned, merged_bins(binned, by, group, k, min_groups), [*by, "bin"]).drop("bin")
        return ece(bin_table(binned, by, None, "merged"), by)
    return ece(bin_table(binned, by), by)


# --- risk-coverage -------------------------------------------------------------------
def accepted_rows(coverage: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.rint(coverage * n), n)).cast("bigint")


def grid_coverage(i: Column) -> Column:
    return (i + 50) / 100.0


def _grid_bucket(rank: Column, n: Column) -> Column:
    """Smallest grid index whose accepted prefix contains the rank."""
    guess = F.greatest(F.lit(0), F.ceil(100.0 * rank / n) - 50 - 1)
    step0 = accepted_rows(grid_coverage(guess), n) >= rank
    step1 = accepted_rows(grid_coverage(guess + 1), n) >= rank
    return F.least(F.when(step0, guess).when(step1, guess + 1).otherwise(guess + 2), F.lit(GRID - 1)).cast("bigint")


def risk_coverage(df: DataFrame, by: Sequence[str], score: str, risk: str, key: str,
                  group: str | None = None) -> DataFrame:
    """Risk of the lowest-score rows at 51 coverages, row-weighted and optionally group-weighted.

    One global order; the rows collapse into 51 buckets per key, so the curve is a running sum
    over bucket totals. The group-weighted curve adds per bucket the change of each group's
    running mean, which avoids carrying every group through all 51 coverages.
    """
    cols = [*by, key, score, risk, *([group] if group else [])]
    ranked = ordered_prefix(df.select(*cols), by, [score, key])
    ranked = ranked.withColumn("bucket", _grid_bucket(F.col("rank"), F.col("n_total")))
    per = ranked.groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("c"), F.sum(risk).alias("s"), F.max(score).alias("top"),
        F.max("n_total").alias("n_total"))
    if group:
        gb = ranked.groupBy(*by, group, "bucket").agg(F.count(F.lit(1)).alias("c"), F.sum(risk).alias("s"))
        w = Window.partitionBy(*by, group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        gb = gb.withColumns({"cc": F.sum("c").over(w), "ss": F.sum("s").over(w)})
        now, prev_c = F.col("ss") / F.col("cc"), F.col("cc") - F.col("c")
        before = F.when(prev_c > 0, (F.col("ss") - F.col("s")) / F.nullif(prev_c, F.lit(0))).otherwise(0.0)
        moves = gb.groupBy(*by, "bucket").agg(
            F.sum(now - before).alias("dm"), F.count_if(prev_c == 0).alias("dg"))
        per = per.join(moves, [*by, "bucket"])
    return _curve(per, by, group)


def risk_coverage_of_cuts(df: DataFrame, by: Sequence[str], score: str, risk: str, key: str) -> DataFrame:
    """:func:`risk_coverage` by rows of which only those near a coverage are ordered; the others are counted in cells. ``df`` is read three times."""
    cells, rows = cut_rows(df, by, score, risk, key, key, lambda first, last, n: _grid_bucket(first, n) != _grid_bucket(last, n))
    cells = cells.select(*by, _grid_bucket(F.col("before") + 1, F.col("n_total")).alias("bucket"), F.col("n").alias("c"), "s", "top", "n_total")
    rows = rows.select(*by, _grid_bucket(F.col("rank"), F.col("n_total")).alias("bucket"), F.lit(1).cast("bigint").alias("c"), F.col(risk).alias("s"), F.col(score).alias("top"), "n_total")
    per = cells.unionByName(rows).groupBy(*by, "bucket").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.max("top").alias("top"), F.max("n_total").alias("n_total"))
    return _curve(per, by)


def _curve(per: DataFrame, by: Sequence[str], group: str | None = None) -> DataFrame:
    """The curve from rows, risk and greatest score per bucket."""
    totals = per.groupBy(*by).agg(F.max("n_total").alias("n_total"))
    steps = F.sequence(F.lit(0).cast("bigint"), F.lit(GRID - 1).cast("bigint"))
    grid = totals.select(*by, "n_total", F.explode(steps).alias("bucket"))
    full = grid.join(per.drop("n_total"), [*by, "bucket"], "left")
    w = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    out = [
        F.sum(F.coalesce("c", F.lit(0))).over(w).alias("n_accepted"),
        (F.sum(F.coalesce("s", F.lit(0.0))).over(w) / F.sum(F.coalesce("c", F.lit(0))).over(w)).alias("risk"),
        F.max("top").over(w).alias("threshold"),
    ]
    if group:
        out.append((F.sum(F.coalesce("dm", F.lit(0.0))).over(w) / F.sum(F.coalesce("dg", F.lit(0))).over(w))
                   .alias("group_risk"))
    return full.select(*by, "bucket", grid_coverage(F.col("bucket")).alias("coverage"), "n_total", *out)


def aurc(curve: DataFrame, by: Sequence[str], y: str = "risk") -> DataFrame:
    """Trapezoid area under a coverage curve, and the same divided by its span."""
    w = Window.partitionBy(*by).orderBy("coverage")
    x0, y0 = F.lag("coverage").over(w), F.lag(y).over(w)
    area = curve.withColumn("__a", (F.col("coverage") - x0) * (F.col(y) + y0) / 2.0)
    return area.groupBy(*by).agg(
        F.sum("__a").alias("aurc"),
        (F.sum("__a") / F.nullif(F.max("coverage") - F.min("coverage"), F.lit(0.0))).alias("aurc_normalised"))


def thresholds(df: DataFrame, by: Sequence[str], score: str, key: str, coverages: Sequence[float]) -> DataFrame:
    """Score of the k-th smallest row, k = clip(rint(c N), 1, N), with the realised coverage.

    Distinct scores are counted first, so ties collapse and the k-th row is found on running
    counts; the accepted count is the running count at that score.
    """
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n_at"))
    p = ordered_prefix(counts, by, [score], {"n": F.col("n_at")})
    wants = []
    for c in coverages:
        k = accepted_rows(F.lit(float(c)), F.col("all_n"))
        hit = (k > F.col("cum_n") - F.col("n_at")) & (k <= F.col("cum_n"))
        wants.append(F.when(hit, F.lit(float(c))))
    hits = p.withColumn("planned_coverage", F.explode(F.filter(F.array(*wants), lambda x: x.isNotNull())))
    return hits.select(*by, "planned_coverage", F.col(score).alias("threshold"), F.col("cum_n").alias("n_accepted"),
                       (F.col("all_n") - F.col("cum_n")).alias("n_referred"),
                       (F.col("cum_n") / F.col("all_n")).alias("realised_coverage"))


def referral_summary(df: DataFrame, thr: DataFrame, by: Sequence[str], score: str, risk: str, group: str) -> DataFrame:
    """Accepted, referred and whole risks at frozen thresholds; a NULL score is referred."""
    ok = F.coalesce(F.col(score) <= F.col("threshold"), F.lit(False))
    rows = join_small(df.select(*by, group, score, risk), thr.select(*by, "planned_coverage", "threshold"), by)
    per = rows.withColumn("ok", ok).groupBy(*by, "planned_coverage", "threshold", group).agg(
        F.count(F.lit(1)).alias("n"), F.sum(risk).alias("s"), F.count_if("ok").alias("na"),
        F.sum(F.when(F.col("ok"), F.col(risk))).alias("sa"))
    nz = lambda c: F.nullif(c, F.lit(0))
    n, na, s, sa = F.sum("n"), F.sum("na"), F.sum("s"), F.coalesce(F.sum("sa"), F.lit(0.0))
    return per.groupBy(*by, "planned_coverage", "threshold").agg(
        n.alias("n_rows"), na.alias("n_accepted"), (n - na).alias("n_referred"),
        (na / n).alias("actual_coverage"), (sa / nz(na)).alias("accepted_risk"),
        ((s - sa) / nz(n - na)).alias("referred_risk"), (s / n).alias("whole_risk"),
        F.avg(F.col("sa") / nz(F.col("na"))).alias("accepted_group_risk"),
        F.avg(F.col("s") / F.col("n")).alias("whole_group_risk"),
        F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("na") > 0).alias("n_groups_accepted"),
        F.when(na > 0, "PASS").otherwise("NOT_ESTIMABLE").alias("status"))


def interpolate_curve(points: DataFrame, curve: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Value of the grid curve at x by linear interpolation between the two grid neighbours."""
    w = Window.partitionBy(*by).orderBy("bucket")
    seg = curve.select(*by, "bucket", F.col("coverage").alias("x0"), F.col(y).alias("y0"),
                       F.lead("coverage").over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    cell = F.greatest(F.lit(0), F.least(F.floor((F.col(x) - 0.5) * 100 + 1e-9), F.lit(GRID - 1))).cast("bigint")
    j = points.withColumn("bucket", cell).join(seg, [*by, "bucket"])
    t = F.when(F.col("x1").isNull(), 0.0).otherwise(
        F.greatest(F.lit(0.0), (F.col(x) - F.col("x0")) / (F.col("x1") - F.col("x0"))))
    return j.withColumn(f"{y}_at", F.col("y0") + t * (F.coalesce("y1", F.col("y0")) - F.col("y0"))).drop(
        "bucket", "x0", "x1", "y0", "y1")


# --- one-vs-rest ranking ---------------------------------------------------------------
def one_vs_rest(df: DataFrame, by: Sequence[str], k: int = 6) -> DataFrame:
    """Counts per distinct score of each class on unique-majority rows: (by, class, score, n, pos)."""
    ex = df.where(F.col("y") >= 0).select(
        *by, "y", F.posexplode(F.array(*fn.cols("c", k))).alias("class", "score"))
    return ex.withColumn("class", F.col("class").cast("bigint")).groupBy(*by, "class", "score").agg(
        F.count(F.lit(1)).alias("n_at"), F.count_if(F.col("y") == F.col("class")).alias("pos_at"))


def auroc_ap(p: DataFrame, by: Sequence[str]) -> DataFrame:
    """AUROC from average ranks and tie-grouped average precision, both from :func:`~.scorecells.running_counts`."""
    n, pos = F.col("all_n"), F.col("all_pos")
    rank_asc = n - F.col("cum_n") + (F.col("n_at") + 1) / 2.0
    ap = F.col("pos_at") / F.nullif(pos, F.lit(0)) * (F.col("cum_pos") / F.col("cum_n"))
    agg = p.groupBy(*by, "class").agg(
        F.max(n).alias("n"), F.max(pos).alias("n_pos"), F.sum(rank_asc * F.col("pos_at")).alias("r"),
        F.sum(ap).alias("ap"))
    neg = F.col("n") - F.col("n_pos")
    ok = (F.col("n_pos") > 0) & (neg > 0)
    n_pos = F.col("n_pos").cast("double")  # products of two counts leave the range of a bigint
    auc = (F.col("r") - n_pos * (n_pos + 1) / 2.0) / F.nullif(n_pos * neg, F.lit(0.0))
    return agg.select(*by, "class", F.col("n_pos").alias("n_pos"), neg.alias("n_neg"),
                      F.when(ok, auc).alias("auroc"), F.when(ok, F.col("ap")).alias("average_precision"))


def auroc_many(counts: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """AUROC per class under each of ``k`` weightings, from one order: (by, class, values), an array.

    ``counts`` holds n_0.., pos_0.. per distinct score. A weighting's value is null where a class or its rest
    has no weight; its entry has ``n`` 0 where it has no rows at all.
    """
    p = ordered_prefix(counts, [*by, "class"], [F.desc("score")], {f"{m}_{i}": F.col(f"{m}_{i}") for i in range(k) for m in ("n", "pos")})
    aggs = []
    for i in range(k):
        rank = F.col(f"all_n_{i}") - F.col(f"cum_n_{i}") + (F.col(f"n_{i}") + 1) / 2.0
        aggs += [F.max(f"all_n_{i}").alias(f"a{i}"), F.max(f"all_pos_{i}").alias(f"p{i}"), F.sum(rank * F.col(f"pos_{i}")).alias(f"r{i}")]
    agg, values = p.groupBy(*by, "class").agg(*aggs), []
    for i in range(k):
        pos, neg = F.col(f"p{i}").cast("double"), F.col(f"a{i}") - F.col(f"p{i}")
        auc = F.when((pos > 0) & (neg > 0), (F.col(f"r{i}") - pos * (pos + 1) / 2.0) / F.nullif(pos * neg, F.lit(0.0)))
        values.append(F.struct(F.col(f"a{i}").alias("n"), auc.alias("value")))
    return agg.select(*by, "class", F.array(*values).alias("values"))


def roc_points(p: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points of :func:`~.scorecells.running_counts`."""
    neg = F.col("all_n") - F.col("all_pos")
    return p.select(*by, "class", "score",
                    ((F.col("cum_n") - F.col("cum_pos")) / F.nullif(neg, F.lit(0))).alias("fpr"),
                    (F.col("cum_pos") / F.nullif(F.col("all_pos"), F.lit(0))).alias("tpr"))


def pr_points(p: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points of :func:`~.scorecells.running_counts`."""
    return p.select(*by, "class", "score", (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
                    (F.col("cum_pos") / F.nullif(F.col("all_pos"), F.lit(0))).alias("recall"))


def ecdf(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Share of rows at or below each distinct value."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_at"))
    p = ordered_prefix(counts, by, [value], {"n": F.col("n_at")})
    return p.select(*by, value, "n_at", (F.col("cum_n") / F.col("all_n")).alias("share"))

