"""Evidence audits with the linear model: deletions, condition suites and ranked occlusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..session import cut_lineage
from .models import SoftRegression
from .resample import REPLICATES, group_mean_bootstrap


def compare_conditions(scored: DataFrame, keys: Sequence[str], clean: str) -> DataFrame:
    """Change of every condition against the clean one: KL, Jensen-Shannon distance, label flips.

    ``scored`` holds scoring-form probabilities p0..p5 and shares q0..q5 per (keys, condition).
    """
    base = scored.where(F.col("condition") == clean).select(*keys, *[F.col(f"p{k}").alias(f"b{k}") for k in range(6)])
    j = scored.join(base, list(keys))
    q, p, b = fn.cols("q"), fn.cols("p"), fn.cols("b")
    return j.withColumns({"kl": fn.kl(q, p), "dkl": fn.kl(q, p) - fn.kl(q, b), "js": fn.js_distance(p, b),
                          "flip": (fn.first_argmax(p) != fn.first_argmax(b)).cast("int")})


def condition_table(compared: DataFrame, group: str, replicates: int = REPLICATES) -> DataFrame:
    """Means per condition, and an interval of the paired change over resampled groups; all conditions share the draws."""
    per = cut_lineage(compared.groupBy("condition", group).agg(
        F.avg("kl").alias("kl"), F.avg("dkl").alias("dkl"), F.sum("js").alias("js"), F.sum("flip").alias("flip"),
        F.count(F.lit(1)).alias("c")))
    n = F.sum("c")
    means = per.groupBy("condition").agg(
        F.avg("kl").alias("group_kl"), F.avg("dkl").alias("group_dkl"), (F.sum("js") / n).alias("js_mean"),
        (F.sum("flip") / n).alias("flip_share"), n.alias("n_rows"))
    ci = group_mean_bootstrap(per, ["condition"], group, "dkl", replicates)
    return means.join(ci.select("condition", "ci_low", "ci_high", "n_groups", "n_replicates"), "condition")


def block_importance(cells: DataFrame, scored: DataFrame, model: SoftRegression, bands: DataFrame, view: str,
                     inner: tuple[int, int], seed: int) -> DataFrame:
    """(recording_id, row, region, tbin, ranked, random): deletion order of each (region, time bin) block.

    For a linear scorer gradient times input is closed-form: the loss gradient in a feature is the
    residual-weighted weight, and a cell enters its band mean and contrast with one over the count
    of valid cells. ``bands`` are the cells with a ``band`` column. Blocks of one window are few.
    """
    at = {f: i for i, f in enumerate(model.features)}
    slope = []
    for f, i in at.items():
        if not f.startswith(f"{view}_") or f.endswith("_valid"):
            continue
        g = fn.total([(F.col(f"p{k}") - F.col(f"q{k}")) * (model.weight[k][i] / model.sd[i]) for k in range(6)])
        _, region, band, kind = f.split("_")
        slope.append(F.struct(F.lit(region).alias("region"), F.lit(band).alias("band"), F.lit(kind).alias("kind"), g.alias("g")))
    gr = scored.select("recording_id", "row", F.explode(F.array(*slope)).alias("z")).groupBy(
        "recording_id", "row", F.col("z.region").alias("region"), F.col("z.band").alias("band")).agg(
        F.max(F.when(F.col("z.kind") == "mean", F.col("z.g"))).alias("gm"),
        F.max(F.when(F.col("z.kind") == "contrast", F.col("z.g"))).alias("gc"))
    mid = F.col("tbin").between(inner[0], inner[1] - 1)
    w = Window.partitionBy("row", "region", "band")
    ok = F.col("valid")
    c = bands.where(F.col("view") == view).withColumns({
        "n_all": F.count_if(ok).over(w), "n_in": F.count_if(ok & mid).over(w), "n_out": F.count_if(ok & ~mid).over(w)})
    j = c.join(gr, ["recording_id", "row", "region", "band"])
    one = lambda n: 1.0 / F.greatest(F.col(n), F.lit(1))
    d = F.col("gm") * one("n_all") + F.col("gc") * F.when(mid, one("n_in")).otherwise(-one("n_out"))
    blocks = j.groupBy("recording_id", "row", "region", "tbin").agg(
        F.sum(F.abs(F.when(ok, F.col("value") * d).otherwise(0.0))).alias("importance"))
    draw = fn.md5_int(str(seed), F.col("row").cast("string"), F.col("region"), F.col("tbin").cast("string"))
    by = Window.partitionBy("row")
    return blocks.withColumns({
        "ranked": F.row_number().over(by.orderBy(F.desc("importance"), "region", "tbin")),
        "random": F.row_number().over(by.orderBy(draw, "region", "tbin"))})


def occluded_cells(cells: DataFrame, blocks: DataFrame, view: str, fractions: Sequence[float], n_blocks: int) -> DataFrame:
    """Cells of every (order, fraction) condition: the first rint(f n) blocks are 0 and invalid."""
    b = blocks.select("row", "region", "tbin", "ranked", "random").withColumn("view", F.lit(view))
    j = cells.join(b, ["row", "view", "region", "tbin"], "left")
    out = []
    for order in ("ranked", "random"):
        for f in fractions:
            gone = F.coalesce(F.col(order) <= round(f * n_blocks), F.lit(False))
            out.append(F.struct(F.lit(f"{order}:{f}").alias("condition"), F.when(gone, 0.0).otherwise(F.col("value")).alias("value"),
                                (F.col("valid") & ~gone).alias("valid")))
    keep = [c for c in cells.columns if c not in ("value", "valid")]
    return j.select(*keep, F.explode(F.array(*out)).alias("z")).select(*keep, "z.condition", "z.value", "z.valid")
