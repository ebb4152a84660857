"""Partition summaries, leakage audit, connected components and the stratified split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..constants import PARTITION_SHARES, PARTITIONS, SPLIT_SEED
from ..session import cut_lineage
from .ranking import ordered_prefix


def partition_summary(df: DataFrame, ids: Sequence[str], k: int = 6) -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    out = df.groupBy("partition").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in ids],
        *[(F.sum(f"v{i}") / F.sum("n")).alias(f"share{i}") for i in range(k)])
    return out.withColumn("row_share", F.col("n_rows") / total)


def leakage_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct members of each key shared by every pair of partitions.

    A member is reduced to the set of partitions it occurs in, so a pair fans out of at most
    (number of partitions) squared entries and no member is joined to itself.
    """
    long = df.unpivot(["partition"], list(keys), "key", "member")
    sets = long.groupBy("key", "member").agg(F.collect_set("partition").alias("parts"))
    kinds = sets.groupBy("key", F.array_sort("parts").alias("parts")).agg(F.count(F.lit(1)).alias("c"))
    pairs = kinds.select("key", "c", "parts", F.explode("parts").alias("part_a")).select(
        "key", "c", "part_a", F.explode("parts").alias("part_b"))
    return pairs.groupBy("key", "part_a", "part_b").agg(F.sum("c").alias("shared"))


def cohort_flow(df: DataFrame, group: str) -> DataFrame:
    """Row and group counts by stage, with a check that they add up."""
    lost = (F.col("local_valid") == 0) & (F.col("context_valid") == 0)
    stage = F.when(lost, "2 quarantined").otherwise(F.concat(F.lit("3 eligible "), F.col("partition")))
    t = df.withColumn("stage", F.explode(F.array(F.lit("1 source"), stage)))
    out = t.groupBy("stage").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"))
    n0 = df.agg(F.count(F.lit(1))).scalar()
    rest = df.agg(F.count_if(lost) + F.count_if(~lost)).scalar()
    return out.withColumn("reconciles", n0 == rest)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): smallest node id of each connected component, over bigint node ids.

    Nodes with one neighbour cannot join two parts, so they are set aside first (:func:`_leaves`) and take
    the root of their neighbour at the end; the rounds see only what is left. These are
    alternating large-star and small-star steps; each is one aggregation for the smallest
    neighbour and one join back, so a hub node is combined map-side and split by the adaptive
    skew join, never gathered. Lineage is cut every round; rounds grow with log(diameter).
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null or b is not null")
    e = cut_lineage(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    alone = e.where("u = v").select(F.col("u").alias("node"))
    e = e.where("u <> v")
    leaves = cut_lineage(_leaves(e))
    core = cut_lineage(e.join(leaves.select(F.col("leaf").alias("u")), "u", "left_anti").join(leaves.select(F.col("leaf").alias("v")), "v", "left_anti").select("u", "v"))
    stars = _stars(core, max_rounds)  # every node of the core but the roots
    hubs = leaves.groupBy(F.col("hub").alias("node")).agg(F.min("leaf").alias("least"))
    inner = core.select(F.explode(F.array("u", "v")).alias("node")).unionByName(hubs.select("node")).unionByName(alone).distinct()
    inner = inner.join(hubs, "node", "left").join(stars.select(F.col("u").alias("node"), F.col("v").alias("star")), "node", "left")
    inner = cut_lineage(inner.select("node", F.coalesce("star", "node").alias("star"), F.least("node", "least").alias("least")))
    inner = inner.select("node", "star").join(inner.groupBy("star").agg(F.min("least").alias("root")), "star").select("node", "root")
    outer = leaves.join(inner.select(F.col("node").alias("hub"), "root"), "hub").select(F.col("leaf").alias("node"), "root")
    # a leaf may also stand alone in a row of its own
    return inner.join(leaves.select(F.col("leaf").alias("node")), "node", "left_anti").unionByName(outer)


def _leaves(e: DataFrame) -> DataFrame:
    """(leaf, hub): nodes with a single neighbour; of two that have only each other, the larger is the leaf."""
    both = e.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(e.select(F.col("v").alias("node"), F.col("u").alias("near")))
    ends = both.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("near").alias("near")).where("n = 1").select("node", "near")
    pair = ends.where("node < near").select("node", F.col("near").alias("back"))
    back = ends.where("node > near").select(F.col("near").alias("node"), F.col("node").alias("back"))
    hubs = pair.join(back, ["node", "back"], "left_semi").select("node")
    return ends.join(hubs, "node", "left_anti").select(F.col("node").alias("leaf"), F.col("near").alias("hub"))


def _stars(e: DataFrame, max_rounds: int) -> DataFrame:
    """Edges (node, root) of the stars that the edges settle into."""
    mark = _signature(e)
    for _ in range(max_rounds if mark[0] else 0):
        e = cut_lineage(_small_star(_large_star(e)))
        now = _signature(e)
        if now == mark:
            break
        mark = now
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e


def _signature(e: DataFrame) -> tuple:
    # decimals, because a bigint sum overflows with some 10^7 edges
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(28,0)"))).first()
    return r[0], r[1]


def _large_star(e: DataFrame) -> DataFrame:
    """Link every larger neighbour of u to the smallest node around u."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Link u and its smaller neighbours to the smallest of them."""
    d = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = d.groupBy("u").agg(F.min("v").alias("m"))
    moved = d.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def component_ids(cc: DataFrame) -> DataFrame:
    """(node, component): 0-based dense id by the order of the roots."""
    roots = ordered_prefix(cc.select("root").distinct(), [], ["root"])
    return cc.join(roots.select("root", (F.col("rank") - 1).alias("component")), "root").select("node", "component")


def component_stats(rows: DataFrame, component: str, group: str, k: int = 6) -> DataFrame:
    """Rows, groups and per-class vote-mass rows of each component."""
    votes = [F.sum(f"v{i}").alias(f"s{i}") for i in range(k)]
    s = rows.groupBy(component).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(group).alias("n_groups"), *votes)
    mass = fn.total(fn.cols("s", k))
    return s.select(component, "n_rows", "n_groups", *[
        (F.col(f"s{i}") / mass * F.col("n_rows")).alias(f"mass{i}") for i in range(k)])


def stratified_allocation(stats: DataFrame, component: str, seed: int = SPLIT_SEED, k: int = 6) -> DataFrame:
    """Partition per component, components never split.

    Within the stratum of the dominant class, components stand in the order of a seeded hash; the
    midpoint of a component on the running row share picks its partition, so the row shares meet
    their targets to within one component per stratum.
    """
    s = stats.withColumns({
        "stratum": fn.first_argmax([F.round(F.col(f"mass{i}"), 9) for i in range(k)]),
        "draw": fn.md5_int(str(seed), F.col(component).cast("string"))})
    p = ordered_prefix(s, ["stratum"], [F.col("draw"), F.col(component)], {"rows": F.col("n_rows")})
    mid = (F.col("cum_rows") - F.col("n_rows") / 2.0) / F.col("all_rows")
    return p.withColumn("partition", pick_partition(mid)).select(component, "n_rows", "stratum", "partition")


def pick_partition(share: Column) -> Column:
    edge, chain = 0.0, None
    for name, part in list(zip(PARTITIONS, PARTITION_SHARES))[:-1]:
        edge = round(edge + part, 10)
        chain = F.when(share < edge, name) if chain is None else chain.when(share < edge, name)
    return chain.otherwise(PARTITIONS[-1])


def assignment_digest(df: DataFrame, key: str, value: str, seed: int) -> DataFrame:
    """Hash of a (key -> value) table that does not depend on row order.

    Every row gives two 32-bit hashes; their exact decimal sums are hashed with the count, so nothing is
    collected or sorted.
    """
    a = fn.md5_int(str(seed), F.col(key).cast("string"), F.col(value))
    b = fn.md5_int("b", str(seed), F.col(key).cast("string"), F.col(value))
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum(a.cast("decimal(38,0)")).alias("a"), F.sum(b.cast("decimal(38,0)")).alias("b"))
    return s.select("n", F.substring(F.sha2(F.concat_ws("|", "n", "a", "b"), 256), 1, 16).alias("digest"))


def hash_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n distinct keys with the smallest seeded hash: the same at any partitioning."""
    keys = df.select(key).distinct()
    return keys.withColumn("__h", fn.md5_int(str(seed), F.col(key).cast("string"))).orderBy("__h", key).limit(n).select(key)


def subsample_groups(df: DataFrame, group: str, fraction: float, seed: int) -> DataFrame:
    """A seeded fraction of the groups with all of their rows."""
    g = df.select(group).distinct().withColumn("__h", fn.md5_int(str(seed), F.col(group).cast("string")))
    r = ordered_prefix(g, [], ["__h", group])
    keep = r.where(F.col("rank") <= F.greatest(F.lit(1), F.rint(fraction * F.col("n_total")))).select(group)
    return df.join(keep, group, "left_semi")


def even_subset(df: DataFrame, group: str, key: str, n_rows: int, min_groups: int, seed: int) -> DataFrame:
    """At most n rows spread evenly over the groups, blind to labels.

    The per-group limit is a literal, so Spark prunes with a partial group limit before the
    shuffle and a hot group sends only a few rows per task.
    """
    from pyspark.sql import Window

    groups = df.select(group).distinct().count()
    if groups < min_groups:
        raise ValueError(f"{groups} groups, fewer than the required {min_groups}")
    per = max(1, n_rows // groups)
    h = df.withColumn("__h", fn.md5_int(str(seed), F.col(key).cast("string")))
    w = Window.partitionBy(group).orderBy("__h", key)
    kept = h.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per)
    return kept.orderBy("__h", key).limit(n_rows).drop("__h", "__r")


def balanced_cases(df: DataFrame, by: Sequence[str], key: str, per_cell: int, seed: int) -> DataFrame:
    """Up to per_cell rows of every cell by seeded hash."""
    from pyspark.sql import Window

    h = df.withColumn("__h", fn.md5_int(str(seed), F.col(key).cast("string")))
    w = Window.partitionBy(*by).orderBy("__h", key)
    return h.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= per_cell).drop("__h", "__r")
