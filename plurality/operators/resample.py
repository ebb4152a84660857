"""Cluster bootstrap, Holm adjustment and minimum detectable effects."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as fn
from ..constants import LOW_SUPPORT_GROUPS
from ..session import cut_lineage, join_small
from .ranking import ordered_prefix

BOOT_SEED = 20260907
#: replicates of an interval unless the caller asks for another number
REPLICATES = 2000
#: groups whose draws are computed together
BLOCK_GROUPS = 1024
#: numbers that the sums a task holds may have
SUM_NUMBERS = 4_000_000


def holm_adjust(df: DataFrame, by: Sequence[str], p: str, key: str) -> DataFrame:
    """Step-down adjusted p-values per family: min(1, running max of (m - i + 1) p).

    The running maximum splits at range partitions like the ranks do: a local running maximum
    and the largest value of the partitions before.
    """
    ranked = ordered_prefix(df, by, [p, key])
    scaled = (F.col("n_total") - F.col("rank") + 1) * F.col(p)
    run = ranked.withColumn("__v", scaled).withColumn("__blk", F.floor((F.col("rank") - 1) / 100000))
    inner = Window.partitionBy(*by, "__blk").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    tops = run.groupBy(*by, "__blk").agg(F.max("__v").alias("__top"))
    outer = Window.partitionBy(*by).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*by, "__blk", F.max("__top").over(outer).alias("__before"))
    out = run.withColumn("__in", F.max("__v").over(inner)).join(tops, [*by, "__blk"])
    adjusted = F.least(F.lit(1.0), F.greatest(F.col("__in"), F.coalesce("__before", F.lit(0.0))))
    return out.withColumn("p_adjusted", adjusted).select(*df.columns, "p_adjusted")


def group_index(groups: DataFrame, by: Sequence[str], group: str) -> DataFrame:
    """0-based dense index of the distinct groups inside each key, with the group count."""
    g = groups.select(*by, group).distinct()
    ranked = ordered_prefix(g, by, [group])
    return ranked.select(*by, group, (F.col("rank") - 1).alias("g_index"), F.col("n_total").alias("n_groups"))


@lru_cache(4096)
def _generator_key(seed: int, lo: int, hi: int, last: int) -> tuple[int, int]:
    d = hashlib.blake2b(f"{seed}|{lo}|{hi}|{last}".encode(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def _random(seed: int, lo: int, hi: int, n_groups: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=np.array(_generator_key(seed, lo, hi, n_groups), np.uint64)))


class Draws:
    """How often each of ``n_groups`` groups is drawn in each replicate of ``n_groups`` draws with replacement.

    Multinomial counts by recursive binomial splitting: the draws of a run of groups divide into those
    of its halves by a binomial from a generator that the run itself seeds, down to blocks of
    ``BLOCK_GROUPS``. So any task computes the counts of the blocks it holds, whatever else lies where,
    and no draw is ever listed or shuffled. They depend on seed, number of groups and a group's
    place only: keys with the same groups are resampled jointly.
    """

    def __init__(self, n_groups: int, replicates: int, seed: int):
        self.n, self.replicates, self.seed, self.nodes, self.latest = n_groups, replicates, seed, {}, (-1, None)

    def sums(self, at: int, values: np.ndarray) -> np.ndarray:
        """[replicates, values] of a block's [groups, values], each group as often as it is drawn."""
        return self.block(at).astype(float) @ values

    def _run(self, lo: int, hi: int, at: int) -> np.ndarray:
        """Draws in each replicate that fall into the block ``at``, from the run of blocks [lo, hi) down."""
        count = np.full(self.replicates, self.n, np.int64)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            if (left := self.nodes.get((lo, hi))) is None:
                size = [min(x * BLOCK_GROUPS, self.n) for x in (lo, mid, hi)]
                left = _random(self.seed, lo, hi, self.n).binomial(count, (size[1] - size[0]) / (size[2] - size[0]))
                if len(self.nodes) > 64:  # the path of a task's blocks is short
                    self.nodes.clear()
                self.nodes[lo, hi] = left
            if at < mid:
                count, hi = left, mid
            else:
                count, lo = count - left, mid
        return count

    def block(self, at: int) -> np.ndarray:
        """[replicates, groups of the block]"""
        if self.latest[0] != at:
            size = min(BLOCK_GROUPS, self.n - at * BLOCK_GROUPS)
            count = self._run(0, -(-self.n // BLOCK_GROUPS), at)
            self.latest = at, _random(self.seed, at, -1, self.n).multinomial(count, np.full(size, 1.0 / size))
        return self.latest[1]


class ListedDraws(Draws):
    """The same distribution by other draws: those that fall into a block name its groups one by one.

    A draw costs an integer and a look at its group's value, a tenth of the binomial that :class:`Draws` has for
    every group and replicate. Worth it where keys differ in their groups and share no block.
    """

    def _listed(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """(draws in each replicate, the places they name, one replicate after the other)"""
        if self.latest[0] != at:
            count = self._run(0, -(-self.n // BLOCK_GROUPS), at)
            size = min(BLOCK_GROUPS, self.n - at * BLOCK_GROUPS)
            self.latest = at, (count, _random(self.seed, at, -2, self.n).integers(0, size, int(count.sum()), np.uint16))
        return self.latest[1]

    def block(self, at: int) -> np.ndarray:
        count, place = self._listed(at)
        size = min(BLOCK_GROUPS, self.n - at * BLOCK_GROUPS)
        return np.bincount(np.repeat(np.arange(self.replicates) * size, count) + place, minlength=self.replicates * size).reshape(-1, size)

    def sums(self, at: int, values: np.ndarray) -> np.ndarray:
        count, place = self._listed(at)
        out, ends = np.zeros((self.replicates, values.shape[1])), np.append(0, np.cumsum(count))
        columns = [np.ascontiguousarray(values[:, k]) for k in range(values.shape[1])]
        even = [bool((v == v[0]).all()) for v in columns]
        for r in range(0, self.replicates, 64):  # what is looked up stays in a core's cache
            end = ends[r : r + 65]
            n = np.diff(end)
            some = np.flatnonzero(n)
            if len(some):
                part, first = place[end[0] : end[-1]].astype(np.intp), (end[:-1] - end[0])[some]
                for k, v in enumerate(columns):
                    out[r + some, k] = n[some] * v[0] if even[k] else np.add.reduceat(v[part], first)
        return out


def _blocks_of(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple]:
    """Parts of a batch that share key, number of groups and block: (key, n_groups, block, rows, places in the block)."""
    keys = list(zip(*(batch.column(k).to_pylist() for k in range(n_keys)))) if n_keys else [()] * batch.num_rows
    index, total = (batch.column(n_keys + k).to_numpy() for k in (0, 1))
    rows: dict[tuple, list[int]] = {}
    for i, part in enumerate(zip(keys, total.tolist(), (index // BLOCK_GROUPS).tolist())):
        rows.setdefault(part, []).append(i)
    for (key, n, block), at in rows.items():
        yield key, n, block, at, index[at] - block * BLOCK_GROUPS


def replicate_sums(per_group: DataFrame, by: Sequence[str], group: str, values: Sequence[str], replicates: int = REPLICATES,
                   seed: int = BOOT_SEED, draws_of: type[Draws] = Draws) -> DataFrame:
    """(by, replicate, values): each value summed over the resampled groups of every replicate.

    ``per_group`` has rows (by, group, values), several for a group if need be, null values left out. They
    become one row per group, dealt to tasks by blocks of groups, so that keys with as many groups share a block's draws,
    which are computed once for all of them; each task turns its blocks into one partial sum per key and replicate. What is shuffled grows with groups and with tasks times
    replicates, never with groups times replicates.
    """
    per_group = per_group.groupBy(*by, group).agg(*[F.sum(F.col(v).cast("double")).alias(v) for v in values])
    rows = ordered_prefix(per_group, by, [group]).where(F.col(group).isNotNull())
    rows = rows.select(*by, (F.col("rank") - 1).alias("g_index"), F.col("n_total").alias("n_groups"), *values)
    block = F.floor(F.col("g_index") / BLOCK_GROUPS)
    rows = rows.repartition("n_groups", block).sortWithinPartitions("n_groups", block, *by, "g_index")
    kinds = dict(rows.dtypes)
    names = [*by, "replicate", *values]
    held = max(32, SUM_NUMBERS // (replicates * max(len(values), 1)))  # keys whose sums a task holds
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in by] + ["replicate bigint"] + [f"`{v}` double" for v in values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws: dict[int, Draws] = {}
        sums: dict[tuple, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            keys = [pa.array([k[i] for k in sums for _ in range(replicates)], arrow_types[c]) for i, c in enumerate(by)]
            flat = np.concatenate(list(sums.values()))
            return pa.RecordBatch.from_arrays([*keys, pa.array(np.tile(np.arange(replicates), len(sums))), *[pa.array(flat[:, k]) for k in range(len(values))]], names=names)

        arrow_types = None
        for batch in batches:
            arrow_types = {c: batch.schema.field(i).type for i, c in enumerate(by)}
            x = np.nan_to_num(np.stack([batch.column(len(by) + 2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(values))], 1))
            for key, n, block, at, place in _blocks_of(batch, len(by)):
                if len(draws) > 64:
                    draws.clear()
                if n not in draws:
                    draws[n] = draws_of(n, replicates, seed)
                dense = np.zeros((min(BLOCK_GROUPS, n - block * BLOCK_GROUPS), len(values)))
                np.add.at(dense, place, x[at])
                part = draws[n].sums(block, dense)
                sums[key] = sums[key] + part if key in sums else part
                if len(sums) >= held:
                    yield told()
                    sums = {}
        if sums:
            yield told()

    return rows.mapInArrow(run, schema).groupBy(*by, "replicate").agg(*[F.sum(v).alias(v) for v in values])


def with_draws(rows: DataFrame, by: Sequence[str], group: str, replicates: int = REPLICATES, seed: int = BOOT_SEED, name: str = "draws") -> DataFrame:
    """``rows`` with a binary column: how often the row's group is drawn, one unsigned 16-bit number per replicate."""
    rows = cut_lineage(rows)
    index = group_index(rows, by, group)
    rows = index.join(rows, [*by, group])
    rows = rows.select(*by, "g_index", "n_groups", *[c for c in rows.columns if c not in (*by, "g_index", "n_groups")])
    # a block's rows go to eight tasks, so that a group with many rows is not one task's
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(8))
    rows = rows.repartition("n_groups", F.floor(F.col("g_index") / BLOCK_GROUPS), salt).sortWithinPartitions("n_groups", "g_index")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws: dict[int, Draws] = {}
        for batch in batches:
            out: list = [None] * batch.num_rows
            for _, n, block, at, place in _blocks_of(batch, len(by)):
                if len(draws) > 64:
                    draws.clear()
                if n not in draws:
                    draws[n] = Draws(n, replicates, seed)
                m = draws[n].block(block).T.astype("<u2")
                for i, p in zip(at, place.tolist()):
                    out[i] = m[p].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rows.columns) + f", `{name}` binary").drop("g_index", "n_groups")


def multiplicities(index: DataFrame, by: Sequence[str], group: str, replicates: int, seed: int = BOOT_SEED,
                   method: str = "exact") -> DataFrame:
    """How often each group is drawn in each replicate: (by, group, replicate, m), zeros left out.

    Exact: draw j of replicate r is an md5 of (seed, r, j) modulo the group count, so it does not
    depend on partitioning. Draws are counted per (key, replicate, index) before they meet the
    groups. Only where the caller asks for ``method="poisson"`` each group gets an independent
    Poisson(1) count instead; the method never depends on the size.
    """
    sizes = index.groupBy(*by).agg(F.max("n_groups").alias("n_groups"))
    reps = F.sequence(F.lit(0), F.lit(replicates - 1))
    if method == "poisson":
        rows = index.select(*by, group, F.explode(reps).alias("replicate"))
        u = fn.md5_unit(str(seed), F.col("replicate"), F.col(group).cast("string"))
        m, cdf, term = F.lit(0), 0.0, math.exp(-1.0)
        for k in range(18):  # the next count has a chance below 1e-16, less than u resolves
            cdf += term
            m = m + (u >= cdf).cast("int")
            term /= k + 1
        return rows.withColumn("m", m.cast("bigint")).where("m > 0").withColumn("draw_method", F.lit("poisson"))
    spread = sizes.select(*by, "n_groups", F.explode(reps).alias("replicate"))
    # draws are exploded in blocks so that no single row carries all draws of a large replicate
    block = 4096
    blocks = spread.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_groups") - 1) / block))))
    blocks = blocks.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "replicate", "blk")
    last = F.least((F.col("blk") + 1) * block, F.col("n_groups")) - 1
    draws = blocks.select(*by, "n_groups", "replicate", F.explode(F.sequence(F.col("blk") * block, last)).alias("j"))
    hit = F.pmod(fn.md5_int(str(seed), F.col("replicate"), F.col("j")), F.col("n_groups"))
    counted = draws.groupBy(*by, "replicate", hit.alias("g_index")).agg(F.count(F.lit(1)).alias("m"))
    # exploded draws count as one row in Spark's estimates, so without the hint all of them would be broadcast
    return counted.hint("merge").join(index.select(*by, group, "g_index"), [*by, "g_index"]).select(
        *by, group, "replicate", "m").withColumn("draw_method", F.lit("exact"))


def percentile_ci(reps: DataFrame, by: Sequence[str], value: str = "value", level: float = 0.95) -> DataFrame:
    """Percentile limits, mean and SD over the replicates of each key (at most R values per key)."""
    a = (1 - level) / 2
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value))
    v = F.when(ok, F.col(value))
    return reps.groupBy(*by).agg(
        F.percentile(v, F.lit(a)).alias("ci_low"), F.percentile(v, F.lit(1 - a)).alias("ci_high"),
        F.avg(v).alias("boot_mean"), F.stddev_samp(v).alias("boot_sd"),
        F.count_if(~ok).alias("n_dropped"), F.count(F.lit(1)).alias("n_replicates"))


def group_mean_bootstrap(per_group: DataFrame, by: Sequence[str], group: str, value: str, replicates: int = REPLICATES,
                         seed: int = BOOT_SEED, draws_of: type[Draws] = Draws) -> DataFrame:
    """Mean over groups with a cluster-bootstrap interval. ``per_group`` has one row per (by, group)."""
    point = per_group.groupBy(*by).agg(F.avg(value).alias("point"), F.count(F.lit(1)).alias("n_groups"))
    ci = percentile_ci(replicate_means(per_group, by, group, value, replicates, seed, draws_of), by)
    return point.join(ci, list(by)) if by else _side_by_side(point, ci)


def replicate_means(per_group: DataFrame, by: Sequence[str], group: str, value: str, replicates: int = REPLICATES,
                    seed: int = BOOT_SEED, draws_of: type[Draws] = Draws) -> DataFrame:
    v = per_group.select(*by, group, F.col(value).alias("__v"), F.col(value).isNotNull().cast("double").alias("__one"))
    r = replicate_sums(v, by, group, ["__v", "__one"], replicates, seed, draws_of)
    return r.select(*by, "replicate", F.when(F.col("__one") > 0, F.col("__v") / F.col("__one")).alias("value"))


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row results on one row."""
    k = F.lit(1)
    return a.withColumn("__k", k).join(b.withColumn("__k", k), "__k").drop("__k")


def decide(df: DataFrame) -> DataFrame:
    return df.withColumn("decision", F.when(F.col("ci_high") < 0, "superiority_supported")
                         .when(F.col("ci_low") > 0, "inferior").otherwise("inconclusive"))


def paired_differences(df: DataFrame, by: Sequence[str], group: str, seed_col: str, value: str,
                       a: Column, b: Column) -> DataFrame:
    """Per (by, group): seed-averaged mean loss of a, of b, and their difference.

    Losses are averaged per seed first, then over seeds; both methods come out of one pass. The
    arms must pair: the plan raises where a group lacks an arm in one of its seeds, or has
    fewer seeds than others of its key. The check is part of the expressions, no pass of its own.
    """
    per = df.groupBy(*by, group, seed_col).agg(F.avg(F.when(a, F.col(value))).alias("la"), F.avg(F.when(b, F.col(value))).alias("lb"),
                                               F.count_if(a).alias("__na"), F.count_if(b).alias("__nb"))
    lacking = F.concat(F.lit("unpaired group "), F.coalesce(F.col(group).cast("string"), F.lit("null")), F.lit(", seed "), F.coalesce(F.col(seed_col).cast("string"), F.lit("null")))
    whole = (F.col("__na") > 0) & (F.col("__nb") > 0)
    per = per.withColumn("la", F.when(whole, F.col("la")).otherwise(F.raise_error(lacking).cast("double")))
    out = per.groupBy(*by, group).agg(F.avg("la").alias("la"), F.avg("lb").alias("lb"), F.count(F.lit(1)).alias("n_seeds"))
    most = out.groupBy(*by).agg(F.max("n_seeds").alias("__most"))
    out = join_small(out, most, by) if by else out.withColumn("__most", most.select("__most").scalar())
    short = F.concat(F.lit("group with fewer seeds than others: "), F.coalesce(F.col(group).cast("string"), F.lit("null")))
    seeds = F.when(F.col("n_seeds") == F.col("__most"), F.col("n_seeds")).otherwise(F.raise_error(short).cast("bigint"))
    return out.withColumn("delta", F.when(seeds.isNotNull(), F.col("la") - F.col("lb"))).drop("__most")


def paired_bootstrap(per_group: DataFrame, by: Sequence[str], group: str, replicates: int = REPLICATES,
                     seed: int = BOOT_SEED, draws_of: type[Draws] = Draws) -> DataFrame:
    """Percentile interval of the mean paired difference over resampled groups."""
    boot = group_mean_bootstrap(per_group, by, group, "delta", replicates, seed, draws_of)
    means = per_group.groupBy(*by).agg(F.avg("la").alias("mean_a"), F.avg("lb").alias("mean_b"))
    out = boot.join(means, list(by)) if by else _side_by_side(boot, means)
    out = out.withColumn("relative_effect", F.when(F.col("mean_b") != 0, F.col("point") / F.col("mean_b")))
    return decide(out).withColumns({
        "wholly_below_zero": F.col("ci_high") < 0,
        "crosses_zero": (F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)})


def bootstrap_statistic(rows: DataFrame, by: Sequence[str], group: str, sums: Sequence[str],
                        statistic: Callable[[], Column], replicates: int = REPLICATES, seed: int = BOOT_SEED,
                        within: Sequence[str] = ()) -> DataFrame:
    """Any statistic of column sums, on resampled whole groups, with its interval.

    ``rows`` holds (by, within, group, sums); ``statistic()`` is a caller's expression over the summed
    columns. Groups are drawn per ``by``, the statistic is told per ``by`` and ``within``. It is evaluated on
    plain sums and on those of every replicate.
    """
    keys = [*by, *within]
    rows = cut_lineage(rows)  # read for the plain sums, for the inner keys and for the replicates
    point = rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).select(*keys, statistic().alias("point"))
    if within:
        # one column per sum and inner key: the groups of a key are drawn once for all of them
        kinds = [r[0] for r in rows.select(F.struct(*within)).distinct().collect()]
        types = dict(rows.dtypes)
        literal = lambda k: [F.lit(v).cast(types[w]) for v, w in zip(k, within)]
        same = lambda k: reduce(lambda x, y: x & y, [F.col(w).eqNullSafe(v) for v, w in zip(literal(k), within)])
        wide = rows.select(*by, group, *[F.when(same(k), F.col(c)).otherwise(0.0).alias(f"{c}__{i}") for i, k in enumerate(kinds) for c in sums])
        r = replicate_sums(wide, by, group, [f"{c}__{i}" for i in range(len(kinds)) for c in sums], replicates, seed)
        parts = [F.struct(*[v.alias(w) for v, w in zip(literal(k), within)], *[F.col(f"{c}__{i}").alias(c) for c in sums]) for i, k in enumerate(kinds)]
        r = r.select(*by, "replicate", F.explode(F.array(*parts)).alias("__z")).select(*by, "replicate", "__z.*")
    else:
        r = replicate_sums(rows, by, group, sums, replicates, seed)
    ci = percentile_ci(r.select(*keys, statistic().alias("value")), keys)
    return point.join(ci, keys, "left") if keys else _side_by_side(point, ci)


def bootstrap_rows(rows: DataFrame, by: Sequence[str], group: str,
                        statistic: Callable[[DataFrame, list[str], list[str]], DataFrame], replicates: int,
                        seed: int = BOOT_SEED) -> DataFrame:
    """Any weighted statistic of rows, such as a rank statistic, on resampled whole groups.

    ``statistic(rows, keys, weights)`` returns per key an array ``values`` of (n, value), one for each of the weight
    columns: the multiplicities of the replicates, then 1 for the plain rows. So a row is ordered once, whatever
    the number of replicates. A replicate without rows (n 0) is left out. Pass pre-aggregated rows.
    """
    rows = cut_lineage(rows)  # read for the groups and for the statistic
    m = multiplicities(group_index(rows, by, group), by, group, replicates, seed)
    weights = [f"__w{i}" for i in range(replicates)]
    m = m.groupBy(*by, group).agg(*[F.sum(F.when(F.col("replicate") == i, F.col("m")).otherwise(0)).alias(w) for i, w in enumerate(weights)])
    j = rows.join(m, [*by, group], "left").withColumns({w: F.coalesce(w, F.lit(0).cast("bigint")) for w in weights} | {"__one": F.lit(1).cast("bigint")})
    out = cut_lineage(statistic(j, list(by), [*weights, "__one"]))
    keys = [c for c in out.columns if c != "values"]
    point = out.select(*keys, F.get("values", F.lit(replicates))["value"].alias("point"))
    reps = out.select(*keys, F.explode(F.slice("values", 1, replicates)).alias("z")).where("z.n > 0").select(*keys, F.col("z.value").alias("value"))
    ci = percentile_ci(reps, keys)
    return point.join(ci, keys, "left") if keys else _side_by_side(point, ci)


def minimum_detectable_effect(sd: Column, n: Column, alpha: float = 0.05, power: float = 0.80) -> Column:
    z = fn.inverse_normal(F.lit(1.0 - alpha / 2.0)) + fn.inverse_normal(F.lit(power))
    return z * sd / F.sqrt(n)


def low_support(n_groups: Column) -> Column:
    return n_groups < LOW_SUPPORT_GROUPS
