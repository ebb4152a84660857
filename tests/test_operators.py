"""Operators against brute force on small fixtures."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plurality import functions as fn
from plurality.constants import BANDS
from plurality.operators import calibrate as cb
from plurality.operators import cells as cl
from plurality.operators import curves as cv
from plurality.operators import gates as gt
from plurality.operators import intervals as iv
from plurality.operators import ranking as rk
from plurality.operators import resample as rs
from plurality.operators import signal as sg
from plurality.operators import splits as sp
from plurality.plans.registry import tidy


@pytest.fixture(scope="module")
def ties():
    rng = random.Random(5)
    return pd.DataFrame([(rng.choice("ab"), rng.randint(0, 9) / 10, i, rng.random(), rng.randint(0, 30)) for i in range(600)],
                        columns=["m", "score", "id", "risk", "g"])


def test_global_order_splits_ties(spark, ties):
    df = spark.createDataFrame(ties)
    got = rk.ordered_prefix(df, ["m"], ["score", "id"], {"risk": F.col("risk")}, partitions=7).toPandas()
    want = ties.sort_values(["m", "score", "id"])
    want["rank"] = want.groupby("m").cumcount() + 1
    want["cum"] = want.groupby("m").risk.cumsum()
    j = got.merge(want[["id", "rank", "cum"]], on="id", suffixes=("", "_w"))
    assert len(j) == 600 and (j["rank"] == j["rank_w"]).all() and np.allclose(j.cum_risk, j.cum)


def test_equal_count_bins_match_array_split(spark):
    for n in (3, 8, 10, 23, 100):
        df = spark.range(n).select((F.col("id") + 1).alias("rank"))
        got = [r[0] for r in df.orderBy("rank").select(rk.equal_count_bin(F.col("rank"), F.lit(n), 8)).collect()]
        want = [i for i, c in enumerate(np.array_split(np.arange(n), 8)) for _ in c]
        assert got == want


def test_exact_quantiles(spark, ties):
    got = {(r["m"], r["prob"]): r["quantile"] for r in rk.exact_quantiles(spark.createDataFrame(ties), ["m"], "score", (0.05, 0.5, 0.9)).collect()}
    for (m, p), q in got.items():
        assert q == pytest.approx(np.quantile(ties[ties.m == m].score, p))
    assert len(got) == 6


def test_histogram_quantiles_are_exact(spark, ties):
    rng = np.random.default_rng(8)
    values = {"a": rng.normal(size=999), "b": np.repeat([1.0, 2.0, 2.0000000000000004], 7), "c": np.array([-1.7e308, 5e-324, 0.0, 1.7e308]), "d": np.array([3.0]),
              "e": np.concatenate([np.full(500, 1e-9), 10.0 ** rng.uniform(-300, 300, 501)])}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("a", float("nan"))], "k string, x double").repartition(5)
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r.k, r.prob): (r.quantile, r.n) for r in rk.histogram_quantiles(df, ["k"], "x", probs).collect()}
    assert len(got) == 25
    for (k, p), (q, n) in got.items():
        v = np.sort(values[k])
        h = (len(v) - 1) * p
        lo, hi = v[int(np.floor(h))], v[int(np.ceil(h))]
        assert n == len(v) and q == lo + (hi - lo) * (h - np.floor(h)) or np.isclose(q, np.quantile(v, p)), (k, p, q)
    one = rk.histogram_quantiles(spark.createDataFrame(ties), [], "score", (0.5,)).collect()
    assert len(one) == 1 and one[0].quantile == pytest.approx(ties.score.median())
    assert rk.histogram_quantiles(df.where("false"), ["k"], "x", (0.5,)).count() == 0


def test_normaliser_sees_training_cells_only_and_samples_within_both_bounds(spark):
    rng = np.random.default_rng(9)
    rows = [(r, "v", "A" if i % 4 else "B", i, 0, float(rng.normal() + (100 if r >= 60 else 0)), bool(rng.random() < 0.8)) for r in range(80) for i in range(40)]
    c = spark.createDataFrame(rows, "row bigint, view string, region string, fbin bigint, tbin bigint, value double, valid boolean")
    train = spark.range(60).withColumnRenamed("id", "row")
    got = {r.region: r for r in cl.fit_normaliser(c.join(train, "row", "left_semi")).collect()}
    for region in "AB":
        v = np.array([x[5] for x in rows if x[0] < 60 and x[2] == region and x[6]])
        med = np.median(v)
        assert got[region].median == pytest.approx(med) and got[region].scale == pytest.approx(1.4826 * np.median(np.abs(v - med))) and got[region].n_cells == len(v)
    s = cl.fit_sample(c, train, n_rows=30, max_cells=250).toPandas()
    n = s.groupby("region").size()
    assert s.row.nunique() == 30 and s.row.max() < 60 and s.valid.all() and n["A"] == 250 and 150 < n["B"] < 250
    assert len(s.drop_duplicates(["row", "fbin"])) == len(s)
    again = cl.fit_sample(c.repartition(7), train, n_rows=30, max_cells=250).toPandas()
    assert set(zip(s.row, s.fbin)) == set(zip(again.row, again.fbin))


def test_view_features_at_the_published_geometry(spark):
    """74 columns against NumPy: four regions, 64 frequency bins, five bands of one view and four of the other."""
    rng = np.random.default_rng(4)
    regions = ("LL", "RL", "LP", "RP")
    bins = lambda lo, hi: tuple(np.linspace(lo, hi, 65).tolist())
    views = {"local": cl.ViewAxes(regions, bins(0.5, 40.0), 6, (2, 4)), "context": cl.ViewAxes(regions, bins(0.59, 19.92), 8, (3, 5), whole=True)}
    names = cl.feature_names(views, BANDS)
    assert len(names) == len(set(names)) == 74
    raw, rows = {}, []
    for row in range(3):
        for v, ax in views.items():
            for g in regions:
                x, ok = rng.normal(2.0, 3.0, (64, ax.t_bins)), rng.random((64, ax.t_bins)) < (0.0 if (row, g) == (1, "RL") else 0.7)
                raw[row, v, g] = x, ok
                if (row, v) != (2, "context"):
                    rows.append((row, v, g, x.ravel().tolist(), ok.ravel().tolist()))
    rows.append((0, "other", "LL", [1.0], [True]))
    grids = spark.createDataFrame(rows, "row bigint, view string, region string, x array<double>, observed array<boolean>")
    stats = spark.createDataFrame([(v, g, 2.0, 0.3 + k) for v in (*views, "other") for k, g in enumerate(regions)], "view string, region string, median double, scale double")
    got = {x["row"]: x for x in cl.view_features(cl.normalise_grids(grids, stats), views, BANDS).collect()}
    assert sorted(got) == [0, 1, 2] and got[0].asDict().keys() == {"row", *names}
    for row in range(3):
        for v, ax in views.items():
            mids = (np.array(ax.f_edges[:-1]) + np.array(ax.f_edges[1:])) / 2
            there = (row, v) != (2, "context")
            for k, g in enumerate(regions):
                x, ok = raw[row, v, g]
                z, w = np.clip((x - 2.0) / (0.3 + k), -8, 8), ok & there
                inner = np.zeros(ok.shape, bool)
                inner[:, ax.centre[0]:ax.centre[1]] = True
                for b, lo, hi in BANDS:
                    band = ((mids >= lo) & (mids < hi))[:, None]
                    if not band.any():
                        continue
                    mean = lambda m: z[m].sum() / max(m.sum(), 1)
                    whole = mean(w & band)
                    rest = whole if ax.whole else mean(w & band & ~inner)
                    assert got[row][f"{v}_{g}_{b}_mean"] == pytest.approx(whole, abs=1e-9)
                    assert got[row][f"{v}_{g}_{b}_contrast"] == pytest.approx(mean(w & band & inner) - rest, abs=1e-9)
            share = np.mean([raw[row, v, g][1].mean() for g in regions]) if there else 0.0
            assert got[row][f"{v}_valid"] == pytest.approx(share)
    assert cl.view_features(grids.where("false"), views, BANDS).count() == 0


def test_spearman(spark, ties):
    got = rk.spearman(spark.createDataFrame(ties), ["m"], "score", "g").toPandas().set_index("m").spearman
    for m, part in ties.groupby("m"):
        assert got[m] == pytest.approx(np.corrcoef(part.score.rank(), part.g.rank())[0, 1])


def test_risk_coverage_and_group_risk(spark, ties):
    got = cv.risk_coverage(spark.createDataFrame(ties), ["m"], "score", "risk", "id", group="g").toPandas()
    for m, part in ties.groupby("m"):
        part = part.sort_values(["score", "id"])
        n = len(part)
        for _, row in got[got.m == m].iterrows():
            k = int(np.clip(np.rint(row.coverage * n), 1, n))
            head = part.head(k)
            assert row.n_accepted == k and row.risk == pytest.approx(head.risk.mean())
            assert row.group_risk == pytest.approx(head.groupby("g").risk.mean().mean())


def brute_merge(sets, low):
    runs = [[b] for b in sorted(sets)]
    while len(runs) > 1:
        size = [len(set().union(*[sets[b] for b in r])) for r in runs]
        bad = [i for i, s in enumerate(size) if s < low]
        if not bad:
            break
        i = bad[0]
        j = 1 if i == 0 else i - 1 if i == len(runs) - 1 else (i - 1 if size[i - 1] <= size[i + 1] else i + 1)
        a, b = min(i, j), max(i, j)
        runs = runs[:a] + [runs[a] + runs[b]] + runs[b + 1:]
    return {b: i for i, r in enumerate(runs) for b in r}


@pytest.mark.parametrize("low", [2, 5, 8, 40])
def test_sparse_bins_merge_like_sets(spark, low):
    rng = random.Random(low)
    rows = [("x", b, rng.randint(0, 12)) for b in range(10) for _ in range(rng.randint(1, 9))]
    got = {r["bin"]: r["merged"] for r in cv.merged_bins(spark.createDataFrame(rows, "m string, bin bigint, g bigint"), ["m"], "g", 10, low).collect()}
    sets = {b: {g for _, c, g in rows if c == b} for b in range(10)}
    assert got == brute_merge(sets, low)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 200) * 2, rng.randint(0, 200) * 2 + 1) for _ in range(170)] + [(1000, 1000 + k) for k in range(1, 60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["root"] for r in sp.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_components_set_leaves_aside(spark, monkeypatch):
    """Pairs, stars, chains, self loops and cycles; the rounds never see a node with one neighbour."""
    rng = random.Random(5)
    edges = [(1, 2), (4, 3), (9, 9), (10, 9), (20, 21), (21, 22), (22, 20), (22, 5), (30, 6), (30, 31), (30, 32), (40, 40), (50, 51), (51, 52), (52, 53), (53, 54), (1, 2)]
    edges += [(100 + rng.randrange(120), 300 + rng.randrange(120)) for _ in range(90)] + [(1000, 1001 + i) for i in range(200)] + [(1200, 2000), (2000, 2001), (2001, 999)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    stars, seen = sp._stars, []
    monkeypatch.setattr(sp, "_stars", lambda e, n: stars(seen.append(e.collect()) or e, n))
    rows = sp.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert sorted(map(tuple, rows)) == sorted((x, find(x)) for x in parent)
    assert 0 < len(seen[0]) < 100 and (2001, 2000) in seen[0] and not any(2 in r or 1001 in r for r in seen[0])


def test_split_shares_and_no_leak(spark):
    rng = random.Random(1)
    rows = [(c, 1 + rng.randint(0, 5)) for c in range(2000)]
    s = spark.createDataFrame(rows, "component bigint, n_rows bigint").withColumns({f"mass{k}": F.pmod("component", F.lit(6)).eqNullSafe(k).cast("double") for k in range(6)})
    p = sp.stratified_allocation(s, "component").toPandas()
    share = p.groupby("partition").n_rows.sum() / p.n_rows.sum()
    assert len(p) == 2000
    for name, want in zip(("train", "tune", "calibration_t", "calibration_p", "test"), (0.6, 0.1, 0.05, 0.05, 0.2)):
        assert abs(share[name] - want) < 0.02


def test_temperature_recovery(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(600, 6))
    soft = lambda x: np.exp(x) / np.exp(x).sum(1, keepdims=True)
    for sharp, want in ((0.5, 2.0), (2.0, 0.5), (0.1, 4.0)):
        q, p = soft(z), soft(z / sharp)
        pdf = pd.DataFrame({f"q{k}": q[:, k] for k in range(6)} | {f"c{k}": p[:, k] for k in range(6)}).assign(m="x", g=np.arange(600) % 40)
        c = spark.createDataFrame(pdf)
        c = c.withColumns({f"c{k}": x for k, x in enumerate(fn.clip_renorm(fn.cols("c")))})
        got = cb.fit_temperature(c, ["m"], "g").first().temperature
        assert got == pytest.approx(want, abs=2e-3)


def test_bootstrap_interval_covers_known_delta(spark):
    rng = np.random.default_rng(2)
    b = rng.gamma(2.0, 0.4, 300)
    pdf = pd.DataFrame({"g": np.arange(300), "la": b - 0.05 + rng.normal(0, 0.05, 300), "lb": b})
    df = spark.createDataFrame(pdf).withColumn("delta", F.col("la") - F.col("lb"))
    row = rs.paired_bootstrap(df, [], "g", 300).first()
    assert row.ci_low < -0.05 < row.ci_high < 0 and row.decision == "superiority_supported"


def test_gather_keeps_every_position_or_raises(spark):
    from plurality.operators import joins as jn

    ids = spark.createDataFrame([(0, 5), (1, 7), (2, 5), (3, 9)], "pos int, k int")
    rows = spark.createDataFrame([(5, "a"), (7, "b")], "k int, x string")
    with pytest.raises(Exception, match="no row for k 9"):
        jn.gather(ids, rows, "k").select("x").collect()
    got = {r.pos: r.x for r in jn.gather(ids, rows, "k", missing="null").collect()}
    assert got == {0: "a", 1: "b", 2: "a", 3: None}
    assert jn.gather(ids.where("k < 9"), rows, "k").count() == 3


def test_release_names_paths_and_leaks(spark):
    from plurality.operators import release as rl
    from plurality.operators import runs as rn

    df = spark.createDataFrame([("m", 1.0, "see /home/x/y.csv"), ("m", float("nan"), "5/7 of all"), ("n", None, "C:\\\\data")], "method string, kl double, note string")
    got = {r.method: r for r in rl.publishing_check(df, ["method"], ["kl"], ["note"]).collect()}
    assert (got["m"].bad_kl, got["m"].paths_note, got["n"].bad_kl, got["n"].paths_note, got["m"].id_columns) == (1, 1, 1, 1, 0)
    assert rl.identifier_columns(["kl", "Patient_ID", "row_id", "component", "width"]) == ["Patient_ID", "row_id", "component"]
    runs = spark.createDataFrame([("c", s, True) for s in (1, 2, 3)], "config string, seed int, ok boolean")
    parts = spark.createDataFrame([(1, 5, "train"), (1, 6, "train"), (2, 6, "test")], "g int, rec int, partition string")
    status = lambda keys: rn.completeness_gate(runs, "config", "seed", F.col("ok"), (1, 2, 3), rn.leaked_members(parts, keys)).first().status
    assert status(["g"]) == "PASS" and status(["g", "rec"]) == "BLOCKED"


def test_unpaired_arms_and_missing_seeds_raise(spark):
    good = [(m, s, g, float(g + s)) for m in "ab" for s in (1, 2) for g in range(4)]
    make = lambda rows: rs.paired_differences(spark.createDataFrame(rows, "m string, seed int, g int, x double"), [], "g", "seed", "x", F.col("m") == "a", F.col("m") == "b")
    assert make(good).count() == 4 and {r.delta for r in make(good).collect()} == {0.0}
    with pytest.raises(Exception, match="unpaired group 3"):
        make([r for r in good if r[:3] != ("b", 2, 3)]).collect()
    with pytest.raises(Exception, match="fewer seeds"):
        make([r for r in good if (r[1], r[2]) != (2, 1)]).collect()


def test_ranks_shuffle_rows_once(spark):
    """Ranks come from places in the checkpoint: after it no row is shuffled or sorted again, whatever a broadcast carries."""
    df = spark.range(0, 5000, 1, 7).selectExpr("id % 3 as m", "hash(id) % 40 as score", "id")
    got = rk.ordered_prefix(df, ["m"], ["score", "id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    pdf = got.toPandas().sort_values(["m", "score", "id"])
    assert (pdf["rank"] == pdf.groupby("m").cumcount() + 1).all() and (pdf.n_total == pdf.groupby("m").id.transform("size")).all()


@pytest.mark.parametrize("few", [0, 200_000])
def test_spearman_with_few_or_many_values(spark, monkeypatch, few):
    """Both ways to the midranks against pandas, and only the second orders pairs."""
    monkeypatch.setattr(rk, "SMALL_ROWS", few)
    asked = []
    monkeypatch.setattr(rk, "_midranks", lambda *a, _f=rk._midranks: asked.append(a) or _f(*a))
    rng = np.random.default_rng(8)
    b = rng.integers(0, 9, 3000)
    pdf = pd.DataFrame({"m": rng.choice(["x", "y"], 3000), "a": np.round(b / 9 + rng.normal(size=3000), 1), "b": b / 8})
    got = rk.spearman(spark.createDataFrame(pdf), ["m"], "a", "b").toPandas().set_index("m").spearman
    for m, p in pdf.groupby("m"):
        assert got[m] == pytest.approx(p.a.rank().corr(p.b.rank()), abs=1e-12)
    assert bool(asked) == (few == 0)


def test_keys_with_as_many_groups_share_draws(spark):
    """A block of groups is one task's for all keys that draw from as many groups, and the sums are those of its draws."""
    pdf = pd.DataFrame([(m, g, float(g * k)) for m, k in (("x", 1), ("y", 2)) for g in range(1500)], columns=["m", "g", "v"])
    r = rs.replicate_sums(spark.createDataFrame(pdf), ["m"], "g", ["v"], replicates=5)
    plan = r._jdf.queryExecution().toString()
    assert "RepartitionByExpression [n_groups" in plan
    draws = rs.Draws(1500, 5, rs.BOOT_SEED)
    want = np.concatenate([draws.block(0), draws.block(1)], 1) @ np.arange(1500.0)
    got = r.toPandas().pivot(index="replicate", columns="m", values="v").sort_index()
    assert np.allclose(got.x, want) and np.allclose(got.y, 2 * want)


def test_spearman_of_ties_without_a_value_join(spark):
    rng = np.random.default_rng(7)
    rows = [("x", float(rng.integers(0, 3)), float(rng.integers(0, 4))) for _ in range(3000)] + [("y", 1.0, float(i)) for i in range(5)] + [("z", float(i), float(-i)) for i in range(50)]
    pdf = pd.DataFrame(rows, columns=["m", "a", "b"])
    got = rk.spearman(spark.createDataFrame(pdf).repartition(6), ["m"], "a", "b").toPandas().set_index("m").spearman
    x = pdf[pdf.m == "x"]
    assert got["x"] == pytest.approx(np.corrcoef(x.a.rank(), x.b.rank())[0, 1]) and got["z"] == pytest.approx(-1.0) and (got["y"] is None or np.isnan(got["y"]))


def all_draws(n, replicates, seed=rs.BOOT_SEED):
    d = rs.Draws(n, replicates, seed)
    return np.concatenate([d.block(k) for k in range(-(-n // rs.BLOCK_GROUPS))], axis=1)


def test_draws_are_multinomial_and_do_not_depend_on_the_task(monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_GROUPS", 16)
    for n in (1, 7, 16, 17, 250):
        m = all_draws(n, 4000)
        assert m.shape == (4000, n) and (m.sum(1) == n).all() and m.min() >= 0
        # binomial(n, 1/n) for each group: mean 1, variance 1 - 1/n, covariance -1/n
        assert np.abs(m.mean(0) - 1).max() < 6 / np.sqrt(4000) and abs(m.var(0).mean() - (1 - 1 / n)) < 0.06
        if n > 17:
            c = np.cov(m.T)
            assert abs(c[np.triu_indices(n, 1)].mean() + 1 / n) < 0.002
            zero = (1 - 1 / n) ** n
            assert abs((m == 0).mean() - zero) < 0.01
        alone = rs.Draws(n, 4000, rs.BOOT_SEED)
        last = (n - 1) // 16
        assert (alone.block(last) == m[:, last * 16 :]).all()


def test_replicates_equal_listing_by_hand(spark, monkeypatch):
    """Interval limits from 2,000 replicates against NumPy with the same multiplicities, keys of unlike size, nulls and all."""
    rng = np.random.default_rng(5)
    rows = [(k, g, float(rng.gamma(2)) if rng.random() < 0.9 else None, float(rng.integers(0, 5))) for k, n in (("a", 1500), ("b", 1500), ("c", 3)) for g in rng.permutation(n).tolist()]
    df = spark.createDataFrame(rows, "k string, g bigint, x double, w double").repartition(7)
    got = {(r.k, r.replicate): r for r in rs.replicate_sums(df, ["k"], "g", ["x", "w"]).collect()}
    assert len(got) == 3 * rs.REPLICATES
    for k, n in (("a", 1500), ("b", 1500), ("c", 3)):
        m = all_draws(n, rs.REPLICATES)
        x = np.array([v for _, v in sorted((g, v or 0.0) for kk, g, v, _ in rows if kk == k)])
        assert np.allclose([got[k, r].x for r in range(rs.REPLICATES)], m @ x)
    ci = {r.k: r for r in rs.group_mean_bootstrap(df, ["k"], "g", "x").collect()}
    x = np.array([v if v is not None else np.nan for _, v in sorted((g, v) for kk, g, v, _ in rows if kk == "a")])
    m = all_draws(1500, rs.REPLICATES)
    means = (m @ np.nan_to_num(x)) / (m @ ~np.isnan(x))
    assert ci["a"].n_replicates == 2000 and np.allclose([ci["a"].ci_low, ci["a"].ci_high], np.percentile(means, [2.5, 97.5]))
    # rows of several inner keys share the draws of their groups
    inner = df.withColumn("bin", F.pmod("g", F.lit(2)))
    b = {(r.k, r.bin): r for r in rs.bootstrap_statistic(inner, ["k"], "g", ["w"], lambda: F.col("w"), within=["bin"]).collect()}
    w = np.array([v for _, v in sorted((g, v) for kk, g, _, v in rows if kk == "a")])
    for odd in (0, 1):
        v = m[:, odd::2] @ w[odd::2]
        assert np.allclose([b["a", odd].point, b["a", odd].ci_low, b["a", odd].ci_high], [w[odd::2].sum(), *np.percentile(v, [2.5, 97.5])])


def test_rows_carry_the_draws_of_their_group(spark):
    rows = [("a", g, i) for g in range(1100) for i in range(2)] + [("b", 0, i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, g bigint, i bigint").repartition(5)
    got = rs.with_draws(df, ["k"], "g", 40).collect()
    m = all_draws(1100, 40)
    assert len(got) == len(rows) and all((np.frombuffer(bytes(r.draws), "<u2") == (m[:, r.g] if r.k == "a" else 1)).all() for r in got)


def test_poisson_draws_only_when_asked_for(spark):
    idx = rs.group_index(spark.range(500).select(F.col("id").alias("g")), [], "g")
    assert rs.multiplicities(idx, [], "g", 2).select("draw_method").distinct().collect()[0][0] == "exact"
    m = rs.multiplicities(idx, [], "g", 20, method="poisson")
    row = m.agg(F.sum("m").alias("s"), F.min("draw_method").alias("k")).first()
    assert row.k == "poisson" and abs(row.s / 10000 - 1) < 0.05


def test_holm(spark):
    df = spark.createDataFrame([("f", 0.01, 1), ("f", 0.04, 2), ("f", 0.03, 3)], "f string, p double, id int")
    got = {r["p"]: r["p_adjusted"] for r in rs.holm_adjust(df, ["f"], "p", "id").collect()}
    assert got == pytest.approx({0.01: 0.03, 0.03: 0.06, 0.04: 0.06})


def test_mde_table(spark):
    row = spark.range(1).select(*[rs.minimum_detectable_effect(F.lit(s), F.lit(390)).alias(f"x{i}") for i, s in enumerate((0.1, 0.2, 0.3))]).first()
    assert [round(x, 4) for x in row] == [0.0142, 0.0284, 0.0426]


def test_foveated_edges():
    e = iv.foveated_edges(32)
    assert len(e) == 33 and e[8] == 20.0 and e[24] == 30.0 and e[-1] == 50.0
    assert set(iv.foveated_edges(8)) <= set(e)
    with pytest.raises(ValueError):
        iv.foveated_edges(12)


def test_locked_partition_guard(spark):
    df = spark.createDataFrame([("test",), ("tune",)], "partition string")
    with pytest.raises(gt.GateError):
        gt.select_partitions(df, ["test"])
    assert gt.select_partitions(df, ["test"], role="evaluator").count() == 1


def test_truncated_window_is_padded_not_shifted(spark):
    s = spark.createDataFrame([(1, 0, i, float(i) if i != 48 else None) for i in range(50) if i != 45], "recording_id bigint, channel bigint, sample bigint, x double")
    w = spark.createDataFrame([(1, 7, 40), (1, 8, 90), (2, 9, 0)], "recording_id bigint, row bigint, start bigint")
    rc = sg.Recipe(rate=8.0, length=16, nperseg=8, hop=8, nfft=8, max_gap=2, leads=(("A", 0, 0, 0),))
    win = iv.extract_windows(iv.sample_blocks(s, 16), w, 16)
    p = {r.row: r for r in sg.stage_rows(win, rc, "samples").collect()}
    assert p[7].x[:5] == [40.0, 41.0, 42.0, 43.0, 44.0] and not any(p[7].observed[10:]) and not any(p[7].in_range[10:])
    assert not p[7].observed[5] and not p[7].in_range[5] and not p[7].observed[8] and p[7].in_range[8]
    assert p[8].x == p[9].x == [0.0] * 16 and not any(p[8].in_range + p[9].in_range)
    f = {r.row: r.x for r in sg.stage_rows(win, rc, "filled").collect()}[7]
    assert f[5] == 45.0 and f[8] == 48.0 and f[12] == 0.0


def test_memory_of_windows_computed_together():
    """The tensors of one step of the stand-in geometry, whose windows are short and so many, stay below 64 MB."""
    import tracemalloc

    import pyarrow as pa

    from plurality.plans.spectral import RC

    n = min(10_000, sg.FRAME_NUMBERS // (len(RC.leads) * RC.frames * RC.nperseg))
    x = np.random.default_rng(0).normal(size=n * 5 * RC.length)
    part = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(5), n)), pa.array(np.zeros(n * 5, np.int32)),
                                       pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, RC.length), pa.int32()), pa.array(x))], names=["channel", "pos", "x"])
    parts = pa.ListArray.from_arrays(pa.array(np.arange(0, n * 5 + 1, 5), pa.int32()), part)
    tracemalloc.start()
    sg._emit(sg.Tensors(RC, range(5), parts, np.ones((n, 5), bool)), "cells", range(5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 * 2**20


def test_lacking_channels_leave_no_rows(spark):
    """Recording 1 lacks channel 2 and with it region B, recording 2 has one channel and so no lead."""
    x = np.arange(32.0).tolist()
    s = spark.createDataFrame([(1, 0, x), (1, 1, x[:20]), (2, 0, x)], "recording_id bigint, channel bigint, x array<double>")
    w = spark.createDataFrame([(1, 7, 0), (1, 8, 16), (2, 9, 0)], "recording_id bigint, row bigint, start bigint")
    rc = sg.Recipe(rate=8.0, length=16, nperseg=8, hop=8, nfft=8, f_edges=(0.5, 2.0), views={"local": [0.0, 1.0, 2.0]}, leads=(("A", 0, 0, 1), ("B", 1, 1, 2)), min_leads=1)
    win = iv.extract_windows(iv.array_blocks(s, 16), w, 16)
    rows = lambda stage, *keys, own=True: sorted(r[:] for r in sg.stage_rows(win, rc, stage, own=own).select("row", *keys).collect())
    assert rows("samples", "channel") == [(7, 0), (7, 1), (8, 0), (8, 1), (9, 0)]
    assert rows("centred", "region", "lead") == [(7, "A", 0), (8, "A", 0)]
    assert rows("power", "lead", "frame") == [(r, 0, f) for r in (7, 8) for f in (0, 1)]
    assert rows("bands", "region", "frame") == [(r, "A", f) for r in (7, 8) for f in (0, 1)]
    # window 8: channel 1 ends after four samples, the lead's first frame is half seen and its last not at all
    assert rows("cells", "region", "lead_valid", "seen", "missing") == [(7, "A", 1.0, 1.0, 0), (8, "A", 0.0, 0.625, 0)]
    assert len(rows("samples", "channel", own=False)) == 9 and len(rows("cells", "region", own=False)) == 6


def test_windows_of_a_hot_block_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(iv, "WINDOWS_PER_COPY", 4)
    x = np.arange(100.0)
    s = spark.createDataFrame([(1, 0, x.tolist()), (2, 0, x[:20].tolist())], "recording_id bigint, channel bigint, x array<double>")
    starts = [(1, i, 17 + i % 15) for i in range(200)] + [(2, 1000 + i, i) for i in range(25)]
    w = spark.createDataFrame(starts, "recording_id bigint, row bigint, start bigint")
    rc = sg.Recipe(rate=8.0, length=16, nperseg=8, hop=8, nfft=8, leads=(("A", 0, 0, 0),))
    got = {r.row: r for r in sg.stage_rows(iv.extract_windows(iv.array_blocks(s, 16), w, 16), rc, "samples").collect()}
    assert len(got) == 225
    for rec, row, start in starts:
        n = 100 if rec == 1 else 20
        assert got[row].x == [float(start + i) if start + i < n else 0.0 for i in range(16)]
        assert got[row].observed == got[row].in_range == [start + i < n for i in range(16)]


def test_short_gaps_are_interpolated_like_interp():
    rng = np.random.default_rng(3)
    x, seen = rng.normal(size=(40, 60)), rng.random((40, 60)) < rng.random((40, 1))
    got = sg.short_gaps_filled(np.where(seen, x, 0.0), seen, 3)
    for row, ok, out in zip(x, seen, got):
        at = np.flatnonzero(ok)
        want = np.where(ok, row, 0.0)
        for left, right in zip(at, at[1:]):
            if right - left - 1 <= 3:
                want[left:right + 1] = np.interp(np.arange(left, right + 1), at, row[at])
        assert np.allclose(out, want)


def small_recipe(**kw):
    return sg.Recipe(rate=100.0, length=1000, nperseg=100, hop=25, nfft=100, max_gap=5, f_edges=tuple(iv.uniform_edges(20, 0.5, 40.5)),
                     views={"local": iv.foveated_edges(32, 0.2)}, leads=(("A", 0, 0, 1), ("A", 1, 2, 3)), **kw)


def tone(spark, hz=10.0, lo=4.0, hi=6.0, drop=()):
    t = np.arange(1000) / 100.0
    rng = np.random.default_rng(1)
    rows = []
    for c in range(4):
        x = rng.normal(0, 0.01, 1000) + (np.sin(2 * np.pi * hz * t) * ((t >= lo) & (t < hi)) if c % 2 == 0 else 0)
        rows += [(1, c, i, float(x[i])) for i in range(1000) if i not in drop]
    s = spark.createDataFrame(rows, "recording_id bigint, channel bigint, sample bigint, x double")
    w = spark.createDataFrame([(1, 100, 0)], "recording_id bigint, row bigint, start bigint")
    return iv.extract_windows(iv.sample_blocks(s, 1000), w, 1000)


def test_tone_lands_in_target_cells(spark):
    c = sg.encode(tone(spark), small_recipe()).toPandas()
    top = c.loc[c.value.idxmax()]
    assert 8 <= top.tbin < 24 and abs((0.5 + (top.fbin + 0.5) * 2.0) - 10.0) <= 2.0 and c.valid.all()


def test_missing_tail_only_invalidates_the_tail(spark):
    c = sg.encode(tone(spark, drop=set(range(700, 1000))), small_recipe()).toPandas()
    ok = c.groupby("tbin").valid.all()
    assert ok[:24].all() and not ok[27:].any()


def plain_cells(x, seen, rc):
    """One window encoded by loops over leads, frames and bins: {(region, fbin, tbin): (value, valid)} of the local view."""
    n_src, df = rc.nfft // 2 + 1, rc.rate / rc.nfft
    x = {c: sg.short_gaps_filled(np.where(seen[c], x[c], 0.0), seen[c], rc.max_gap) for c in x}
    spectra, good = {}, {}
    for lead in rc.leads:
        ok = seen[lead[2]] & seen[lead[3]]
        d = x[lead[2]] - x[lead[3]]
        d = np.where(ok, d - (np.median(d[ok]) if ok.any() else 0.0), 0.0)
        for f in range(rc.frames):
            part = slice(f * rc.hop, f * rc.hop + rc.nperseg)
            spectra[lead, f] = np.abs(np.fft.fft(d[part] * np.sin(np.pi * np.arange(rc.nperseg) / rc.nperseg) ** 2)[:n_src]) ** 2
            good[lead, f] = ok[part].sum() >= 0.9 * rc.nperseg
    out, edges = {}, rc.views["local"]
    for region in rc.regions:
        leads = [lead for lead in rc.leads if lead[0] == region]
        mean, live = [], []
        for f in range(rc.frames):
            use = [spectra[lead, f] for lead in leads if good[lead, f]]
            mean.append(sum(use) / len(use) if use else np.zeros(n_src))
            live.append(len(use) >= rc.min_leads)
        for b, (lo, hi) in enumerate(zip(rc.f_edges, rc.f_edges[1:])):
            wf = [max(0.0, min(hi, (k + 0.5) * df) - max(lo, (k - 0.5) * df)) for k in range(n_src)]
            band = [np.dot(wf, m) / sum(wf) for m in mean]
            for t, (lo_t, hi_t) in enumerate(zip(edges, edges[1:])):
                wt = [max(0.0, min(hi_t, e) - max(lo_t, s)) for s, e in rc.frame_times()]
                alive = sum(w for w, a in zip(wt, live) if a)
                ok = alive >= 0.5 * sum(wt) - 1e-9
                value = np.log(max(sum(w * v for w, v, a in zip(wt, band, live) if a) / max(alive, 1e-12), 1e-8)) if ok else 0.0
                out[region, b, t] = (value, ok)
    return out


def test_encoding_equals_plain_loops(spark):
    drop = {100, 101, 500, 501, 502, 503, 504, 505, 506, 507, *range(860, 960)}
    rc = small_recipe(min_leads=1)
    win = tone(spark, drop=drop)
    got = {(r.region, r.fbin, r.tbin): (r.value, r.valid) for r in sg.encode(win, rc).collect()}
    raw = {r.channel: np.array(r.x) for r in sg.stage_rows(win, rc, "samples").collect()}
    seen = {c: np.array([i not in drop for i in range(1000)]) for c in raw}
    want = plain_cells(raw, seen, rc)
    assert got.keys() == want.keys() and len(got) == 640 and any(not ok for _, ok in want.values())
    assert all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)


def published_windows(spark, n):
    """Windows of the published geometry: 20 channels of 10,000 samples at 200 Hz from recordings twice as long."""
    names = sorted({c for r in sg.Recipe().leads for c in r[2:]})
    rng = np.random.default_rng(4)
    number = {c: i for i, c in enumerate(names)}
    rc = sg.Recipe(leads=tuple((r, i, number[a], number[b]) for r, i, a, b in sg.Recipe().leads))
    rows = []
    for c in range(20):
        x = rng.normal(size=20_000)
        x[5_000 + 10 * c : 5_003 + 10 * c] = np.nan
        rows.append((1, c, x.tolist()))
    s = spark.createDataFrame(rows, "recording_id bigint, channel bigint, x array<double>")
    w = spark.createDataFrame([(1, i, 900 * i) for i in range(n)], "recording_id bigint, row bigint, start bigint")
    return iv.extract_windows(iv.array_blocks(s, 10_000), w, 10_000), rc, {c: np.array(x) for _, c, x in rows}


def test_published_geometry(spark):
    win, rc, x = published_windows(spark, 12)
    assert len(x) == 20 and len({c for lead in rc.leads for c in lead[2:]}) == 16  # of 20 channels
    cells = sg.encode(win, rc).where("row in (0, 11)").collect()
    assert len(cells) == 2 * 2 * 4 * 64 * 32
    for row, start in ((0, 0), (11, 9_900)):
        part = {c: v[start : start + 10_000] for c, v in x.items()}
        want = plain_cells({c: np.nan_to_num(v) for c, v in part.items()}, {c: ~np.isnan(v) for c, v in part.items()}, rc)
        got = {(r.region, r.fbin, r.tbin): (r.value, r.valid) for r in cells if r.row == row and r.view == "local"}
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-6 for k in want)


def test_signal_plan_has_no_row_per_sample(spark, data):
    from plurality.plans.spectral import _stage

    plan = _stage(spark, data, "cells")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan.lower() and plan.count("MapInArrow") == 1


def test_dense_context_grid_on_an_uneven_axis(spark):
    """4 regions, 64 x 64 cells for every key, against plain loops; a key without rows has a grid without a valid cell."""
    rng = np.random.default_rng(6)
    freqs = tuple(np.cumsum(rng.uniform(0.1, 0.6, 100)) + 0.3)
    rc = sg.ContextRecipe(freqs=freqs, regions=("LL", "RL", "LP", "RP"))
    power = rng.gamma(1.0, 2.0, (40, 4, 100))
    power[rng.random(power.shape) < 0.2] = np.nan
    power[5:9, 2] = -1.0
    power[11, 1, 3] = np.inf
    wide = [(1, 2.0 * i, 2.0 * i + 2.0, *[float(x) for x in power[i].ravel()]) for i in range(40)]
    columns = [f"{r}_{f}" for r in rc.regions for f in freqs]
    df = spark.createDataFrame(wide, ["sid", "lo", "hi", *columns])
    bands = sg.context_bands(sg.spectrogram_arrays(df, ["sid", "lo", "hi"], sg.parse_region_columns(columns)), rc, ["sid", "lo", "hi"])
    wanted = spark.createDataFrame([(1, 13.0), (1, -595.0), (1, 5000.0), (2, 0.0)], "sid bigint, offset double")
    j = iv.select_rows(bands, wanted, "sid", "lo", "hi", rc.span, 300.0)
    j = j.withColumns({"lo": F.col("lo") - F.col("offset"), "hi": F.col("hi") - F.col("offset")})
    got = {(r.sid, r.offset, r.region): (np.array(r.x).reshape(64, 64), np.array(r.observed).reshape(64, 64)) for r in sg.context_grids(j, wanted, rc, ["sid", "offset"]).collect()}
    assert len(got) == 16 and not any(got[k][1].any() for k in got if k[0] == 2 or k[1] == 5000.0)
    mid = (np.array(freqs[1:]) + freqs[:-1]) / 2
    half = np.median(np.diff(freqs)) / 2
    src = np.concatenate([[freqs[0] - half], mid, [freqs[-1] + half]])
    dst, times = np.linspace(src[0], src[-1], 65), np.linspace(0, 600, 65)
    for offset in (13.0, -595.0):
        for r, region in enumerate(rc.regions):
            num, wt = np.zeros((64, 64)), np.zeros((64, 64))
            for i in range(40):
                lo, hi = 2.0 * i - offset, 2.0 * i + 2.0 - offset
                p = power[i, r]
                good = np.isfinite(p) & (p >= 0)
                for b in range(64):
                    w = np.maximum(0, np.minimum(src[1:], dst[b + 1]) - np.maximum(src[:-1], dst[b]))
                    w = w / w.sum()
                    if w[good].sum() < 0.5 - 1e-9:
                        continue
                    t = np.maximum(0, np.minimum(hi, times[1:]) - np.maximum(lo, times[:-1]))
                    num[b] += t * (w[good] @ p[good]) / w[good].sum()
                    wt[b] += t
            ok = wt >= 0.5 * np.diff(times) - 1e-9
            value, valid = got[1, offset, region]
            assert (valid == ok).all() and ok.any() and np.allclose(value, np.where(ok, np.log(np.maximum(num / np.maximum(wt, 1e-12), 1e-8)), 0.0), atol=1e-9)


def test_pooling(spark):
    df = spark.createDataFrame([(1, 0, 0.0, True), (1, 1, float(np.log(3)), True), (1, 2, 0.0, False), (1, 3, 0.0, False)], "row bigint, tbin bigint, value double, valid boolean")
    got = {r["tbin"]: (r["value"], r["valid"]) for r in cl.pool_time_bins(df, 2).collect()}
    assert got[0] == (pytest.approx(np.log(2)), True) and got[1] == (0.0, False)


def test_grouped_calibration_error(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(6), 300)
    q = rng.multinomial(5, np.full(6, 1 / 6), 300) / 5
    pdf = pd.DataFrame({f"c{k}": p[:, k] for k in range(6)} | {f"q{k}": q[:, k] for k in range(6)}).assign(
        m="x", id=np.arange(300), g=np.arange(300) % 25, yhat=p.argmax(1), y=0)
    df = spark.createDataFrame(pdf)
    plain = cv.soft_ece(df, ["m"], "id").first()
    loose = cv.soft_ece(df, ["m"], "id", group="g", min_groups=1).first()
    one = cv.soft_ece(df, ["m"], "id", group="g", min_groups=26).first()
    assert loose.ece == pytest.approx(plain.ece) and loose.n_bins == 10
    obs = q[np.arange(300), p.argmax(1)]
    assert one.n_bins == 1 and one.ece == pytest.approx(abs(p.max(1).mean() - obs.mean()))


def test_big_counts_do_not_overflow(spark):
    from plurality.operators.splits import _signature

    edges = spark.range(20_000_000).select((F.col("id") + 1).alias("u"), F.lit(0).cast("bigint").alias("v"))
    assert _signature(edges)[0] == 20_000_000


def test_soft_regression_equals_numpy(spark):
    """Weights and probabilities of the fit on fractional targets against Newton steps in NumPy."""
    from plurality.operators import models as md

    rng = np.random.default_rng(10)
    n, f, k, l2 = 400, 3, 6, 1e-3
    x = rng.normal(size=(n, f)) * [1.0, 5.0, 0.2] + [0.0, 3.0, -1.0]
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    logits = z @ rng.normal(size=(f, k))
    q = rng.dirichlet(np.ones(k), n) * 0.3 + 0.7 * np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    df = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, q)], [*[f"f{i}" for i in range(f)], *[f"q{i}" for i in range(k)]])
    m = md.fit_soft_regression(df, [f"f{i}" for i in range(f)], l2=l2)
    one = np.hstack([z, np.ones((n, 1))])
    w = np.zeros((k, f + 1))
    ridge = np.diag([*[2 * l2] * f, 1e-9])
    for _ in range(30):
        p = np.exp(one @ w.T - (one @ w.T).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = (p - q).T @ one / n + w @ ridge
        hess = np.zeros((k * (f + 1), k * (f + 1)))
        for a in range(k):
            for b in range(k):
                h = (one * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ one / n + (ridge if a == b else 0)
                hess[a * (f + 1) : (a + 1) * (f + 1), b * (f + 1) : (b + 1) * (f + 1)] = h
        w -= np.linalg.lstsq(hess, grad.ravel(), rcond=None)[0].reshape(k, f + 1)
    assert np.allclose(m.weight, w[:, :f], atol=5e-3) and np.allclose(m.mean, x.mean(0)) and np.allclose(m.sd, x.std(0) + 1e-6)
    got = m.score(df).select(*[f"p{i}" for i in range(k)]).toPandas().to_numpy()
    assert np.allclose(np.sort(got, 0), np.sort(p, 0), atol=2e-3)


def test_report_rounds_like_the_twins(spark):
    """DuckDB's round of these to six decimals, on the product with a million."""
    want = [(1292 / 2560, 0.504687), (0.0000005, 0.000001), (0.5046885, 0.504689), (-1292 / 2560, -0.504687), (-1e-9, 0.0), (1e303, 1e303), (None, None)]
    got = tidy(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(want)], "i int, x double")).orderBy("i").collect()
    assert [r.x for r in got] == [y for _, y in want] and str(got[4].x) == "0.0"


def test_span_grids_equal_the_grids_of_selected_rows(spark):
    """rows meet a whole span's offsets at once; same grids and sums as from rows selected per offset, and no row per pair."""
    rng = np.random.default_rng(8)
    rc = sg.ContextRecipe(freqs=(1.0, 2.0, 3.5, 6.0), regions=("a", "b"), f_bins=4, t_bins=8)
    rows = [(sid, r, 50.0 * i, 50.0 * i + (700.0 if i % 9 == 0 else 50.0), [float(x) if x > 0.1 else None for x in rng.random(4)]) for sid in (1, 2) for i in range(40) for r in ("a", "b", "c") if rng.random() < 0.8]
    bands = sg.context_bands(spark.createDataFrame(rows, "sid bigint, region string, lo double, hi double, power array<double>"), rc, ["sid", "lo", "hi"])
    wanted = spark.createDataFrame([(s, float(o)) for s in (1, 2, 3) for o in (-900, -595, 0, 13.5, 599.5, 600, 1234, 1799, 9000)], "sid bigint, offset double")
    j = iv.select_rows(bands, wanted, "sid", "lo", "hi", rc.span, 300.0)
    j = j.withColumns({"lo": F.col("lo") - F.col("offset"), "hi": F.col("hi") - F.col("offset")})
    want = {(r.sid, r.offset, r.region): (r.x, r.observed) for r in sg.context_grids(j, wanted, rc, ["sid", "offset"]).collect()}
    got = {(r.sid, r.offset, r.region): (r.x, r.observed) for r in sg.span_grids(bands, wanted, rc, "sid").collect()}
    assert got.keys() == want.keys() and len(got) == 54
    assert all(got[k][1] == want[k][1] and np.allclose(got[k][0], want[k][0], atol=1e-12) for k in want) and any(any(v[1]) for v in want.values())
    for r in sg.span_summaries(bands, wanted, rc, "sid").collect():
        x = [want[r.sid, r.offset, g] for g in rc.regions]
        assert (r.n_cells, r.n_valid) == (64, sum(map(sum, (o for _, o in x)))) and abs(r.total - sum(map(sum, (v for v, _ in x)))) < 1e-9


def test_running_sums_need_no_second_shuffle(spark):
    """sums run along the ordered partitions; no window over the rows is left."""
    rng = random.Random(12)
    rows = [(rng.choice("ab"), i, rng.randrange(5), rng.randrange(3)) for i in range(500)] + [("c", 900, 2, 1)]
    p = rk.ordered_prefix(spark.createDataFrame(rows, "k string, s bigint, n bigint, m bigint").repartition(7), ["k"], [F.desc("s")], {"n": F.col("n"), "m": F.col("m")}, 6)
    assert "row_number" not in p._jdf.queryExecution().optimizedPlan().toString().lower()
    got, want = sorted(tuple(r) for r in p.select("k", "s", "rank", "n_total", "cum_n", "cum_m", "all_n", "all_m").collect()), []
    for k in "abc":
        own = sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])
        want += [(k, r[1], i + 1, len(own), sum(x[2] for x in own[: i + 1]), sum(x[3] for x in own[: i + 1]), sum(x[2] for x in own), sum(x[3] for x in own)) for i, r in enumerate(own)]
    assert got == sorted(want)
