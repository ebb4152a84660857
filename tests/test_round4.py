"""Tests of round 4's changes: orders from packed cells."""

import gzip
import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plurality.operators import curves as cv
from plurality.operators import resample as rs
from plurality.operators import scorecells as sc
from plurality.plans import resampling
from plurality.session import shared_dir
from plurality.sources import sinks

_ODD = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 0.5, 1e-300, -1.5]


def _rows(n, seed=4):
    rng = random.Random(seed)
    score = lambda: rng.choice(_ODD) if rng.random() < 0.2 else rng.choice([rng.random(), rng.randrange(40) / 40])
    return [(rng.choice(["a", "b"]), rng.choice([1, 2]), i, rng.choice([-1, 0, 1, 2, None]), *[score() for _ in range(3)]) for i in range(n)]


def _place(x):
    return (0, 0.0) if x is None else (2, 0.0) if math.isnan(x) else (1, x + 0.0)


def test_keys_keep_the_order_of_scores():
    keys = sc.to_keys(pa.array(_ODD, pa.float64()))
    assert sorted(range(len(_ODD)), key=lambda i: _place(_ODD[i])) == sorted(range(len(_ODD)), key=lambda i: (int(keys[i]), i))
    back = sc.to_scores(keys).to_pylist()
    assert all(a is b is None or _place(a) == _place(b) for a, b in zip(_ODD, back))


@pytest.mark.parametrize("most", [1, 3, 10**6])
def test_packed_cells_come_back(most):
    rng = np.random.default_rng(5)
    keys, n, pos = sc.counted(rng.integers(0, most, 500, dtype=np.uint64) + np.uint64(2**63), None, rng.random(500) < 0.3)
    for a, b in zip(sc.unpack(len(keys), *sc.pack(keys, n, pos)), (keys, n, pos)):
        assert (a == b).all()


@pytest.mark.parametrize("cells", [20, 10**6])
def test_running_counts_equal_brute_force(spark, monkeypatch, cells):
    """Many small cells and one per key, tasks that pack often, ties, nulls, NaN, infinities and both zeros."""
    monkeypatch.setattr(sc, "CELL_SCORES", cells)
    monkeypatch.setattr(sc, "HELD_SCORES", 300)
    monkeypatch.setattr(sc, "SAMPLE", 2)
    data = _rows(1500)
    df = spark.createDataFrame(data, "m string, s int, id bigint, y bigint, c0 double, c1 double, c2 double").repartition(3)
    got = sc.running_counts(df, ["m", "s"], "id", 3)
    want = {}
    for m in "ab":
        for s in (1, 2):
            rows = [r for r in data if r[:2] == (m, s) and r[3] is not None and r[3] >= 0]
            for j in range(3):
                n, pos = Counter(_place(r[4 + j]) for r in rows), Counter(_place(r[4 + j]) for r in rows if r[3] == j)
                cn = cp = 0
                for x in sorted(n, reverse=True):
                    cn, cp = cn + n[x], cp + pos[x]
                    want[m, s, j, x] = (n[x], pos[x], cn, cp, len(rows), sum(pos.values()))
    found = {(r["m"], r["s"], r["class"], _place(r["score"])): (r.n_at, r.pos_at, r.cum_n, r.cum_pos, r.all_n, r.all_pos) for r in got.collect()}
    assert found == want
    auc = {(r["m"], r["s"], r["class"]): r.auroc for r in cv.auroc_ap(got, ["m", "s"]).collect()}
    assert len(auc) == 12 and all(0 < v < 1 for v in auc.values())


def test_ordering_scores_writes_few_bytes(spark):
    """Rows of scores are neither checkpointed nor shuffled; sorted scores take some seven bytes before the shuffle compresses them."""
    df = spark.range(0, 60000, 1, 4).select(F.lit("a").alias("m"), "id", F.pmod("id", F.lit(3)).alias("y"), *[F.rand(k).alias(f"c{k}") for k in range(3)])
    held = lambda: sum(os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(shared_dir(spark).removeprefix("file:")) for x in names)
    before = held()
    assert sc.running_counts(df, ["m"], "id", 3).where("cum_n = all_n").count() == 3
    assert held() - before < 180000  # a byte a score
    keys = sc.counted(sc.to_keys(pa.array(np.random.default_rng(6).random(20000))), None, np.zeros(20000, bool))
    assert sum(len(x or b"") for x in sc.pack(*keys)[1:]) < 7.2 * 20000


def test_passes_that_differ_are_told(spark, monkeypatch):
    df = spark.range(2000).select(F.lit("a").alias("m"), "id", F.lit(0).alias("y"), F.rand().alias("c0"))
    parts = sc._parts
    monkeypatch.setattr(sc, "_parts", lambda rows, *a: parts(rows if a[-1] else rows.where("c0 < 0.5"), *a))
    with pytest.raises(Exception, match="differ between two passes"):
        sc.running_counts(df, ["m"], "id", 1).count()


def test_listed_draws_are_multinomial():
    """Every replicate has as many draws as groups, the counts have the moments of a multinomial, and sums are those of the counts."""
    n, replicates = 2500, 400
    d = rs.ListedDraws(n, replicates, rs.BOOT_SEED)
    m = np.concatenate([d.block(k) for k in range(3)], 1)
    assert m.shape == (replicates, n) and (m.sum(1) == n).all()
    assert abs(m.var() - (1 - 1 / n)) < 0.01 and (np.bincount(m.ravel(), minlength=2)[:2] / m.size == pytest.approx([math.exp(-1)] * 2, abs=2e-3))
    assert abs(np.corrcoef(m[:, :900].sum(1), m[:, 900:].sum(1))[0, 1] + 1) < 1e-9
    values = np.random.default_rng(7).random((1024, 3))
    values[:, 1] = 1.0
    for draws in (d, rs.ListedDraws(1, 5, 1), rs.ListedDraws(1025, 70, 1)):
        size = draws.block(0).shape[1]
        assert draws.sums(0, values[:size]) == pytest.approx(draws.block(0).astype(float) @ values[:size])
    last = rs.ListedDraws(1025, 70, 1)  # a block of one group: some replicates draw nothing of it
    assert (last.block(1).sum(1) == 0).any() and last.sums(1, values[:1]) == pytest.approx(last.block(1).astype(float) @ values[:1])


def test_i05_lists_its_draws_and_scores_rows_once(spark, data, monkeypatch):
    """The table per stratum and group is stored: nothing after it plans the scores again."""
    plans, draws = [], []
    monkeypatch.setattr(resampling.rs, "paired_bootstrap", lambda dl, *a, real=rs.paired_bootstrap, **kw: (plans.append(dl), draws.append(kw["draws_of"]), real(dl, *a, **kw))[-1])
    out = resampling.i05(spark, data)
    assert out.count() == out.select("stratum").distinct().count() > 8
    assert draws == [rs.ListedDraws] and "Join" not in plans[0]._jdf.queryExecution().optimizedPlan().toString()
    for r in out.where("status = 'PASS'").collect():
        assert r.ci_low <= r.point <= r.ci_high


def test_draws_are_not_broadcast(spark):
    """A row per replicate and drawn group goes to the groups by a shuffle, however few rows Spark expects."""
    index = rs.group_index(spark.range(5000).withColumnRenamed("id", "g"), [], "g")
    m = rs.multiplicities(index, [], "g", 8)
    assert m.agg(F.sum("m")).first()[0] == 8 * 5000
    assert "SortMergeJoin [g_index" in m._jdf.queryExecution().executedPlan().toString()


def test_checksums_of_files_beyond_the_limit_of_a_row(spark, tmp_path, monkeypatch):
    """Files that may not be a row, with and without a last line end, marks, carriage returns, blanks in names and a compressed one."""
    rng = random.Random(8)
    many = bytes(rng.randrange(256) for _ in range(300_000))
    files = {"noise.bin": many, "ends.bin": many + b"\n", "mark.bin": b"\xef\xbb\xbf" + many, "only lines.bin": b"\n" * 5000, "returns.txt": b"a\r\nb\r" * 2000,
             "no_line.bin": many.replace(b"\n", b""), "mark_ends.bin": b"\xef\xbb\xbf\n" * 900, "small.bin": b"abc"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(sinks, "WHOLE_BYTES", 1000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        before = spark.conf.get("spark.sql.files.maxPartitionBytes")
        got = {r.path.rpartition("/")[2]: (r.bytes, r.sha256) for r in sinks.checksums(spark, f"{tmp_path}/*").collect()}
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}
    (tmp_path / "packed.gz").write_bytes(gzip.compress(many))
    got = {r.path.rpartition("/")[2]: r.sha256 for r in sinks.checksums(spark, f"{tmp_path}/*").collect()}
    assert got["packed.gz"] == hashlib.sha256((tmp_path / "packed.gz").read_bytes()).hexdigest() and len(got) == len(files) + 1


@pytest.mark.parametrize("most", [8, 1024])
def test_risk_coverage_of_cuts_is_that_of_all_rows(spark, monkeypatch, most):
    """Ties over many rows, nulls, NaN, both zeros and null risks; few and many cells, against the order of all rows."""
    monkeypatch.setattr(sc, "MOST_CELLS", most)
    monkeypatch.setattr(sc, "SAMPLE", 2)
    rng = random.Random(9)
    data = [(m, i, s, rng.random() if rng.random() < 0.95 else None) for m, n in (("a", 3000), ("b", 900), ("c", 110)) for i, (_, _, _, _, s, _, _) in enumerate(_rows(n, n))]
    df = spark.createDataFrame(data, "m string, id bigint, score double, kl double").repartition(3)
    shown = lambda c: sorted([tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else str(x) for x in r) for r in c.collect()], key=str)
    order = ["m", "bucket", "coverage", "n_total", "n_accepted", "risk", "threshold"]
    want = shown(cv.risk_coverage(df, ["m"], "score", "kl", "id").select(order))
    assert len(want) == 153 and shown(cv.risk_coverage_of_cuts(df, ["m"], "score", "kl", "id").select(order)) == want


def test_only_rows_near_a_cut_are_ordered(spark, monkeypatch):
    df = spark.range(0, 40000, 1, 4).select(F.lit("a").alias("m"), "id", F.rand(3).alias("score"), F.rand(4).alias("kl"))
    ordered = []
    monkeypatch.setattr(sc, "ordered_prefix", lambda rows, *a, real=sc.ordered_prefix: (ordered.append(rows.count()), real(rows, *a))[-1])
    assert cv.risk_coverage_of_cuts(df, ["m"], "score", "kl", "id").count() == 51
    assert 0 < ordered[0] < 12000  # 51 of some 600 cells, uneven as the sample is small
