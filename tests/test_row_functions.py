"""Closed-form values of the row functions."""

import math

import pytest
from pyspark.sql import functions as F

from plurality import functions as fn

VOTES = [  # votes, majority, tied, disagreement
    ((3, 3, 0, 0, 0, 0), -1, True, 1 - 12 / 30),
    ((0, 4, 1, 0, 0, 0), 1, False, 0.4),
    ((1, 1, 1, 1, 1, 1), -1, True, 1.0),
    ((2, 1, 0, 0, 0, 0), 0, False, 2 / 3),
    ((1, 0, 0, 0, 0, 0), 0, False, None),
    ((4, 0, 0, 0, 0, 0), 0, False, 0.0),
]


def frame(spark, rows, prefix):
    return spark.createDataFrame([tuple(r) for r in rows], [f"{prefix}{k}" for k in range(6)])


def test_majority_and_disagreement(spark):
    df = frame(spark, [v for v, *_ in VOTES], "v").coalesce(1)
    got = df.select(fn.unique_majority(fn.cols("v")).alias("y"), fn.disagreement(fn.cols("v")).alias("d")).collect()
    for row, (_, y, tied, d) in zip(got, VOTES):
        assert row.y == y and (row.y < 0) == tied
        assert row.d is None if d is None else row.d == pytest.approx(d)


def test_uniform_prediction_divergence(spark):
    df = frame(spark, [(2.0, 1.0, 1.0, 0.0, 0.0, 0.0)], "v")
    df = df.withColumns({f"q{k}": q for k, q in enumerate(fn.soft_targets(fn.cols("v")))})
    uniform = fn.clip_renorm([F.lit(1 / 6)] * 6)
    row = df.select(fn.kl(fn.cols("q"), uniform).alias("kl"), fn.entropy(fn.cols("q")).alias("h"),
                    fn.cross_entropy(fn.cols("q"), uniform).alias("ce")).first()
    assert row.kl == pytest.approx(math.log(6) - row.h)
    assert row.ce == pytest.approx(math.log(6))


def test_js_distance_bounds(spark):
    df = frame(spark, [(1.0, 0, 0, 0, 0, 0)], "a").withColumns({f"b{k}": F.lit(float(k == 3)) for k in range(6)})
    a, b = fn.clip_renorm([F.col(f"a{k}").cast("double") for k in range(6)]), fn.clip_renorm(fn.cols("b"))
    row = df.select(fn.js_distance(a, b).alias("far"), fn.js_distance(a, a).alias("near")).first()
    assert row.far == pytest.approx(math.sqrt(math.log(2)), abs=1e-3) and row.near == pytest.approx(0.0, abs=1e-9)


def test_temperature_one_changes_nothing(spark):
    df = frame(spark, [(0.5, 0.2, 0.1, 0.1, 0.05, 0.05)], "c")
    row = df.select(*[x.alias(f"t{k}") for k, x in enumerate(fn.temper(fn.cols("c"), 1.0))]).first()
    assert list(row) == pytest.approx([0.5, 0.2, 0.1, 0.1, 0.05, 0.05])


def test_bits_round_trip(spark):
    df = spark.createDataFrame([([i % 3 == 0 for i in range(16)],)], "m array<boolean>")
    row = df.select(fn.pack_bits(F.col("m"), 16).alias("p"), fn.unpack_bits(fn.pack_bits(F.col("m"), 16), 16).alias("u"), "m").first()
    assert row.u == row.m and row.p == [sum(1 << i for i in range(8) if i % 3 == 0), sum(1 << (i - 8) for i in range(8, 16) if i % 3 == 0)]


def test_inverse_normal(spark):
    row = spark.range(1).select(fn.inverse_normal(F.lit(0.975)).alias("a"), fn.inverse_normal(F.lit(0.8)).alias("b"), fn.inverse_normal(F.lit(0.01)).alias("c")).first()
    assert (row.a, row.b, row.c) == pytest.approx((1.959963985, 0.841621234, -2.326347874), abs=1e-7)


def test_gate_routing(spark):
    df = spark.createDataFrame([(0.3, 1.0, 1.0), (0.3, 0.0, 1.0), (0.3, 1.0, 0.0)], "g double, l double, x double").coalesce(1)
    got = [r[0] for r in df.select(fn.routed_gate(F.col("g"), F.col("l"), F.col("x"))).collect()]
    assert got == [0.3, 1.0, 0.0]
