import math

import pytest
from pyspark.sql import functions as F

from risegraph.functions.numeric import (clip_keep_null, erfc, normal_two_sided_p, round_half,
                                         safe_div, state_bin, z_score)


def test_erfc_matches_math(spark):
    xs = [i / 50 for i in range(0, 400)] + [7.5, 10.0, 26.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = {r.x: r.e for r in df.select("x", erfc("x").alias("e")).collect()}
    for x in xs:
        assert abs(got[x] - math.erfc(x)) < 5e-15, x


def test_two_sided_p(spark):
    zs = [0.0, 0.5, -1.96, 2.5758293035489004, 6.0, -9.0, float("inf"), None, float("nan")]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r.p for r in df.select(normal_two_sided_p("z").alias("p")).collect()]
    for z, p in zip(zs, got):
        if z is None or (isinstance(z, float) and math.isnan(z)):
            assert p is None
        else:
            assert p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-15)
    assert got[3] == pytest.approx(0.01, rel=1e-12)


def test_z_score_zero_std_err(spark):
    df = spark.createDataFrame([(5.0, 0.0), (-5.0, 0.0), (0.0, 0.0), (3.0, 1.5)], "a double, s double")
    got = [r.z for r in df.select(z_score("a", "s").alias("z")).collect()]
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] is None and got[3] == 2.0


def test_clip_keeps_null_and_safe_div(spark):
    df = spark.createDataFrame([(None, 0.0), (500.0, 2.0), (5000.0, 0.0), (1200.0, 4.0)], "d double, b double")
    r = df.select(clip_keep_null("d", 800, 4000).alias("c"), safe_div("d", "b").alias("q")).collect()
    assert [x.c for x in r] == [None, 800.0, 4000.0, 1200.0]
    assert [x.q for x in r] == [None, 250.0, None, 300.0]


def test_half_bins_tie_modes(spark):
    # ratings ending in 50 and accuracies k/20 with odd k are exact ties
    df = spark.createDataFrame([(1450.0, 7 / 20), (1550.0, 13 / 20), (-250.0, 0.05)], "r double, a double")
    up = df.select(state_bin(F.col("r") / 100).alias("br"), state_bin(F.col("a") * 10).alias("ba")).collect()
    assert [(x.br, x.ba) for x in up] == [(15, 4), (16, 7), (-3, 1)]
    ev = df.select(state_bin(F.col("r") / 100, "even").alias("br")).collect()
    assert [x.br for x in ev] == [14, 16, -2]
    with pytest.raises(ValueError):
        round_half(F.col("r"), "sideways")


def test_state_bin_nan_inf_to_zero(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (610.0,)], "x double")
    got = [r.b for r in df.select(state_bin(F.col("x") / 200).alias("b")).collect()]
    assert got == [0, 0, None, 3]
