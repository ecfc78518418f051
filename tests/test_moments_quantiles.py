"""Merged and subtracted moments, rank-selected quantiles, Student's t: against direct computation."""
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from risegraph.functions.moments import merged, moments, var_samp, without
from risegraph.functions.numeric import student_two_sided_p
from risegraph.functions.quantiles import rank_quantiles
from risegraph.operators import matching as C
from risegraph.operators import survival as S
from risegraph.params import Params


def test_moments_survive_an_offset(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("ab"), rnd.choice([1, 2, None]), 1e9 + rnd.randint(0, 40) / 4) for _ in range(600)]
    df = spark.createDataFrame(rows, "part string, cell int, x double")
    parts = df.groupBy("part", "cell").agg(*moments(F.col("x"), "x"))
    whole = {r.cell: r for r in merged(parts, ["cell"], ["x"]).collect()}
    for cell in (1, 2, None):
        xs = [x - 1e9 for _, c, x in rows if c == cell]
        assert whole[cell].x_n == len(xs)
        assert whole[cell].x_mean - 1e9 == pytest.approx(statistics.fmean(xs), abs=1e-6)
        assert whole[cell].x_m2 / (len(xs) - 1) == pytest.approx(statistics.variance(xs), rel=1e-6)
    total = merged(parts, ["cell"], ["x"]).withColumnsRenamed({"x_n": "n", "x_mean": "m", "x_m2": "q"})
    own = parts.filter("part = 'a' AND cell = 1").join(total, "cell")
    n, m, q = without(tuple(F.col(c) for c in ("n", "m", "q")), tuple(F.col(f"x_{c}") for c in ("n", "mean", "m2")))
    got = own.select(n.alias("n"), m.alias("m"), var_samp(n, q).alias("v")).first()
    xs = [x - 1e9 for p, c, x in rows if c == 1 and p == "b"]
    assert got.n == len(xs) and got.m - 1e9 == pytest.approx(statistics.fmean(xs), abs=1e-6)
    assert got.v == pytest.approx(statistics.variance(xs), rel=1e-5)


def test_without_everything_is_null(spark):
    cols = tuple(F.lit(float(x)) for x in (5, 2, 3))
    got = spark.range(1).select(*[c.alias(k) for k, c in zip("nmq", without(cols, cols))]).first()
    assert got.n == 0 and got.m is None and got.q is None


COLUMNS = ("handle string, time long, id_of_submission_task string, verdict string, rating_at_submission double, bin_rating int, "
           "bin_acc int, bin_diff int, rating_gain_20 double, improved_20 int, roll_acc_20 double, roll_ok_diff_20 double")


def cohort(offset):
    rnd = random.Random(9)
    return [(f"u{i % 11}", i, rnd.choice("ABC"), rnd.choice(["OK", "WA", None]), offset + rnd.randint(0, 40), rnd.choice([15, 16]), 5, 7,
             float(rnd.randint(-40, 60)), rnd.randint(0, 1), rnd.random(), 1400 + 10 * rnd.random()) for i in range(500)]


def test_balance_is_the_same_far_from_zero(spark):
    params = Params(min_samples=3, min_treated_prefilter=3)
    found = []
    for offset in (0.0, 1e9):
        cem = spark.createDataFrame(cohort(offset), COLUMNS)
        effects = C.cem_effects(C.cem_cells(cem, params), params)
        found.append({(r[0], r.covariate): r.smd for r in C.balance_check(cem, effects, params).collect()})
    assert len(found[0]) == 9
    for key, smd in found[0].items():
        assert found[1][key] == pytest.approx(smd, abs=1e-5)


def test_solvers_against_their_rows(spark):
    params = Params(min_samples=3, min_treated_prefilter=3)
    rows = cohort(1500.0)
    got = {r[0]: r for r in C.att_effects_solvers(spark.createDataFrame(rows, COLUMNS), params).collect()}
    for pid in "ABC":
        cells = []
        for b in (15, 16):
            t = [r[8] for r in rows if r[5] == b and r[2] == pid and r[3] == "OK"]
            c = [r[8] for r in rows if r[5] == b and not (r[2] == pid and r[3] == "OK")]
            cells.append((len(t), statistics.fmean(t) - statistics.fmean(c),
                          statistics.variance(t) / len(t) + statistics.variance(c) / len(c)))
        n = sum(x[0] for x in cells)
        assert got[pid].att_score == pytest.approx(sum(x[0] / n * x[1] for x in cells), abs=1e-9)
        assert got[pid].att_variance == pytest.approx(sum((x[0] / n) ** 2 * x[2] for x in cells), rel=1e-9)


def quantile(xs, p):
    xs = sorted(xs)
    h = p * (len(xs) - 1)
    low = math.floor(h)
    return xs[low] + (h - low) * (xs[math.ceil(h)] - xs[low])


@pytest.mark.parametrize("width", [1, 7, 1024])
def test_rank_quantiles(spark, width):
    rnd = random.Random(width)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([None, float("nan"), *[float(rnd.randint(-50, 400)) for _ in range(9)]])) for _ in range(400)]
    rows += [("one", 5.0), ("none", None)] + [("same", 3.0)] * 9
    counts = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").count()
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r for r in rank_quantiles(counts, ["k"], "v", "count", probs, width).collect()}
    assert set(got) == {"a", "b", None, "one", "same"}
    for k, r in got.items():
        xs = [v for g, v in rows if g == k and v is not None and v == v]
        assert r.total == len(xs) and r.q == pytest.approx([quantile(xs, p) for p in probs], abs=1e-9)


def test_rank_quantiles_plan_holds_no_value_map(spark):
    pairs = spark.createDataFrame([("u", "P", 1, 1)], "handle string, id_of_submission_task string, time_to_event long, event_observed int")
    plan = S.time_quantiles(pairs)._jdf.queryExecution().toString()
    assert "percentile" not in plan and "median(" not in plan and "collect_" not in plan


def test_student_tail(spark):
    def direct(t, df):  # the density integrated by Simpson's rule in theta, t = sqrt(df) tan(theta)
        if df > 500:
            return None
        def area(a, b, n=20000):
            h = (b - a) / n
            f = [max(math.cos(a + i * h), 0.0) ** (df - 1) for i in range(n + 1)]
            return h / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))
        return area(math.atan(t / math.sqrt(df)), math.pi / 2) / area(0, math.pi / 2)
    rows = [(t, float(df)) for t in (0.0, 0.3, 1.0, 2.2, 2.6, 3.3, 7.0) for df in (2, 3, 8, 41, 300)]
    got = spark.createDataFrame(rows, "t double, df double").withColumn("p", student_two_sided_p("t", "df")).collect()
    for r in got:
        assert r.p == pytest.approx(direct(r.t, r.df), abs=1e-9)
    # closed forms: df 1 is Cauchy's, many degrees are the normal's
    edge = spark.createDataFrame([(6.0, 1.0), (0.5, 1.0), (2.0, 1e9), (float("inf"), 4.0), (float("nan"), 4.0), (1.0, 0.0), (None, 3.0),
                                  (-6.0, 1.0)], "t double, df double").withColumn("p", student_two_sided_p("t", "df")).collect()
    p = [r.p for r in edge]
    assert p[0] == pytest.approx(1 - 2 / math.pi * math.atan(6), abs=1e-12) and p[7] == p[0]
    assert p[1] == pytest.approx(1 - 2 / math.pi * math.atan(0.5), abs=1e-12)
    assert p[2] == pytest.approx(math.erfc(2 / math.sqrt(2)), abs=1e-8) and p[3] == 0.0 and p[4:7] == [None] * 3


def test_student_tail_equals_a_duckdb_series(spark):
    duckdb = pytest.importorskip("duckdb")
    from oracle.sql import t_p_of
    rows = [(t, df) for t in (0.4, 1.1, 2.4, 2.7, 4.0, 9.0) for df in (1.0, 2.5, 17.0, 220.0, 3000.0)]
    con = duckdb.connect()
    con.execute("CREATE TABLE x (t DOUBLE, df DOUBLE)")
    con.executemany("INSERT INTO x VALUES (?, ?)", rows)
    expected = dict(((t, df), p) for t, df, p in con.execute(f"SELECT t, df, {t_p_of('t', 'df')} FROM x").fetchall())
    for r in spark.createDataFrame(rows, "t double, df double").withColumn("p", student_two_sided_p("t", "df")).collect():
        assert r.p == pytest.approx(expected[(r.t, r.df)], abs=1e-9)
