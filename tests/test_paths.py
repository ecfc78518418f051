from pyspark.sql import functions as F

from risegraph.operators import paths as G
from risegraph.params import Params

from .conftest import subs


def test_repeat_solve_self_loop_and_probabilities(spark):
    rows = []
    for u in range(12):
        for t, p in enumerate(["A", "A", "B", "A", "C"]):
            rows.append((f"u{u}", t, 1500.0, p, 1000.0, "OK"))
    g = G.transition_graph(subs(spark, rows), Params(min_transition_count=10))
    edges = {(r.source_problem, r.target_problem): r for r in g.collect()}
    assert ("A", "A") in edges and edges[("A", "A")].transition_count == 12 * 3
    sums = g.groupBy("source_problem").agg(F.sum("transition_probability").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-12 for r in sums)


def test_paths_exclude_equal_time_solves(spark):
    # improvement point at time 40; a solve at the same time must not count
    rows = [("u", t, 1500.0 + (10 * t if t <= 40 else 400), "S" if t % 5 == 0 else "F", 1000.0,
             "OK" if t % 5 == 0 else "WA") for t in range(41)]
    rows.append(("u", 40, 1900.0, "SAME", 1000.0, "OK"))
    pts = G.preceding_solves(subs(spark, rows), Params(order_by=("time", "id_of_submission_task")))
    got = pts.filter("point_time = 40").collect()
    # two improvement points share time 40; each sees only the solves at 35, 30, 25
    assert [r.id_of_submission_task for r in got] == ["S"] * 6
    assert all(r.id_of_submission_task != "SAME" for r in pts.collect())


def test_path_support_brute_force(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for u in range(6):
        r = 1500
        for t in range(80):
            r += rnd.choice([-10, 0, 15, 25])
            rows.append((f"u{u}", t, float(r), rnd.choice("ABCD"), 1000.0, rnd.choice(["OK", "WA"])))
    p = Params(path_min_support=1)
    got = {r.id_of_submission_task: r.support for r in G.path_support(subs(spark, rows), p).collect()}
    exp = {}
    for u in range(6):
        hist = [x for x in rows if x[0] == f"u{u}"]
        for i, x in enumerate(hist):
            if i < 20:
                continue
            if hist[i][2] - hist[i - 20][2] >= 100:
                prev = [h for h in hist if h[1] < x[1] and h[5] == "OK"][-3:]
                for h in prev:
                    exp[h[3]] = exp.get(h[3], 0) + 1
    assert got == exp
