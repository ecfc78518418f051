"""Lookup sinks, gapped patterns, the problem dimension and greedy diverse recommendations."""
import collections
import glob
import itertools
import random

import pyarrow.parquet as pq
import pytest

from risegraph.operators import paths as G
from risegraph.operators import recommend as R
from risegraph.params import Params
from risegraph.sources import adapters as A
from risegraph.sources.ingest import read_keys, write_lookup

from .conftest import subs


def row_groups(path, key, value):
    """(row groups, those whose minimum and maximum admit the value, those with a Bloom filter)."""
    total = hit = 0
    for f in sorted(glob.glob(f"{path}/*.parquet")):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().get_field_index(key)
        for i in range(meta.num_row_groups):
            s = meta.row_group(i).column(at).statistics
            total += 1
            hit += s.min <= value <= s.max
    return total, hit


def rows_scanned(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.finalPhysicalPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


@pytest.mark.parametrize("by_range", [True, False])
def test_a_handle_reads_few_row_groups(spark, tmp_path, by_range):
    rnd = random.Random(1)
    handles = [f"user{i:05d}" for i in range(4000)]
    rows = [(h, t, rnd.random()) for h in handles for t in range(5)] + [("hot", t, 0.5) for t in range(9000)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "handle string, time long, x double")
    df = df.repartition(4) if by_range else df.repartition(4, "handle")
    path = str(tmp_path / "lookup")
    write_lookup(df, path, "handle", ("time",), by_range, row_group_bytes=16 << 10, expected_keys=2000)
    total, hit = row_groups(path, "handle", "user01234")
    assert total >= 12 and hit <= (2 if by_range else 5)
    found = read_keys(spark, path, ["user01234"])
    assert sorted(r.time for r in found.collect()) == list(range(5))
    assert "EqualTo(handle,user01234)" in found._jdf.queryExecution().toString() or "In(handle" in found._jdf.queryExecution().toString()
    # a Bloom filter rules out what minima and maxima admit
    assert rows_scanned(found) <= 2 * len(rows) / total * 1.5
    assert rows_scanned(read_keys(spark, path, ["user01234x"])) <= rows_scanned(found)
    assert spark.read.parquet(path).count() == len(rows)


def brute_patterns(histories, gap, longest, least):
    users = collections.defaultdict(set)
    for h, items in histories.items():
        def grow(pattern, at):
            users[pattern].add(h)
            if len(pattern) < longest:
                for j in range(at + 1, min(at + gap, len(items) - 1) + 1):
                    grow((*pattern, items[j]), j)
        for i in range(len(items)):
            grow((items[i],), i)
    n = {p: len(u) for p, u in users.items()}
    return {">".join(p): (len(p), c, n[p[:-1]], c / n[p[:-1]]) for p, c in n.items() if len(p) > 1 and c >= least}


@pytest.mark.parametrize("gap,longest", [(1, 3), (3, 4), (5, 2)])
@pytest.mark.parametrize("hot", [None, 5])
def test_gapped_patterns(spark, gap, longest, hot):
    rnd = random.Random(gap)
    rows, histories = [], collections.defaultdict(list)
    for u in range(12):
        for t in range(rnd.randint(0, 25)):
            pid, verdict = rnd.choice("ABCDE"), rnd.choice(["OK", "OK", "WA", None])
            rows.append((f"u{u}", t, 1500.0, pid, 1000.0, verdict))
            if verdict == "OK":
                histories[f"u{u}"].append(pid)
    params = Params(transition_window=gap, pattern_max_len=longest, pattern_min_support=3, hot_user_rows=hot, segment_rows=60,
                    index_partition_rows=40)
    frame = subs(spark, rows)
    if hot:
        from risegraph.functions.segments import index_hot_users, with_halo
        frame = with_halo(index_hot_users(frame, params), params, 5, 5)
    got = {r.pattern: (r.length, r.support, r.prefix_support, r.confidence) for r in G.gapped_patterns(frame, params).collect()}
    assert got == brute_patterns(histories, gap, longest, 3) and got


def test_patterns_of_nothing(spark):
    assert G.gapped_patterns(subs(spark, [])).collect() == []


DIM = "id_of_submission_task string, title string, tags string"


def test_problem_dimension(spark):
    parts = spark.createDataFrame([(1, "red bolt", "SMALL"), (11, "blue bolt", "ECONOMY"), (21, "red ring", "SMALL"), (2, None, None)],
                                  "p_partkey long, p_name string, p_type string")
    got = {r[0]: (r.title, r.tags) for r in A.problem_dimension(parts, (A.F.col("p_partkey") % 10).cast("string")).collect()}
    assert got == {"1": ("red bolt", "bolt, red, small"), "2": (None, None)}


def catalog(spark, rows):
    return spark.createDataFrame(rows, "id_of_submission_task string, estimated_difficulty double, att_score double, "
                                       "att_probability_uplift double, final_score double")


def greedy(cands, k, cap):
    used, out = collections.Counter(), []
    for pid, tags, _ in sorted(cands, key=lambda c: (c[2] is None, -(c[2] or 0), c[0])):
        if len(out) < k and all(used[t] < cap for t in tags):
            out.append(pid)
            used.update(tags)
    return out


def test_diverse_recommendations_are_greedy_over_all_tags(spark):
    rnd = random.Random(2)
    rows, dim = [], []
    for i in range(60):
        pid = f"p{i:02d}"
        rows.append((pid, float(rnd.randint(900, 2400)), rnd.random(), 0.5, rnd.choice([None, 1.0, 2.0, rnd.random()])))
        if i % 7:
            dim.append((pid, f"t{i}", ", ".join(rnd.sample("abcdefg", rnd.randint(0, 3)) * (1 + i % 2))))
    tags = {p: sorted({x for x in t.split(", ") if x}) for p, _, t in dim}
    profiles = spark.createDataFrame([(f"u{i}", r) for i, r in enumerate([1000, 1500, 1500, 1900, 3900])], "handle string, current_rating int")
    params = Params(max_per_tag=2, top_k=5)
    got = collections.defaultdict(list)
    out = R.recommend_diverse(profiles, catalog(spark, rows), params, spark.createDataFrame(dim, DIM))
    for r in sorted(out.collect(), key=lambda r: (r.handle, r.rec_rank or 0)):
        got[r.handle].append(r.problem_id)
        assert (r.status == "no_match") == (r.problem_id is None)
    for handle, rating in profiles.collect():
        cands = []
        for pid, d, _, _, s in rows:
            if rating - 200 <= d <= rating + 400:
                tier = "easy" if d <= 1400 else "medium" if d <= 1700 else "hard"
                cands.append((pid, tags.get(pid) or [tier], s))
        assert got[handle] == (greedy(cands, 5, 2) or [None])


def test_tag_index(spark):
    cat = catalog(spark, [("a", 1000.0, 10.0, 0.1, 1.0), ("b", 1000.0, 20.0, 0.1, 3.0)])
    dim = spark.createDataFrame([("a", "A", "x, y"), ("b", "B", "x, x"), ("c", "C", "y"), ("d", "D", None), ("e", "E", "")], DIM)
    got = {r.tag: tuple(r)[1:] for r in R.tag_index(dim, cat).collect()}
    assert got == {"x": (2, 2, 15.0, ["b", "a"]), "y": (2, 1, 10.0, ["a"])}


def test_more_than_one_pick_per_key(spark):
    # ties by id, and a cap that leaves fewer than k
    rows = [(f"p{i}", 1500.0, 1.0, 0.1, 1.0) for i in range(6)]
    dim = spark.createDataFrame([(f"p{i}", "t", "x") for i in range(6)], DIM)
    profiles = spark.createDataFrame([("u", 1500)], "handle string, current_rating int")
    got = R.recommend_diverse(profiles, catalog(spark, rows), Params(max_per_tag=2), dim).collect()
    assert [r.problem_id for r in sorted(got, key=lambda r: r.rec_rank)] == ["p0", "p1"]
    assert list(itertools.chain(*[r.tags.split(",") for r in got])) == ["x", "x"]
