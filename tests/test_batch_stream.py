import os
import tempfile

from pyspark.sql import functions as F

from risegraph.params import SMALL
from risegraph.plans.analysis import Analysis
from risegraph.plans.batch import catalog_from_artifacts, load_artifacts, run_batch
from risegraph.sources.adapters import load_events_submissions
from risegraph.streaming import incremental_ingest

SF = "/root/testdata/sf0.001"


def test_batch_writes_and_reloads(spark):
    out = tempfile.mkdtemp(prefix="risegraph-batch-")
    subs = load_events_submissions(spark, SF)
    params = SMALL.with_(min_samples=2, min_treated_prefilter=2)
    paths = run_batch(spark, subs, out, params, feature_buckets=4)
    assert os.path.isdir(paths["user_features"])
    arts = load_artifacts(spark, out)
    direct = Analysis(load_events_submissions(spark, SF), params)
    assert arts["user_features"].count() == direct.features.count()
    assert sorted(arts["causal_att_effects"].collect()) == sorted(direct.att_significant.collect())
    # optional artefacts may be missing: hazard defaults to 1.0
    arts["survival_effects"] = None
    cat = catalog_from_artifacts(arts)
    assert cat.filter(F.col("hazard_ratio") != 1.0).count() == 0
    assert spark.read.parquet(paths["recommendations"]).count() >= direct.profiles.count()


def test_batch_stages_read_the_written_features(spark, monkeypatch):
    from risegraph.plans import batch
    made = []
    monkeypatch.setattr(batch, "Analysis", lambda *a, **k: made.append(Analysis(*a, **k)) or made[-1])
    for params in (SMALL, SMALL.with_(hot_user_rows=40, segment_rows=45, index_partition_rows=70)):
        out = tempfile.mkdtemp(prefix="risegraph-batch-")
        run_batch(spark, load_events_submissions(spark, SF), out, params, recommendations=False)
        a = made.pop()
        files = a.features_seq.inputFiles()
        assert files and all("/user_features" in f for f in files)
        for frame in (a.cem, a.survival_rows, a.improvement_points, a.outcomes):
            assert all("/user_features" in f for f in frame.inputFiles())


def test_a_damaged_artefact_is_an_error(spark):
    import pytest
    out = tempfile.mkdtemp(prefix="risegraph-batch-")
    for name in ("causal_att_effects", "problem_metadata"):
        spark.range(1).write.parquet(f"{out}/{name}")
    assert load_artifacts(spark, out)["survival_effects"] is None
    os.mkdir(f"{out}/survival_effects")
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        load_artifacts(spark, out)


def test_incremental_ingest_skips_seen_files(spark):
    root = tempfile.mkdtemp(prefix="risegraph-stream-")
    src, tgt, ckpt = f"{root}/src", f"{root}/tgt", f"{root}/ckpt"
    subs = load_events_submissions(spark, SF)
    first, second = subs.filter("time % 2 = 0"), subs.filter("time % 2 = 1")
    first.coalesce(2).write.json(f"{src}/part1")
    incremental_ingest(spark, f"{src}/*", tgt, ckpt)
    n1 = spark.read.parquet(tgt).count()
    assert n1 == first.count()
    incremental_ingest(spark, f"{src}/*", tgt, ckpt)  # nothing new: no duplicates
    assert spark.read.parquet(tgt).count() == n1
    second.coalesce(2).write.json(f"{src}/part2")
    incremental_ingest(spark, f"{src}/*", tgt, ckpt)
    assert spark.read.parquet(tgt).count() == subs.count()


def test_ingest_json_skips_existing_target(spark):
    from risegraph.sources.ingest import clean_submissions, ingest, profile
    from risegraph.schema import SUBMISSIONS
    root = tempfile.mkdtemp(prefix="risegraph-ingest-")
    subs = load_events_submissions(spark, SF)
    subs.write.json(f"{root}/raw")
    out = ingest(spark, f"{root}/raw", f"{root}/pq", "json", schema=SUBMISSIONS)
    assert out.count() == subs.count()
    # an existing target is left alone (the reference's skip-if-present)
    subs.limit(5).write.mode("overwrite").json(f"{root}/raw")
    assert ingest(spark, f"{root}/raw", f"{root}/pq", "json", schema=SUBMISSIONS).count() == subs.count()
    prof = {r.column_name: r for r in profile(clean_submissions(out)).collect()}
    assert prof["problem_rating"].null_count == subs.filter("problem_rating IS NULL").count()
    assert prof["handle"].n_rows == subs.count()
