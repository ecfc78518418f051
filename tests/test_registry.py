import __spark_entry__ as E


def test_every_query_has_an_oracle():
    from risegraph.plans.registry import queries
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    missing = set(queries()) - set(s)
    assert not missing, missing


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and all(r["p_value"] is None or 0 <= r["p_value"] <= 1 for r in rows)


def test_partition_count_invariance(spark):
    q = E.queries()["att_significance"]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(q(spark, "/root/testdata/sf0.001").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = sorted(q(spark, "/root/testdata/sf0.001").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b
