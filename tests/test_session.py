from parchmill.session import cut, spread


def test_spread_keeps_rows_and_uses_the_cores(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(df).count() == 100
    many = spark.range(0, 100, 1, 64)
    assert spread(many).rdd.getNumPartitions() == 64
    assert spread(df.distinct(), df).count() == 100


def test_cut_ends_the_lineage(spark):
    df = cut(spark.range(10).selectExpr("id * 2 as x"))
    assert "ExistingRDD" in df._jdf.queryExecution().toString() and df.count() == 10


def test_measured_and_lookups(spark):
    from parchmill.operators import vectors
    from parchmill.plans.metrics import measured

    df, m = measured(spark.range(7), "seven")
    df.write.format("noop").mode("overwrite").save()
    assert m.rows == 7 and m.seconds > 0
    index = spark.createDataFrame([(1, 0, [1.0]), (1, 1, None)], "doc_id long, chunk_id int, embedding array<double>")
    assert vectors.chunk_by_id(index, 1, 1).count() == 1 and vectors.chunk_by_id(index, 2, 0).count() == 0
    assert vectors.total_chunks(index) == 1 and vectors.total_chunks(None) == 0


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from parchmill.session import on_one_machine

    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    session = SimpleNamespace(sparkContext=sc)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut(SimpleNamespace(sparkSession=session))
    df = SimpleNamespace(sparkSession=session)
    assert spread(df) is df
    for master, one in (("local", True), ("local[8]", True), ("local-cluster[3,2,3000]", False), ("yarn", False)):
        assert on_one_machine(SimpleNamespace(sparkContext=SimpleNamespace(master=master))) is one
