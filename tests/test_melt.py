from plumbline.sources import melt


def test_a_table_of_one_row_group_is_dealt_to_all_cores(spark, tmp_path, monkeypatch):
    spark.range(1000).coalesce(1).write.parquet(f"file://{tmp_path}/t")
    df = spark.read.parquet(f"file://{tmp_path}/t")
    assert melt.spread(df) is df  # small enough for one task
    monkeypatch.setattr(melt, "SMALLEST", 0)
    dealt = melt.spread(df)
    assert dealt.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in dealt.collect()) == list(range(1000))


def test_a_table_that_fills_the_cores_is_not_shuffled(spark, tmp_path, monkeypatch):
    spark.range(1000).write.parquet(f"file://{tmp_path}/t")
    monkeypatch.setattr(melt, "SMALLEST", 0)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16b")
    try:
        df = spark.read.parquet(f"file://{tmp_path}/t")
        assert melt.spread(df) is df
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
