from pathlib import Path

from sparkloom import store


def test_written_table_reads_back_and_drops(spark):
    df = store.written(spark.range(10), "t")
    assert df.count() == 10
    store.drop(df)
    store.written(spark.range(3), "t")
    store.clear(spark)
    assert not [p for p in Path(store.shared_dir(spark)).glob("t-*")]


def test_shared_dir_follows_the_setting(spark):
    assert store.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_spread_leaves_wide_tables_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert store.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == cores
    wide = spark.range(100, numPartitions=cores + 1)
    assert store.spread(wide) is wide
    assert sorted(r.id for r in store.spread(spark.range(5, numPartitions=1)).collect()) == [0, 1, 2, 3, 4]
