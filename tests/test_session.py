"""Session helpers: spread (few-split scans), materialize (lineage cut)."""
from geolex.session import TEXT_PARTITIONS, ensure_checkpoint_dir, materialize, remove_cuts, spread


def test_spread_does_what_the_session_sets(spark):
    df = spark.range(1000).coalesce(1)
    assert spread(df) is df
    spark.conf.set(TEXT_PARTITIONS, "5")
    try:
        assert spread(df).rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset(TEXT_PARTITIONS)


def test_remove_cuts_deletes_the_tables(spark):
    import os
    kept = materialize(spark.range(3), "gone")
    path = kept.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path) and remove_cuts(spark) >= 1 and not os.path.exists(path)


def test_materialize_cuts_lineage_into_checkpoint_folder(spark):
    base = ensure_checkpoint_dir(spark)
    df = spark.range(100).selectExpr("id", "id % 7 AS k").groupBy("k").count()
    cut = materialize(df, "unit")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "FileScan parquet" in plan
    assert base.rstrip("/").split(":")[-1] in plan
    assert sorted(cut.collect()) == sorted(df.collect())


def test_cluster_conf_sizes_partitions():
    from geolex.session import cluster_conf
    c = cluster_conf(shuffle_bytes=10 << 30, cores=16)
    assert c["spark.sql.shuffle.partitions"] == "48"          # 40 by size, 48 by cores
    assert cluster_conf(1 << 40, 16)["spark.sql.shuffle.partitions"] == "4096"
