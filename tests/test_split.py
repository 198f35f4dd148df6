"""Reproducible, disjoint, complete."""
from geolex.operators import split


def test_r7_disjoint_complete_reproducible(spark):
    df = spark.range(20000).withColumnRenamed("id", "k")
    a = split.hash_split(df, ["k"])
    b = split.hash_split(df.repartition(13), ["k"])
    assert sorted(a.collect()) == sorted(b.collect())
    c = split.split_counts(a).first()
    assert c.total == 20000 and c.train + c.test == 20000
    assert 0.68 < c.train / c.total < 0.72


def test_r8_three_way(spark):
    df = split.hash_split3(spark.range(20000).withColumnRenamed("id", "k"), ["k"])
    counts = {r.split_label: r["count"] for r in df.groupBy("split_label").count().collect()}
    assert set(counts) == {0, 1, 2}
    assert 0.68 < counts[0] / 20000 < 0.72 and 0.18 < counts[1] / 20000 < 0.22
