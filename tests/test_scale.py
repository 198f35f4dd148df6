"""What a task holds stays in proportion to TASK_BYTES, and words counted by document are not exchanged."""
from pyspark.sql import functions as F

from geolex import session
from geolex.operators import profiles, wordmodel
from geolex.plans import jobs, standins
from tests.conftest import SF001
from tests.test_plans import plan_of


def test_tasks_follow_the_stored_size(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20000).select("id", F.md5(F.col("id").cast("string")).alias("text")).coalesce(1).write.parquet(path)
    df, size = spark.read.parquet(path), sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    cores = spark.sparkContext.defaultParallelism
    assert session.tasks_for(df, 1000) == -(-size // 1000) > cores
    assert session.tasks_for(df, 1 << 30) == cores
    spark.conf.set(session.TEXT_PARTITIONS, str(cores + 3))
    try:
        assert session.tasks_for(df, 1 << 30) == cores + 3
    finally:
        spark.conf.unset(session.TEXT_PARTITIONS)


def test_posts_are_dealt_out_by_document_and_their_words_stay_there(spark, monkeypatch):
    monkeypatch.setattr(standins, "tasks_for", lambda df: 23)
    posts = standins.post_lines(spark, SF001)
    assert posts.rdd.getNumPartitions() == 23
    counts = profiles.marked_word_counts(standins.persons(spark, SF001), ["user_id", "fip"], "line_no")
    plan = plan_of(counts)
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(user_id" not in plan


def test_user_counts_are_dealt_out_by_user(spark, monkeypatch):
    monkeypatch.setattr(jobs, "tasks_for", lambda df: 19)
    marked = spark.createDataFrame([(1, "a", "x", 2, None), (1, "b", "x", 3, None), (1, "a", None, 1, 7), (2, "a", "y", 1, None),
                                    (None, "a", "y", 4, None)], "user_id long, fip string, word string, cnt long, last long")
    out = jobs.user_counts(marked)
    assert plan_of(out).count("Exchange") == 1
    assert out.rdd.getNumPartitions() == 19
    assert {tuple(r) for r in out.collect()} == {(1, "x", 5), (2, "y", 1), (None, "y", 4)}


def test_observations_are_exchanged_once_by_the_word_tested(spark):
    words = spark.createDataFrame([(f, w, 0.1 * i) for i, f in enumerate("abcde") for w in ("-x", "y", "NaN")],
                                  "fip string, word string, share double")
    targets = spark.createDataFrame([(f, .1, .2, .3, .4) for f in "abcde"], "fip string, y0 double, y1 double, y2 double, y3 double")
    obs = wordmodel.observations(words, F.broadcast(targets), (), trim=True, tasks=5)
    tested = wordmodel.tested_words(obs, 3)
    assert plan_of(tested).count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in tested.collect()} == {("x", 5), ("y", 5)}


def test_users_are_scored_in_tasks_that_follow_the_stored_counts(spark, monkeypatch):
    """The join on the word is dealt out by word and salt over ``tasks_for``, not over what AQE packs."""
    monkeypatch.setattr(jobs, "tasks_for", lambda df: 29)
    marked = spark.createDataFrame([(1, "a", "x", 2, None), (1, "a", None, 1, 7), (2, "b", "x", 1, None), (2, "b", "y", 3, None),
                                    (2, "b", None, 1, 3), (None, "b", "x", 4, None), (3, "a", "z", 1, None), (3, "a", None, 1, 0)],
                                   "user_id long, fip string, word string, cnt long, last long")
    model = spark.createDataFrame([("x", 0, 0.5), ("x", 3, None), ("y", 3, 1.0), ("unused", 1, 2.0)], "word string, level int, slope double")
    model = model.select("*", F.lit(0.0).alias("pval"), F.lit(4).cast("long").alias("count"))
    out = jobs.classify_users(marked, model)
    plan = plan_of(out)
    assert plan.count("hashpartitioning(word") >= 2 and plan.count("salt") and ", 29), REPARTITION_BY_NUM" in plan
    assert {tuple(r) for r in out.collect()} == {(1, "a", 0.5, 0.0, 0.0, 0.0, 0), (2, "b", 0.125, 0.0, 0.0, 0.75, 3), (3, "a", 0.0, 0.0, 0.0, 0.0, 0)}


def test_buckets_follow_the_stored_counts(spark, monkeypatch):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = spark.range(3)
    monkeypatch.setattr(jobs, "tasks_for", lambda df: parts + 5)
    assert jobs.buckets_for(counts) == parts + 5
    monkeypatch.setattr(jobs, "tasks_for", lambda df: 1)
    assert jobs.buckets_for(counts) == parts
    seen = []
    monkeypatch.setattr(jobs, "tasks_for", lambda df: parts + 5)
    monkeypatch.setattr(jobs.sinks, "write_bucketed", lambda df, name, path, by, buckets=None, real=jobs.sinks.write_bucketed:
                        seen.append(buckets) or real(df, name, path, by, buckets))
    assert jobs.score_bucketed(spark, SF001).count() > 0
    assert seen == [parts + 5] * 2


def test_user_shares_are_joined_in_tasks_that_follow_the_stored_counts(spark, monkeypatch):
    """F8: counts and totals are dealt out by user over ``tasks_for`` the stored counts."""
    monkeypatch.setattr(profiles, "tasks_for", lambda df: 31)
    persons = spark.createDataFrame([(1, "x y x"), (2, "x"), (1, "z"), (None, "x"), (3, "")], "user_id long, filtered_text string")
    out = profiles.profile_words(persons, "user_id", cut=True)
    assert plan_of(out).count(", 31), REPARTITION_BY_NUM") == 2
    assert {tuple(r) for r in out.collect()} == {(1, "x", 2, 0.5), (1, "y", 1, 0.25), (1, "z", 1, 0.25), (2, "x", 1, 1.0)}
