"""A1-A4, W2, R9/R10 on small hand fixtures; share and order properties."""
import pytest
from pyspark.sql import functions as F

from geolex.operators import predict, profiles, wordmodel
from geolex.sources.schemas import LEVEL_COLUMNS

LV = ", ".join(f"{c} double" for c in LEVEL_COLUMNS)


def levels(spark, fips):
    return spark.createDataFrame([(f, 10.0, 20.0, 30.0, 40.0) for f in fips], f"fips long, {LV}")


def test_a1_county_share_and_totals(spark):
    posts = spark.createDataFrame([(1, 7, "a b a"), (1, 8, "b http://x")], "fips long, user_id long, text string")
    persons = profiles.person_records(posts, levels(spark, [1]))
    words = {r.word: r.share for r in profiles.region_words(posts.withColumnRenamed("fips", "fip")).collect()}
    assert words == {"a": 0.5, "b": 0.5}
    tot = profiles.region_totals(persons, "fip").first()
    assert (tot.tweet_count, tot.url_count, tot.emoji_count) == (2, 1, 0)
    assert tot.education_level_4 == 40.0


def test_a4_person_record_fields(spark):
    posts = spark.createDataFrame([(1, 7, "The Cat 😀 http://x.y cat")], "fips long, user_id long, text string")
    r = profiles.person_records(posts, levels(spark, [1]), ["The"]).first()
    assert r.text == "Cat 😀 http://x.y cat"
    assert r.filtered_text == "cat cat"
    assert (r.url_count, r.emoji_count) == (1, 1)


def test_shares_sum_to_one_and_repartition_invariant(spark):
    rows = [(k % 5, i, " ".join(f"w{(i * j) % 11}" for j in range(1 + i % 7))) for k, i in
            enumerate(range(200))]
    df = spark.createDataFrame(rows, "fip long, user_id long, filtered_text string")
    a = profiles.profile_words(df, "fip")
    sums = a.groupBy("fip").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-12 for r in sums)
    b = profiles.profile_words(df.repartition(7, "user_id"), "fip")
    assert sorted(a.collect()) == sorted(b.collect())


def test_a3_latest_record_wins_d12(spark):
    rows = [(1, 5, 0, "a", 0, 0), (2, 5, 3, "b", 0, 0), (3, 5, 1, "c", 1, 0)]
    df = spark.createDataFrame(rows, "fip long, user_id long, line_no long, filtered_text string, url_count int, emoji_count int")
    for c in LEVEL_COLUMNS:
        df = df.withColumn(c, F.col("fip") * 1.0)
    for parts in (1, 3):
        u = profiles.profile_totals(df.repartition(parts), "user_id", "line_no", carry=["fip"]).first()
        assert u.fip == 2 and u.education_level_1 == 2.0 and u.tweet_count == 3
        assert u.avg_url_count == pytest.approx(1 / 3)


def test_r9_r10_classify_and_evaluate(spark):
    user_words = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "z", 1), (3, "z", 2)],
                                       "user_id long, word string, cnt long")
    users = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 10)], "user_id long, fip long")
    model = spark.createDataFrame([("a", 0, 0.1, 0.01, 5), ("a", 2, 0.9, 0.01, 5), ("b", 1, 0.4, 0.01, 5)],
                                  "word string, level int, slope double, pval double, count long")
    pred = predict.classify(user_words, users, wordmodel.model_wide(model))
    got = {r.user_id: r.predicted_level for r in pred.collect()}
    assert got == {1: 2, 2: 1, 3: 0}  # user 4 has no words (P12), user 3 only unknown words
    targets = spark.createDataFrame([(10, .4, .3, .2, .1)], "fip long, y0 double, y1 double, y2 double, y3 double")
    ev = predict.evaluate(pred, targets).first()
    assert [ev.pred_0, ev.pred_1, ev.pred_2, ev.pred_3] == pytest.approx([1 / 3, 1 / 3, 1 / 3, 0])
    expected = (abs(1 / 3 - .4) + abs(1 / 3 - .3) + abs(1 / 3 - .2) + abs(0 - .1)) / 4
    assert ev.error == pytest.approx(expected)
    assert predict.mean_error(predict.evaluate(pred, targets)).first().mean_error == pytest.approx(expected)


def test_x3_trimmed_duplicates_stay_separate_r2(spark):
    words = spark.createDataFrame([(1, "cat", 0.1), (1, "cat!", 0.2)], "fip long, word string, share double")
    targets = spark.createDataFrame([(1, .1, .2, .3, .4)], "fip long, y0 double, y1 double, y2 double, y3 double")
    obs = wordmodel.observations(words, targets, ["the"], trim=True)
    assert sorted(r.x for r in obs.filter("word = 'cat'").collect()) == [0.1, 0.2]
    nan = spark.createDataFrame([(1, "NaN", 0.1), (1, "...", 0.2), (1, "the", 0.3), (1, "the’", 0.3)],
                                "fip long, word string, share double")
    assert wordmodel.observations(nan, targets, ["the", "the'"], trim=True).count() == 0


def test_archives_are_added_one_by_one(spark, tmp_path):
    from geolex.operators import archives
    rows = [(1, "a b a", 1, 0), (1, "b", 0, 2), (2, "c", 0, 0), (2, "", 1, 1)]
    people = spark.createDataFrame(rows, "fip long, filtered_text string, url_count int, emoji_count int")
    path = str(tmp_path / "store")
    archives.add_archive(people.limit(0), "2012", path)
    archives.add_archive(people.filter("fip = 1"), "2013", path)
    files = {str(f) for f in (tmp_path / "store" / "archive=2013").iterdir()}
    archives.add_archive(people, "2014", path)
    # the earlier archive's files are as they were: only the new archive was read and written
    assert {str(f) for f in (tmp_path / "store" / "archive=2013").iterdir()} == files
    archives.add_archive(people.filter("fip = 2"), "2014", path)  # again, with what it holds now
    counts = archives.stored_counts(spark, path)
    assert sorted(map(tuple, archives.stored_shares(counts).collect())) == [(1, "a", 2, .5), (1, "b", 2, .5), (2, "c", 1, 1.0)]
    assert sorted(map(tuple, archives.stored_totals(counts).collect())) == [(1, 2, 1, 2), (2, 2, 1, 1)]
    one = archives.stored_counts(spark, path, ["2014"])
    assert sorted(map(tuple, archives.stored_totals(one).collect())) == [(2, 2, 1, 1)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(archive" in plan or "archive#" in plan.split("PartitionFilters: [")[1].split("]")[0]
