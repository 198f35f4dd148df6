"""Word usage by group, the chi-squared tail, and scoring over bucketed tables."""
import math
import re

import pytest
from pyspark.sql import functions as F

from geolex import session
from geolex.functions import stats as st
from geolex.operators import predict, usage
from geolex.plans import catalog, jobs
from tests.conftest import SF001


def exact_tail(x, df):
    """Closed forms of the upper tail for 1 to 3 degrees."""
    return {1: math.erfc(math.sqrt(x / 2)), 2: math.exp(-x / 2),
            3: math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)}[df]


def test_chi2_tail_against_closed_forms(spark):
    points = [(x, df) for df in (1, 2, 3) for x in (1e-9, 0.01, 0.5, 1.9, 2.9, 3.1, 4.9, 5.1, 7.8, 20.0, 100.0, 400.0, 900.0)]
    got = spark.createDataFrame(points, "x double, df int").select("x", "df", st.chi2_tail("x", "df", 3).alias("p")).collect()
    assert len(got) == len(points)
    for r in got:
        assert r.p == pytest.approx(exact_tail(r.x, r.df), rel=1e-10)


def test_chi2_tail_edges(spark):
    rows = spark.createDataFrame([(0.0, 1), (5.0, 0), (5.0, 4), (None, 2), (1e6, 3)], "x double, df int")
    assert [r.p for r in rows.select(st.chi2_tail("x", "df", 3).alias("p")).collect()] == [1.0, None, None, None, 0.0]


def test_groups_by_the_level_that_stands_out(spark):
    targets = spark.createDataFrame([("a", .7, .1, .1, .1), ("b", .5, .3, .1, .1), ("c", .6, .2, .1, .1), ("d", None, .2, .1, .1)],
                                    "fip string, y0 double, y1 double, y2 double, y3 double")
    got = {r.fip: r.level for r in usage.level_groups(targets).collect()}
    assert got == {"a": 0, "b": 1, "c": 0}  # d has no group; c's deviations tie at the first


def brute_g(table, totals):
    w, t = sum(table), sum(totals)
    out = 0.0
    for n, of in zip(table, totals):
        for seen, expected in ((n, w * of / t), (of - n, of - w * of / t)):
            out += seen * math.log(seen / expected) if seen else 0.0
    return 2 * out


def test_word_usage_by_hand(spark):
    counts = [("a", "x", 30), ("b", "x", 5), ("c", "x", 4), ("a", "y", 10), ("b", "y", 20), ("e", "y", 9), ("c", "z", 2)]
    groups = spark.createDataFrame([("a", 0), ("b", 2), ("c", 2)], "fip string, level int")
    got = {r.word: r for r in usage.word_usage(spark.createDataFrame(counts, "fip string, word string, cnt long"), groups).collect()}
    tables = {"x": (30, 0, 9, 0), "y": (10, 0, 20, 0), "z": (0, 0, 2, 0)}  # e has no group
    for word, table in tables.items():
        g = brute_g([n for n in (table[0], table[2])], (40, 31))
        assert tuple(got[word][f"n_{k}"] for k in range(4)) == table
        assert got[word].g == pytest.approx(g, rel=1e-12) and got[word].pval == pytest.approx(exact_tail(g, 1), rel=1e-9)
    assert {w: r.top_level for w, r in got.items()} == {"x": 0, "y": 2, "z": 2}


def test_word_usage_of_odd_tables(spark):
    schema, groups = "fip string, word string, cnt long", spark.createDataFrame([("a", 1)], "fip string, level int")
    assert usage.word_usage(spark.createDataFrame([], schema), groups).count() == 0
    one = usage.word_usage(spark.createDataFrame([("a", "x", 3), (None, "x", 2), ("a", None, 1)], schema), groups).collect()
    assert {(r.word, r.n_1, r.g, r.pval) for r in one} == {("x", 3, 0.0, None), (None, 1, 0.0, None)}


def test_bucketed_tables_are_scored_without_an_exchange(spark):
    counts = spark.range(4000).select((F.col("id") % 50).alias("user_id"), F.concat(F.lit("w"), F.col("id") % 97).alias("word"),
                                      F.lit(2).cast("long").alias("cnt")).distinct()
    model = spark.range(90).select(F.concat(F.lit("w"), F.col("id")).alias("word"),
                                   *[(F.col("id") * (k + 1) / 100.0 - 0.5).alias(f"slope_{k}") for k in range(4)])
    users = spark.range(50).select(F.col("id").alias("user_id"))
    left = jobs.bucketed(predict.salted_counts(counts), "t_counts")
    right = jobs.bucketed(predict.salted_model(model), "t_model")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = predict.classify(left, users, right, on=("word", "salt"))
        scored.collect()
        plan = scored._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan[[m.start() for m in re.finditer("SortMergeJoin", plan)][-1]:]
    assert "LeftOuter" in below and "Exchange" not in below and below.count("Bucketed: true") == 2
    expected = predict.classify(counts, users, model)
    assert {tuple(round(x, 9) for x in r) for r in scored.collect()} == {tuple(round(x, 9) for x in r) for r in expected.collect()}
    assert scored.count() == 50


def test_sinks_are_removed_with_the_cuts(spark):
    import os
    path = jobs.sink_path(spark, "gone")
    spark.range(3).write.parquet(path)
    kept = list(session._cuts)
    session._cuts[:] = [path]
    assert session.remove_cuts(spark) == 1 and not os.path.exists(path)
    session._cuts[:] = [p for p in kept if p != path]


@pytest.mark.parametrize("name", ["x3_word_usage_by_level", "x4_score_bucketed_tables"])
def test_no_python_worker_or_product(spark, name):
    plan = catalog.queries()[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan
