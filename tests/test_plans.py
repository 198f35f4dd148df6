"""Plan checks: no Python evaluation, no cartesian product, pruned scans."""
import re

import pytest

from geolex.plans import catalog
from tests.conftest import SF001

BAD = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "FlatMapGroupsInPandas")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def cut_plans(monkeypatch):
    """The plans handed to ``materialize`` while a query is built."""
    from geolex import session
    from geolex.operators import nearest, profiles, tfidf, wordmodel
    from geolex.plans import jobs, standins
    seen = []

    def spy(df, name, real=session.materialize):
        seen.append(plan_of(df))
        return real(df, name)
    for module in (session, catalog, nearest, profiles, tfidf, wordmodel, jobs, standins):
        monkeypatch.setattr(module, "materialize", spy)
    return seen


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_python_or_cartesian(spark, cut_plans, name):
    """Neither in the query's own plan nor in what feeds its cuts."""
    df = catalog.queries()[name](spark, SF001)
    for plan in [plan_of(df), *cut_plans]:
        for bad in BAD:
            assert bad not in plan, f"{name}: {bad}"


@pytest.mark.parametrize("name", ["a4_person_records", "a1_region_words", "a2_region_word_share", "r1_word_regression",
                                  "x1_person_records", "x1_county_words", "j5_resolve_places"])
def test_nothing_is_exchanged_on_the_region_alone(spark, cut_plans, name):
    """Posts and word counts never meet a region's levels or totals by a shuffle on its
    key (aggregations to one row per region excepted)."""
    df = catalog.queries()[name](spark, SF001)
    for plan in [plan_of(df), *cut_plans]:
        assert not re.search(r"SortMergeJoin \[(fip|fips|_zip)#\d+L?\]", plan), name


def test_w1_scans_once(spark):
    assert plan_of(catalog.queries()["w1_top_regions"](spark, SF001)).count("FileScan") == 1


def test_column_pruning_on_documents(spark):
    df = catalog.queries()["t4_tokens"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_bonferroni_cross_join_is_one_row_broadcast(spark):
    df = catalog.queries()["r6_word_model"](spark, SF001)
    plan = plan_of(df)
    assert "BroadcastNestedLoopJoin" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["j5_resolve_places", "x1_person_records"])
def test_posts_are_read_once(spark, name):
    """Resolved by name or by coordinates, every post comes from one scan of the texts."""
    assert len(re.findall(r"ReadSchema: struct<[^>]*\btext:string", plan_of(catalog.queries()[name](spark, SF001)))) == 1


@pytest.mark.parametrize("name", ["r9_classify_users", "r10_evaluate", "x4_score_saved_model"])
def test_users_and_words_come_from_one_read_of_the_texts(spark, cut_plans, name):
    df = catalog.queries()[name](spark, SF001)
    texts = [len(re.findall(r"ReadSchema: struct<[^>]*\btext:string", p)) for p in [plan_of(df), *cut_plans]]
    assert sum(texts) == 1


def test_counts_come_from_the_pass_that_writes_the_records(spark, monkeypatch):
    """The raw lines' texts are scanned by one job; the counts read no table again."""
    from pyspark.sql import DataFrameWriter
    seen = []

    def spy(self, path, *a, real=DataFrameWriter.parquet, **kw):
        seen.append(plan_of(self._df))
        return real(self, path, *a, **kw)
    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    counts = catalog.queries()["x5_located_counts"](spark, SF001)
    texts = [p for p in seen if re.search(r"ReadSchema: struct<doc_id:bigint,text:string", p)]
    assert len(texts) == 1 and "CollectMetrics" in texts[0]
    assert "FileScan" not in plan_of(counts)


def test_nearest_zip_is_an_equi_join(spark):
    plan = plan_of(catalog.queries()["j3_nearest_zip"](spark, SF001))
    assert "NestedLoopJoin" not in plan and ("HashJoin" in plan or "SortMergeJoin" in plan)


def test_word_model_ranges_on_data(spark):
    rows = catalog.queries()["r1_word_regression"](spark, SF001).collect()
    assert rows
    for r in rows:
        assert r["count"] > 3
        assert r.slope is None or -1.0 - 1e-9 <= r.slope <= 1.0 + 1e-9
        assert r.pval is None or 0.0 <= r.pval <= 1.0
        assert (r.slope is None) == (r.pval is None)
