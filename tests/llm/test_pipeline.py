"""The corpus pipeline and the registered queries."""
import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from geolex.llm import op1_simhash_near_dedup as op1, queries
from geolex.llm.common import cut
from tests.conftest import SF001
from tests.llm.test_dedup_and_mix import brute_groups

TABLES = "documents embeddings labels benchmark".split()


def test_all_are_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(queries.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    out = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in out.description]
    got = queries.queries()[name](spark, SF001)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(repr, out.fetchall()))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = cut(stage(spark, docs, SF001), "test-stage")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        kept[name] = docs = out
    names = [n for n, _ in corpus_pipeline.STAGES]
    before = [(r.doc_id, r.text) for r in kept[names[0]].collect()]
    assert sorted(r.doc_id for r in kept[names[1]].collect()) == sorted(k for k, _ in brute_groups(before).values())
    found = op1.near_dup_components(kept[names[1]]).collect()
    assert sorted(r.doc_id for r in kept[names[2]].collect()) == sorted(
        r.doc_id for r in found if r.doc_id == r.component_id)
    assert set(kept[names[3]].distinct().collect()) <= set(kept[names[2]].collect())
    assert docs.count() == kept[names[3]].count()


def test_odd_rows_pass_through(spark, odd, none):
    for table in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF001)
            assert out.columns == table.columns and out.count() <= 3 * table.count()
        assert corpus_pipeline.STAGES[-1][1](spark, table, SF001).count() == table.count()
