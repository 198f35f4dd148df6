"""Differential test: every registered query against its DuckDB twin (sf0.001)."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from geolex.plans import catalog, oracle
from tests.conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = catalog.queries()[name](spark, SF001)
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(dcols, res.fetchall())


def test_x5_posts_reach_counties(spark):
    rows = catalog.queries()["x5_located_counties"](spark, SF001).collect()
    counts = catalog.queries()["x5_located_counts"](spark, SF001).first()
    assert 0 < len(rows) == counts.n_valid and counts.n_total > 0 and all(r.user_id % 6 == 3 for r in rows)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(ORACLE)


def test_entry_lists_the_catalog(spark):
    assert set(catalog.queries()) <= set(E.queries())
    assert set(ORACLE) <= set(E.oracle_sql())


def test_entry_runs(spark):
    out = E.entry(spark)
    assert out.columns == catalog.queries()["w4_top_words"](spark, SF001).columns
    assert out.count() == 20
