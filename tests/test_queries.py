"""Every named query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr(tuple(r[i] for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLES:
        res = con.execute(ORACLES[name])
        assert got == canonical([c[0] for c in res.description], res.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES)


PLAIN = ["p04_many_lags", "p20_neighbour_mean", "a01_daily_activity", "e04_effect_distribution", "j08_dense_network_summary", "e06_dense_homophily"]


@pytest.mark.parametrize("name", PLAIN)
def test_no_table_is_multiplied(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Python" not in plan
