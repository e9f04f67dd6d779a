"""Every catalog query with a DuckDB oracle matches it on the small fixture."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SMALL
from flowwarden.sources.tables import TABLES
from tools.check_oracle import key, norm

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["alert_type", "alert_count"]
    assert sum(r.alert_count for r in rows) >= 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SMALL)
    cols = sorted(sdf.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in sdf.collect()), key=key)
    res = con.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    assert sorted(ocols) == cols
    idx = {c: i for i, c in enumerate(ocols)}
    want = sorted((tuple(norm(r[idx[c]]) for c in cols) for r in res.fetchall()), key=key)
    assert len(got) == len(want)
    assert got == want
