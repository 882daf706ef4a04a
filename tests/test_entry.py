import duckdb
import pytest

import __spark_entry__ as entry
from conformix.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    def one(v):
        return float(f"{v:.9g}") if isinstance(v, float) else v

    return sorted(repr([one(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [[r[c] for c in cols] for r in df.collect()]
    cur = con.execute(ORACLE_SQL[name])
    own = [d[0] for d in cur.description]
    want = [[r[own.index(c)] for c in cols] for r in cur.fetchall()]
    assert sorted(own) == cols and canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_a_query_each():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
