"""The driver's contract, and queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from gristmill.plans import catalogue

TABLES = "events documents pages labels conversations".split()


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(None if v is None or v != v else round(v, 9) if isinstance(v, float) else v for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{entry.SMALL}/{t}.parquet'")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "action", "risk_score", "fixed_floor", "n_matches", "categories"] and df.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in catalogue.ORACLE_SQL if not n.startswith("scan_") or n in ("scan_credit_card", "scan_api_key")))
def test_query_equals_sql(spark, db, name):
    got, want = catalogue.QUERIES[name](spark, entry.SMALL).toPandas(), db.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
