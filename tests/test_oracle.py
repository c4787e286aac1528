"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    for k in df.columns:
        if df[k].dtype.kind == "f":
            df = df.assign(**{k: df[k].round(6)})
    df = df.astype(object).where(df.notna(), None)
    return sorted(map(tuple, df.values.tolist()), key=lambda r: [str(x) for x in r])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = duck.execute(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
