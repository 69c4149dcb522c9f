"""Every storm query with SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import pytest

from cumulo.queries import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].dt.strftime("%Y-%m-%d")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: v if v is None or isinstance(v, (str, bool, float)) else str(v)[:10])
        else:
            df[c] = df[c].astype(float)
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).to_numpy().tolist()), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    found, wanted = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found) == rows(wanted)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_others_run(spark, name):
    assert len(QUERIES[name](spark, SF).columns) > 1


def test_plans_have_no_cartesian_product(spark, capsys):
    for name in ("q_family_link", "q_ccl", "q_seasonal_grid", "q_transition_class"):
        QUERIES[name](spark, SF).explain()
    assert "CartesianProduct" not in capsys.readouterr().out
