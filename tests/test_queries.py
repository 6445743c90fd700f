"""Every query against its SQL, over the smallest tables."""

import duckdb
import pytest

from tidelog.plans.oracle import ORACLE_SQL
from tidelog.plans.queries import QUERIES


def rows(df):
    columns = sorted(df.columns)
    clean = df[columns].astype(object).where(df[columns].notna(), None)
    return sorted(tuple(str(v) for v in r) for r in clean.itertuples(index=False))


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["key", "doc", "ts"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_key_bounds_reach_the_scan(spark, tmp_path):
    from tidelog.operators.read import scan
    from tidelog.schema import RECORD

    spark.createDataFrame([], RECORD).write.parquet(f"{tmp_path}/log")
    plan = scan(spark.read.parquet(f"{tmp_path}/log"), "b", "d")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,b)" in plan and "LessThan(key,d)" in plan
