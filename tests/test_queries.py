"""The library's queries against their SQL on the smallest tables."""

import math

import pytest

import __spark_entry__ as entry
from tessella import queries as library

def canon(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "-"
        return f"{v + 0.0:.5f}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", library.ORACLES)
def test_query_equals_sql(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = library.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    names = ", ".join(columns)
    assert canon(df.select(*columns).collect()) == canon(con.execute(f"SELECT {names} FROM ({library.ORACLES[name]})").fetchall())


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_plans_stay_in_the_jvm(spark, data):
    plan = library.plan_center_weighted(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "WindowGroupLimit" in plan
