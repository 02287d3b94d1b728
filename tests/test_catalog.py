"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import sys

import duckdb
import pytest

sys.path.insert(0, ".")
from tidepanel.plans.catalog import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    own.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        own.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return own


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_and_sql_agree(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = con.sql(ORACLE_SQL[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())
    assert ours == theirs


def test_scans_are_pruned_and_nothing_crosses(spark):
    for name in ("churn_labels", "lag_delta_ratio", "account_seasonality"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan
    plan = QUERIES["panel_header"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_comment" not in plan


def test_pending_orders_of_every_quarter_count(spark, tmp_path):
    """Months of a second half year have rows of their own, and end the panel."""
    rows = [(f"{m}-05 10:00:00", p, s) for m, p, s in (("2000-03", "1-URGENT", "P"), ("2000-05", "1-URGENT", "F"), ("2000-06", "2-HIGH", "P"), ("2000-09", "1-URGENT", "P"), ("2000-12", "1-URGENT", "P"))]
    orders = spark.createDataFrame(rows, "at string, o_orderpriority string, o_orderstatus string")
    orders.selectExpr("to_timestamp(at) AS o_orderdate", "o_orderpriority", "o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    name = "missing_periods_of_pending_orders"
    want = [200004, 200005, 200006, 200007, 200008, 200010, 200011]
    assert sorted(r["period"] for r in QUERIES[name](spark, str(tmp_path)).collect()) == want
    own = duckdb.connect()
    own.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(r[0] for r in own.sql(ORACLE_SQL[name]).fetchall()) == want
