"""Every registered query against its SQL on the smallest data folder, and the shape of its plan."""

import math
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from shelfsight.plans.queries import all_queries

FOLDER = "/root/testdata/sf0.001"
MODEL_BASED = ("a_scores", "a_model_quality")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert set(all_queries()) - set(oracle_sql()) == set(MODEL_BASED)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, database, name):
    df = queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    found = database.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.columns, df.collect()) == normal(columns, found.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_inputs_show_what_they_should(spark):
    def values(name, column):
        return {row[column] for row in queries()[name](spark, FOLDER).collect()}

    assert len(values("k10_clv", "value_segment")) > 1
    assert len(values("k1_daily_revenue", "day_type")) == 2
    assert "Unknown" in values("d_dim_store", "region")
    assert values("a_labels", "risk") == {0, 1}
    assert min(values("c_report", "value")) > 0
    assert any(";" in reason for reason in values("v_quarantine", "quarantine_reason"))
    assert "XXXXX-" in values("g_masked_customers", "phone_masked")
    assert values("e_scd2_checks", "violations") == {0}
