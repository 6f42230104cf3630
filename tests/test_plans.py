"""Plans: filters and columns reach the scan, aggregates combine before the shuffle, no cross products."""

import os

import pytest
from pyspark.sql import functions as F

from loomsheet import queries as core
from loomsheet.operators import tables
from loomsheet.plans.docsql import Database

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushdown(spark):
    db = Database(spark, {"orders": spark.read.parquet(f"{DATA}/orders.parquet")})
    text = plan(db.execute("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_custkey = 5"))
    assert "GreaterThan(o_totalprice,1000.0)" in text and "EqualNullSafe(o_custkey,5)" in text and "o_orderpriority" not in text
    less = plan(db.execute("SELECT o_orderkey FROM orders WHERE o_totalprice < 1000"))
    assert "Or(IsNull(o_totalprice),LessThan(o_totalprice,1000.0))" in less
    part = spark.read.parquet(f"{DATA}/part.parquet")
    assert "GreaterThan(p_size,9)" in plan(part.filter(tables.custom_filter("p_size", "gt", 9)))


def test_partial_aggregates(spark):
    text = plan(core.queries()["docsql_group"](spark, DATA))
    assert "partial_sum" in text and "partial_count" in text and "o_orderpriority" not in text


@pytest.mark.parametrize("name", ["filter_top_n", "filter_above_average", "classify_rows", "spatial_join", "lookup_exact", "include_reference", "set_except", "store_new_papers", "p1_found", "p6_found"])
def test_no_products(spark, name):
    text = plan(core.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_top_k_is_not_a_sort(spark):
    assert "TakeOrderedAndProject" in plan(core.queries()["vector_nearest"](spark, DATA))
    assert "TakeOrderedAndProject" in plan(core.queries()["sort_spec"](spark, DATA).select(F.col("id")))
