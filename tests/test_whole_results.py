"""Queries whose subject is not the limit give every row, also where these are more than the default limit."""

import os

import pytest
from pyspark.sql import functions as F

from quarry.plans.contexts import DEFAULT_LIMIT
from quarry.queries import catalog

SF = "/root/testdata/sf0.001"
MANY = DEFAULT_LIMIT + 500


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("large")
    for t in catalog.USED:
        if t not in ("orders", "supplier", "lineitem"):
            os.symlink(f"{SF}/{t}.parquet", at / f"{t}.parquet")
    of = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    asian = of("customer").join(of("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(of("region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'").head()["c_custkey"]
    numbers = spark.range(MANY)
    orders = of("orders").limit(1).crossJoin(numbers).withColumns({"o_orderkey": F.col("id"), "o_custkey": F.lit(asian), "o_totalprice": F.lit(495000.0)}).drop("id")
    orders.write.parquet(str(at / "orders.parquet"))
    of("supplier").limit(1).crossJoin(numbers).withColumns({"s_suppkey": F.col("id"), "s_name": F.concat(F.lit("s"), "id")}).drop("id").write.parquet(str(at / "supplier.parquet"))
    lines = of("lineitem").limit(1).crossJoin(spark.range(MANY * 591)).withColumns({"l_suppkey": F.col("id") % MANY, "l_orderkey": F.col("id")}).drop("id")
    lines.write.parquet(str(at / "lineitem.parquet"))
    return str(at)


@pytest.mark.parametrize("name", ["view_single", "view_filter_join", "having_measure"])
def test_more_rows_than_the_default_limit(spark, large, name):
    assert catalog.QUERIES[name](spark, large).count() == MANY
