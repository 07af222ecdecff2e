"""A third of all rows under one key: joins are split, groups are reduced before they travel."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfsight.operators import dimensions, facts, kpi
from shelfsight.sources import files

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "10KB",
}


@pytest.fixture
def small_partitions(spark):
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def star(spark, work):
    n = 60000
    hot = F.col("id") % 3 == 0
    lines = spark.range(0, n, 1, 8).select(
        F.col("id").cast("string").alias("transaction_id"),
        F.lit(datetime(2024, 5, 1)).alias("date"),
        F.concat(F.lit("S"), (F.col("id") % 50).cast("string")).alias("store_id"),
        F.concat(F.lit("C"), F.when(hot, 0).otherwise(F.col("id") % 997).cast("string")).alias("customer_id"),
        F.concat(F.lit("P"), F.when(hot, 0).otherwise(F.col("id") % 499).cast("string")).alias("product_id"),
        F.lit(1).alias("quantity"),
        F.lit(2).cast("decimal(12,2)").alias("price"),
        F.lit(0).cast("decimal(18,4)").alias("discount"),
    )
    lines = work.save(lines.repartition(8), "skewed_lines")

    def ids(prefix, count):
        return spark.range(count).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("k"))

    customers = ids("C", 997).selectExpr("k customer_id", "k name", "k email", "k phone", "'Pune' city")
    products = ids("P", 499).selectExpr("k product_id", "k product_name", "'c' category", "cast(2 as decimal(12,2)) base_price")
    stores = ids("S", 50).selectExpr("k store_id", "k store_name", "'Pune' city")
    return {
        "lines": lines,
        "customers": dimensions.dim_customer(customers, datetime(2024, 1, 1), work),
        "products": dimensions.dim_product(products, work),
        "stores": dimensions.dim_store(stores, work),
        "dates": dimensions.dim_date(spark, date(2024, 1, 1), date(2024, 12, 31)),
    }


def test_hot_ids_are_split_over_tasks(small_partitions, star):
    sales = facts.fact_sales(star["lines"], star["customers"], star["products"], star["stores"], star["dates"])
    assert len(sales.collect()) == 60000
    final = sales._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert final.count("SortMergeJoin(skew=true)") >= 2


def test_hot_groups_are_reduced_before_the_shuffle(spark, star, work):
    sales = work.save(
        facts.fact_sales(star["lines"], star["customers"], star["products"], star["stores"], star["dates"]), "skewed_sales"
    )
    best = kpi.top_products(sales, star["products"], 1).first()
    assert best["product_id"] == "P0" and best["transaction_count"] == 20000 + sum(1 for i in range(60000) if i % 3 and i % 499 == 0)
    plan = sales.groupBy("product_key").count()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
    newest = files.latest_per_key(sales, "customer_key", "date_key", "sale_id")
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange") :]
    assert newest.count() == 997
