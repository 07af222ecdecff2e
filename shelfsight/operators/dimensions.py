"""Dimension tables of the star schema."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.keys import assign_keys
from ..schemas import STAR
from ..workspace import Workspace


def dim_date(spark: SparkSession, first: date, last: date, holidays: DataFrame | None = None) -> DataFrame:
    """One row per day from first to last; ``holidays`` (date, festival_name) is optional."""
    days = spark.range((last - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    if holidays is None:
        days = days.withColumn("festival_name", F.lit(None).cast("string")).withColumn("is_holiday", F.lit(False))
    else:
        named = holidays.groupBy("date").agg(F.min("festival_name").alias("festival_name"), F.lit(True).alias("_hit"))
        days = days.join(named, "date", "left").withColumn("is_holiday", F.coalesce("_hit", F.lit(False)))
    return days.select(
        E.date_key(F.col("date")).alias("date_key"),
        "date",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.dayofmonth("date").alias("day"),
        F.dayofweek("date").isin(1, 7).alias("is_weekend"),
        "is_holiday",
        "festival_name",
    )


def dim_customer(customers: DataFrame, valid_from: datetime, work: Workspace) -> DataFrame:
    """First version of every customer, keyed in id order."""
    rows = customers.select(
        "customer_id",
        "name",
        "email",
        "phone",
        "city",
        F.lit(valid_from).cast("timestamp").alias("valid_from"),
        F.lit(None).cast("timestamp").alias("valid_to"),
        F.lit(True).alias("is_current"),
        F.lit(1).alias("version"),
    )
    return assign_keys(rows, ["customer_id"], "customer_key", work, "customers_by_id")


def dim_product(products: DataFrame, work: Workspace) -> DataFrame:
    """Products keyed in id order; the brand is NULL where the input has none, cost is not kept."""
    brand = F.col("brand") if "brand" in products.columns else F.lit(None).cast("string")
    rows = products.select(
        "product_id",
        F.col("product_name").alias("name"),
        "category",
        brand.alias("brand"),
        F.col("base_price").cast("decimal(12,2)").alias("price"),
    )
    return assign_keys(rows, ["product_id"], "product_key", work, "products_by_id")


def dim_store(stores: DataFrame, work: Workspace, regions: Mapping[str, str] = E.CITY_REGION) -> DataFrame:
    """Stores keyed in id order with the sales region of their city."""
    rows = stores.select("store_id", "store_name", "city", E.region_of(F.col("city"), regions).alias("region"))
    return assign_keys(rows, ["store_id"], "store_key", work, "stores_by_id")


def store_region_counts(stores: DataFrame) -> DataFrame:
    return stores.groupBy("region").agg(F.count(F.lit(1)).alias("store_count"))


def dim_external_events(spark: SparkSession) -> DataFrame:
    """Empty table, kept for the schema."""
    return spark.createDataFrame([], STAR["dim_external_events"])
