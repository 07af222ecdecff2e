"""Fact tables. Source ids become surrogate keys by equi-joins with the dimensions.

No join is forced to broadcast: Spark compares the measured size of a dimension with its broadcast
threshold (but for the products of stock, which are always shuffled), and adaptive execution splits the
partitions of a hot id where it has to shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as E

REORDER_POINT = 20
ON_TIME_DAYS = 5


def fact_sales(
    cleaned: DataFrame, customers: DataFrame, products: DataFrame, stores: DataFrame, dates: DataFrame
) -> DataFrame:
    """One row per cleaned transaction whose customer, product, store and date are all known."""
    current = customers.where("is_current").select("customer_id", "customer_key")
    discount = F.coalesce(F.col("discount"), F.lit(0)).cast("decimal(18,4)")
    lines = cleaned.select(
        F.col("transaction_id").alias("sale_id"),
        E.date_key(F.to_date("date")).alias("date_key"),
        "customer_id",
        "product_id",
        "store_id",
        "quantity",
        (F.col("quantity").cast("decimal(10,0)") * F.col("price").cast("decimal(12,2)") - discount)
        .cast("decimal(18,4)")
        .alias("revenue"),
        discount.alias("discount"),
    )
    return (
        lines.join(dates.select("date_key"), "date_key")
        .join(stores.where("store_key IS NOT NULL").select("store_id", "store_key"), "store_id")
        .join(products.where("product_key IS NOT NULL").select("product_id", "product_key"), "product_id")
        .join(current.where("customer_key IS NOT NULL"), "customer_id")
        .select("sale_id", "date_key", "customer_key", "product_key", "store_key", "quantity", "revenue", "discount")
    )


def fact_inventory(inventory: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Stock snapshots by key; rows whose product or store is unknown are left out.

    There is a row for each pair and day, the largest table of all. Stores, which are few, come first, so that what is shuffled for the products
    has their key in place of its text. Products are hashed, so that stock is not sorted.
    """
    return (
        inventory.join(stores.select("store_id", "store_key"), "store_id")
        .join(products.select("product_id", "product_key").hint("shuffle_hash"), "product_id")
        .select(
            F.lit(None).cast("bigint").alias("inventory_id"),
            E.date_key(F.to_date("date")).alias("date_key"),
            "product_key",
            "store_key",
            "stock_level",
            F.lit(REORDER_POINT).alias("reorder_point"),
        )
    )


def unresolved_inventory(inventory: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Number of stock rows that ``fact_inventory`` leaves out."""
    known = inventory.join(products.select("product_id", "product_key"), "product_id", "left").join(
        stores.select("store_id", "store_key"), "store_id", "left"
    )
    absent = F.col("product_key").isNull() | F.col("store_key").isNull()
    return known.agg(F.count_if(absent).alias("unresolved_rows"))


def fact_shipments(shipments: DataFrame, sales: DataFrame, dates: DataFrame) -> DataFrame:
    """Shipments of known sales. Delivery time is the number of full 24 h periods underway."""
    seconds = F.unix_seconds("delivery_date") - F.unix_seconds("ship_date")
    days = F.floor(seconds / F.lit(86400)).cast("bigint")
    return (
        shipments.select(
            "shipment_id",
            F.col("transaction_id").alias("sale_id"),
            E.date_key(F.to_date("ship_date")).alias("date_key"),
            days.cast("double").alias("delivery_time"),
            F.coalesce(days <= ON_TIME_DAYS, F.lit(False)).alias("on_time_flag"),
        )
        .join(sales.select("sale_id", "product_key", "store_key"), "sale_id")
        .join(dates.select("date_key"), "date_key")
        .select("shipment_id", "date_key", "product_key", "store_key", "delivery_time", "on_time_flag")
    )


def unmatched_shipments(shipments: DataFrame, sales: DataFrame, dates: DataFrame) -> DataFrame:
    """Number of shipments without a known sale or a known ship date."""
    keyed = shipments.select(
        F.col("transaction_id").alias("sale_id"), E.date_key(F.to_date("ship_date")).alias("date_key")
    )
    matched = keyed.join(sales.select("sale_id", F.lit(True).alias("_sale")), "sale_id", "left").join(
        dates.select("date_key", F.lit(True).alias("_day")), "date_key", "left"
    )
    return matched.agg(F.count_if(F.col("_sale").isNull() | F.col("_day").isNull()).alias("unmatched_rows"))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count, is_empty) per table."""
    counted = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        counted = one if counted is None else counted.unionByName(one)
    return counted.withColumn("is_empty", F.col("row_count") == 0)


def verify_columns(tables: dict[str, DataFrame], required: dict[str, list[str]]) -> None:
    """Raise when a table or one of its required columns is missing."""
    for name, columns in required.items():
        if name not in tables:
            raise RuntimeError(f"required table {name} not found")
        absent = [c for c in columns if c not in tables[name].columns]
        if absent:
            raise RuntimeError(f"required columns {absent} not found in {name}")
