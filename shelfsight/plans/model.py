"""The retail model over the given order, line, part, customer and supplier tables.

The tables are mapped to raw retail inputs (with defects, so that validation and cleaning have work to
do) and from there to the star schema. Tables that many queries share are written once per application
to the workspace; everything else stays a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cleaning, dimensions, facts, ingest, stockout
from ..schemas import LOGS, TableRule
from ..session import fit_shuffles
from ..sources.files import TIGHT
from ..workspace import Workspace

AS_OF = datetime(2002, 1, 1)
SNAPSHOT_AT = datetime(2002, 2, 1)
OPENED = datetime(1995, 1, 1)
STOCK_DAYS = ("2001-02-28", "2001-03-31", "2001-04-30", "2001-05-31", "2001-06-30", "2001-07-31")
LINE_BYTES = 512
PAYMENTS = ("Cash", "UPI", "Credit Card", "Debit Card")
MOVEMENT = (26.7, 24.2)
FREQUENCY = ((29.5, "One-time"), (30.0, "Occasional"), (30.5, "Regular"))
VALUE = ((600000, "Low Value"), (640000, "Medium Value"), (680000, "High Value"))
TIERS = {"NATION_0": "Metro", "NATION_5": "Metro", "NATION_7": "Metro", "NATION_3": "Tier-1", "NATION_12": "Tier-1"}
# Nations of the first region are left out, so that their stores fall to the default.
REGIONS = {f"NATION_{n}": ("AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")[n % 5 - 1] for n in range(25) if n % 5}

TRANSACTION_RULE = TableRule(
    "transactions",
    ("transaction_id", "product_id", "store_id", "customer_id", "date", "quantity", "price"),
    ("discount", "payment_method"),
)


def _id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.lpad(F.col(key).cast("string"), 12, "0"))


class RetailModel:
    """Lazy tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir.rstrip("/")
        self.work = Workspace(spark, "model-" + self.dir.strip("/").replace("/", "-"), TIGHT)
        self._built: dict[str, Any] = {}
        # Order lines are by far the largest input. What a task sorts, joins and groups of one takes about 512 bytes, however small its
        # file is; their number stands in the file.
        fit_shuffles(spark, LINE_BYTES * self.table("lineitem").count())

    def once(self, name: str, build: Callable[[], Any]) -> Any:
        """Value of ``build``, computed at the first call."""
        if name not in self._built:
            self._built[name] = build()
        return self._built[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # Raw inputs

    @cached_property
    def raw_transactions(self) -> DataFrame:
        """Order lines as raw sales, landed once: cleaning, validation and the file readers all start here."""
        return self.work.save(self._transactions(), "raw_transactions")

    def _transactions(self) -> DataFrame:
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"
        )
        orders = self.table("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.to_date("o_orderdate").alias("_day")
        )
        parts = self.table("part").select(
            F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").cast("decimal(12,2)").alias("_price")
        )
        order, with_part = F.col("l_orderkey"), F.col("l_orderkey") + F.col("l_partkey")
        units = F.col("l_quantity").cast("int")
        day = F.when(order % 331 == 7, F.add_months("_day", 120)).otherwise(F.col("_day"))
        amount = units.cast("decimal(10,0)") * F.col("_price") * F.col("l_discount").cast("decimal(4,2)")
        payment = F.element_at(F.array(*(F.lit(p) for p in PAYMENTS)), (F.pmod(order, F.lit(4)) + 1).cast("int"))
        return (
            lines.join(orders, "l_orderkey")
            .join(parts, "l_partkey")
            .select(
                F.when(order % 997 != 11, F.concat_ws("-", order.cast("string"), F.col("l_linenumber").cast("string"))).alias(
                    "transaction_id"
                ),
                F.when(order % 499 == 3, "not-a-date").otherwise(F.date_format(day, "yyyy-MM-dd")).alias("date"),
                F.when((order + F.col("l_suppkey")) % 307 != 5, _id("ST", "l_suppkey")).alias("store_id"),
                F.when(order % 101 != 9, _id("CUST", "o_custkey")).alias("customer_id"),
                _id("P", "l_partkey").alias("product_id"),
                F.when(with_part % 211 == 1, 0).otherwise(units).alias("quantity"),
                F.when(with_part % 199 == 2, -F.col("_price"))
                .when(with_part % 503 == 4, F.col("_price") * 20)
                .otherwise(F.col("_price"))
                .cast("decimal(12,2)")
                .alias("price"),
                payment.alias("payment_method"),
                F.when(F.col("l_linenumber") != 7, amount.cast("decimal(18,4)")).alias("discount"),
            )
        )

    @cached_property
    def raw_customers(self) -> DataFrame:
        nations = self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
        key = F.col("c_custkey")
        return (
            self.table("customer")
            .join(nations, "c_nationkey")
            .select(
                _id("CUST", "c_custkey").alias("customer_id"),
                F.col("c_name").alias("name"),
                F.when(key % 50 == 0, F.lit(None))
                .when(key % 50 == 25, F.concat(F.lit("user"), key.cast("string"), F.lit(".example.com")))
                .otherwise(F.concat(F.lit("user"), key.cast("string"), F.lit("@example.com")))
                .alias("email"),
                F.when(key % 50 != 0, F.concat(F.lit("+91-"), (key + 9000000000).cast("string"))).alias("phone"),
                "city",
            )
        )

    @cached_property
    def customer_snapshots(self) -> DataFrame:
        """Two later snapshots of the customers: some move, and suppliers open accounts of their own."""
        nations = self.table("nation").select(F.col("n_nationkey").alias("_nation"), F.col("n_name").alias("city"))
        customers = self.table("customer").select(F.col("c_custkey").alias("key"), "c_name", "c_nationkey")
        columns = ["customer_id", "name", "email", "phone", "city", "snapshot_ts"]

        def taken(rows: DataFrame, at: datetime) -> DataFrame:
            return (
                rows.join(nations, "_nation")
                .withColumn("email", F.concat(F.lit("new"), F.col("key").cast("string"), F.lit("@example.org")))
                .withColumn("phone", F.concat(F.lit("080-"), (F.col("key") + 10000000).cast("string")))
                .withColumn("snapshot_ts", F.lit(at).cast("timestamp"))
                .select(*columns)
            )

        moved = F.when(F.col("key") % 10 == 0, F.pmod(F.col("c_nationkey") + 1, F.lit(25))).otherwise(F.col("c_nationkey"))
        moved_twice = F.when(F.col("key") % 20 == 0, F.pmod(F.col("c_nationkey") + 2, F.lit(25))).otherwise(moved)
        base = customers.select("key", "c_nationkey", _id("CUST", "key").alias("customer_id"), F.col("c_name").alias("name"))
        accounts = self.table("supplier").select(
            F.col("s_suppkey").alias("key"),
            F.col("s_nationkey").alias("_nation"),
            _id("CUSTS", "s_suppkey").alias("customer_id"),
            F.col("s_name").alias("name"),
        )
        return (
            taken(base.withColumn("_nation", moved), datetime(2002, 1, 15))
            .unionByName(taken(base.withColumn("_nation", moved_twice), SNAPSHOT_AT))
            .unionByName(taken(accounts, datetime(2002, 1, 15)))
            .unionByName(taken(accounts.withColumn("_nation", F.pmod(F.col("_nation") + 1, F.lit(25))), SNAPSHOT_AT))
        )

    @cached_property
    def raw_products(self) -> DataFrame:
        return self.table("part").select(
            _id("P", "p_partkey").alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.col("p_brand").alias("brand"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("base_price"),
        )

    @cached_property
    def raw_stores(self) -> DataFrame:
        nations = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("city"))
        return (
            self.table("supplier")
            .join(nations, "s_nationkey")
            .select(_id("ST", "s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"), "city")
        )

    @cached_property
    def raw_inventory(self) -> DataFrame:
        """Month-end stock of every (part, supplier) that was ever sold; a few parts are unknown."""
        pairs = self.table("lineitem").select("l_partkey", "l_suppkey").distinct()
        days = F.array(*(F.struct(F.lit(i + 1).alias("m"), F.lit(d).alias("date")) for i, d in enumerate(STOCK_DAYS)))
        part, supplier = F.col("l_partkey"), F.col("l_suppkey")
        return pairs.select("l_partkey", "l_suppkey", F.inline(days)).select(
            _id("ST", "l_suppkey").alias("store_id"),
            F.when((part + supplier) % 97 == 0, "P-UNKNOWN").otherwise(_id("P", "l_partkey")).alias("product_id"),
            "date",
            ((part * 7 + supplier * 13 + F.col("m") * 31) % 100).cast("int").alias("stock_level"),
        )

    @cached_property
    def raw_shipments(self) -> DataFrame:
        """One shipment per order line number; some are still underway."""
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber").distinct()
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("_day"))
        line = F.col("l_orderkey") + F.col("l_linenumber")
        transaction = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))

        def at(days: Column, hours: int) -> Column:
            midnight = F.date_add("_day", days.cast("int")).cast("timestamp")
            return F.timestamp_seconds(F.unix_seconds(midnight) + hours * 3600)

        underway = F.col("l_orderkey") % 61 == 8
        return lines.join(orders, "l_orderkey").select(
            F.concat(F.lit("SHP-"), transaction).alias("shipment_id"),
            transaction.alias("transaction_id"),
            at(F.lit(1), 18).alias("ship_date"),
            F.when(~underway, at(line % 10 + 2, 9)).alias("delivery_date"),
            F.when(underway, "In Transit").otherwise("Delivered").alias("status"),
        )

    def _orders_of(self, events: DataFrame) -> DataFrame:
        key, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
        products, stores = self.table("part").count(), self.table("supplier").count()
        return events.where(F.col("event_type") == "purchase").select(
            key.alias("order_id"),
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.concat(F.lit("P"), F.lpad((key % products).cast("string"), 12, "0")).alias("product_id"),
            F.concat(F.lit("ST"), F.lpad((key % stores).cast("string"), 12, "0")).alias("store_id"),
            (k % 3 + 1).cast("int").alias("quantity"),
            F.col("value").cast("decimal(12,2)").alias("price"),
            F.col("user_id").cast("string").alias("customer_id"),
            F.element_at(F.array(*(F.lit(p) for p in PAYMENTS)), (key % 4 + 1).cast("int")).alias("payment_method"),
            F.lit("events").alias("order_source"),
        )

    @cached_property
    def orders_batch(self) -> DataFrame:
        return self._orders_of(self.table("events"))

    def orders_stream(self) -> DataFrame:
        schema = self.table("events").schema
        # As a pattern, since the stream source takes a single file only where a pattern found it.
        stream = self.spark.readStream.schema(schema).parquet(f"{self.dir}/events.parque[t]")
        return self._orders_of(stream)

    # Cleaned data and star schema

    @cached_property
    def staged(self) -> DataFrame:
        return self.work.save(cleaning.staged(self.raw_transactions, AS_OF), "staged_transactions")

    @cached_property
    def cleaned(self) -> DataFrame:
        return cleaning.cleaned(self.staged)

    @cached_property
    def dim_date(self) -> DataFrame:
        return dimensions.dim_date(self.spark, *self.days)

    @cached_property
    def days(self) -> tuple[date, date]:
        """First and last day of the years that have orders."""
        first, last = self.table("orders").agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
        return date(first.year, 1, 1), date(last.year, 12, 31)

    @cached_property
    def dim_customer(self) -> DataFrame:
        return self.work.save(dimensions.dim_customer(self.raw_customers, OPENED, self.work), "dim_customer")

    @cached_property
    def dim_product(self) -> DataFrame:
        return self.work.save(dimensions.dim_product(self.raw_products, self.work), "dim_product")

    @cached_property
    def dim_store(self) -> DataFrame:
        return self.work.save(dimensions.dim_store(self.raw_stores, self.work, REGIONS), "dim_store")

    @cached_property
    def fact_sales(self) -> DataFrame:
        sales = facts.fact_sales(self.cleaned, self.dim_customer, self.dim_product, self.dim_store, self.dim_date)
        return self.work.save(sales, "fact_sales")

    @cached_property
    def fact_inventory(self) -> DataFrame:
        return self.work.save(facts.fact_inventory(self.raw_inventory, self.dim_product, self.dim_store), "fact_inventory")

    @cached_property
    def fact_shipments(self) -> DataFrame:
        return self.work.save(facts.fact_shipments(self.raw_shipments, self.fact_sales, self.dim_date), "fact_shipments")

    # Scores

    @cached_property
    def features(self) -> DataFrame:
        found = stockout.features(self.fact_sales, self.fact_inventory, self.dim_product, self.dim_store)
        return self.work.save(found, "features")

    @cached_property
    def scores(self) -> DataFrame:
        return self.work.save(stockout.score(stockout.train(self.features), self.features), "scores")

    @cached_property
    def rule_scores(self) -> DataFrame:
        return stockout.rule_score(self.features)

    @cached_property
    def decision_log(self) -> DataFrame:
        """Two days of rule decisions: the second day repeats the scan. Their rows are written once in order; the ids are added as they are read."""
        empty = self.spark.createDataFrame([], LOGS["ml_reasoning_log"])
        days = F.array(F.lit(datetime(2002, 1, 1)), F.lit(datetime(2002, 1, 2)))
        twice = self.rule_scores.withColumn("_at", F.explode(days))
        return stockout.log_rows(twice, F.col("_at"), empty, self.work)

    def landed_transactions(self) -> ingest.TableResult:
        """Raw sales split into valid and rejected ones under the folder ``landing``, once."""
        return self.once("landing", lambda: ingest.land(self.raw_transactions, TRANSACTION_RULE, self.work.location("landing"), AS_OF))

    def star(self) -> dict[str, DataFrame]:
        names = ("dim_date", "dim_customer", "dim_product", "dim_store", "fact_sales", "fact_inventory", "fact_shipments")
        return {name: getattr(self, name) for name in names}


_models: dict[tuple[str, str], RetailModel] = {}


def retail_model(spark: SparkSession, sf_dir: str) -> RetailModel:
    """The model of a data folder, shared by the queries of one application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _models:
        _models[key] = RetailModel(spark, sf_dir)
    return _models[key]
