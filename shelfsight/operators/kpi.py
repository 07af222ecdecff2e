"""Business questions over the star schema.

Facts are aggregated to the key of the question first (day, store, product, customer) and only the
small result is joined with its dimension. Distinct counts become counts over an earlier grouping, and
totals over everything are scalar subqueries, so no step gathers the data in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E

ALL_MOVEMENT = (10.0, 2.0)
FREQUENCY = ((1, "One-time"), (5, "Occasional"), (15, "Regular"))
VALUE = ((1000, "Low Value"), (5000, "Medium Value"), (20000, "High Value"))


def _measures() -> list[Column]:
    return [
        F.sum("revenue").alias("_revenue"),
        F.count("sale_id").alias("transaction_count"),
        F.sum("quantity").cast("bigint").alias("total_units_sold"),
    ]


def _remeasure() -> list[Column]:
    return [
        F.sum("_revenue").alias("_revenue"),
        F.sum("transaction_count").cast("bigint").alias("transaction_count"),
        F.sum("total_units_sold").cast("bigint").alias("total_units_sold"),
    ]


def _revenue(name: str) -> Column:
    return F.col("_revenue").cast("double").alias(name)


def _mean_sale(name: str = "avg_transaction_value") -> Column:
    return E.ratio(F.col("_revenue"), F.col("transaction_count")).alias(name)


def _overall(grouped: DataFrame) -> Column:
    """Sums of all measures over a grouping, as one struct.

    All measures are asked for, although a share needs one: the subquery then has the plan of the
    grouping itself, and Spark reuses its shuffle instead of reading the facts a second time.
    """
    return grouped.agg(F.struct(*_remeasure())).scalar()


def daily_revenue(sales: DataFrame, dates: DataFrame) -> DataFrame:
    """Revenue, sales and units per calendar day, newest first."""
    return (
        sales.groupBy("date_key")
        .agg(*_measures())
        .join(dates, "date_key")
        .select(
            "date",
            "year",
            "month",
            "day",
            F.when(F.col("is_weekend"), "Weekend").otherwise("Weekday").alias("day_type"),
            F.when(F.col("is_holiday"), "Holiday").otherwise("Regular").alias("holiday_type"),
            "festival_name",
            _revenue("daily_revenue"),
            "transaction_count",
            _mean_sale(),
            "total_units_sold",
        )
        .orderBy(F.desc("date"))
    )


def last_days_revenue(sales: DataFrame, dates: DataFrame, days: int = 30) -> DataFrame:
    """Revenue of the newest days that have sales; the date as text."""
    return (
        sales.groupBy("date_key")
        .agg(F.sum("revenue").alias("_revenue"))
        .join(dates.select("date_key", "date"), "date_key")
        .orderBy(F.desc("date"))
        .limit(days)
        .select(F.col("date").cast("string").alias("date"), _revenue("revenue"))
    )


def _by_month(sales: DataFrame, dates: DataFrame) -> DataFrame:
    days = sales.groupBy("date_key").agg(*_measures())
    return days.join(dates.select("date_key", "year", "month"), "date_key").groupBy("year", "month").agg(*_remeasure())


def _with_growth(months: DataFrame, growth: str) -> DataFrame:
    """Previous month and growth. One row per calendar month is all this window ever sees."""
    before = F.lag("_revenue").over(Window.orderBy("year", "month"))
    return months.withColumn("_before", before).withColumn(
        growth, E.percent(F.col("_revenue") - F.col("_before"), F.col("_before"))
    )


def monthly_revenue(sales: DataFrame, dates: DataFrame) -> DataFrame:
    """Revenue per month with growth over the month before."""
    return (
        _with_growth(_by_month(sales, dates), "revenue_growth_pct")
        .select(
            "year",
            "month",
            E.month_name(F.col("month")).alias("month_name"),
            _revenue("monthly_revenue"),
            "transaction_count",
            _mean_sale(),
            "total_units_sold",
            F.col("_before").cast("double").alias("prev_month_revenue"),
            "revenue_growth_pct",
        )
        .orderBy("year", "month")
    )


def seasonal_demand(sales: DataFrame, dates: DataFrame) -> DataFrame:
    """Monthly revenue with its season, share of the total and growth."""
    months = _by_month(sales, dates)
    total = F.sum("_revenue").over(Window.partitionBy())
    return (
        _with_growth(months.withColumn("_total", total), "month_over_month_growth_pct")
        .select(
            "year",
            "month",
            E.month_name(F.col("month")).alias("month_name"),
            E.season_of(F.col("month")).alias("season"),
            _revenue("monthly_revenue"),
            "transaction_count",
            _mean_sale(),
            "total_units_sold",
            E.percent(F.col("_revenue"), F.col("_total")).alias("revenue_share_pct"),
            F.col("_before").cast("double").alias("prev_month_revenue"),
            "month_over_month_growth_pct",
        )
        .orderBy("year", "month")
    )


def city_sales(sales: DataFrame, stores: DataFrame) -> DataFrame:
    """Revenue, active stores and revenue share per city, highest revenue first.

    The total behind the share is a window over the cities, of which there are few.
    """
    cities = (
        sales.groupBy("store_key")
        .agg(*_measures())
        .join(stores.select("store_key", "city", "region"), "store_key")
        .groupBy("city", "region")
        .agg(F.count(F.lit(1)).alias("active_stores"), *_remeasure())
    )
    return cities.select(
        "city",
        "region",
        "active_stores",
        _revenue("total_revenue"),
        "transaction_count",
        _mean_sale(),
        "total_units_sold",
        E.percent(F.col("_revenue"), F.sum("_revenue").over(Window.partitionBy())).alias("revenue_share_pct"),
    ).orderBy(F.desc("total_revenue"), "city", "region")


def top_products(sales: DataFrame, products: DataFrame, top: int = 10) -> DataFrame:
    """Best products by revenue; shares are of the revenue of all products."""
    grouped = (
        sales.groupBy("product_key")
        .agg(*_measures())
        .join(products, "product_key")
        .groupBy("product_id", "name", "category", "brand", "price")
        .agg(*_remeasure())
    )
    best = grouped.orderBy(F.desc("_revenue"), "product_id").limit(top)
    rank = F.row_number().over(Window.orderBy(F.desc("_revenue"), "product_id"))
    return best.select(
        "product_id",
        F.col("name").alias("product_name"),
        "category",
        "brand",
        F.col("total_units_sold").alias("total_quantity_sold"),
        _revenue("total_revenue"),
        "transaction_count",
        _mean_sale("avg_revenue_per_transaction"),
        F.col("price").cast("double").alias("avg_product_price"),
        E.percent(F.col("_revenue"), _overall(grouped)["_revenue"]).alias("revenue_share_pct"),
        rank.cast("bigint").alias("revenue_rank"),
    ).orderBy("revenue_rank")


def sales_velocity(
    sales: DataFrame, products: DataFrame, movement: tuple[float, float] = ALL_MOVEMENT, top: int | None = None
) -> DataFrame:
    """Units per selling day of every product, its movement class and projections."""
    spans = (
        sales.groupBy("product_key", "date_key")
        .agg(F.sum("revenue").alias("_revenue"), F.sum("quantity").alias("_units"))
        .groupBy("product_key")
        .agg(
            F.sum("_units").cast("bigint").alias("total_sold"),
            F.sum("_revenue").alias("_revenue"),
            F.count(F.lit(1)).alias("days_sold"),
            F.min("date_key").alias("_first"),
            F.max("date_key").alias("_last"),
        )
    )
    fast, medium = movement
    daily = E.ratio(F.col("total_sold"), F.col("days_sold"))
    result = (
        spans.join(products, "product_key")
        .withColumn("first_sale_date", E.key_date(F.col("_first")))
        .withColumn("last_sale_date", E.key_date(F.col("_last")))
        .withColumn("avg_daily_sales", daily)
        .select(
            "product_id",
            F.col("name").alias("product_name"),
            "category",
            F.col("price").cast("double").alias("price"),
            "total_sold",
            _revenue("total_revenue"),
            "days_sold",
            "first_sale_date",
            "last_sale_date",
            "avg_daily_sales",
            F.datediff("last_sale_date", "first_sale_date").cast("bigint").alias("sales_span_days"),
            F.when(F.col("avg_daily_sales") > fast, "Fast Moving")
            .when(F.col("avg_daily_sales") > medium, "Medium Moving")
            .otherwise("Slow Moving")
            .alias("movement_category"),
            F.round(F.col("avg_daily_sales") * 30, 2).alias("projected_monthly_sales"),
            F.round(F.col("avg_daily_sales") * 365, 2).alias("projected_annual_sales"),
        )
        .orderBy(F.desc("avg_daily_sales"), "product_id")
    )
    return result if top is None else result.limit(top)


def inventory_turnover(
    sales: DataFrame, inventory: DataFrame, products: DataFrame, top: int | None = None
) -> DataFrame:
    """Units sold per unit of average stock, highest first."""
    stock = inventory.groupBy("product_key").agg(
        F.sum("stock_level").cast("bigint").alias("_stock"), F.count("stock_level").alias("_snapshots")
    )
    sold = sales.groupBy("product_key").agg(F.sum("quantity").cast("bigint").alias("total_units_sold"))
    mean = E.ratio(F.col("_stock"), F.col("_snapshots"))
    result = (
        sold.join(stock, "product_key")
        .join(products.select("product_key", "product_id", "name", "category"), "product_key")
        .select(
            "product_id",
            F.col("name").alias("product_name"),
            "category",
            "total_units_sold",
            F.round(mean, 2).alias("avg_stock_level"),
            F.round(E.ratio(F.col("total_units_sold"), mean), 2).alias("inventory_turnover_ratio"),
        )
        .orderBy(F.desc_nulls_last("inventory_turnover_ratio"), "product_id")
    )
    return result if top is None else result.limit(top)


def delivery_performance(shipments: DataFrame, dates: DataFrame) -> DataFrame:
    """Delivery days and share on time per month of dispatch, newest first."""
    days = shipments.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("delivery_time").alias("_days"),
        F.count("delivery_time").alias("_delivered"),
        F.min("delivery_time").alias("_min"),
        F.max("delivery_time").alias("_max"),
        F.count_if("on_time_flag").alias("_on_time"),
    )
    months = (
        days.join(dates.select("date_key", "date"), "date_key")
        .groupBy(F.trunc("date", "month").cast("timestamp_ntz").alias("delivery_month"))
        .agg(
            F.sum("_n").cast("bigint").alias("total_deliveries"),
            F.sum("_days").alias("_days"),
            F.sum("_delivered").alias("_delivered"),
            F.min("_min").alias("min_delivery_days"),
            F.max("_max").alias("max_delivery_days"),
            F.sum("_on_time").alias("_on_time"),
        )
    )
    return months.select(
        "delivery_month",
        "total_deliveries",
        F.round(E.ratio(F.col("_days"), F.col("_delivered")), 2).alias("avg_delivery_days"),
        "min_delivery_days",
        "max_delivery_days",
        E.percent(F.col("_on_time"), F.col("total_deliveries")).alias("on_time_pct"),
    ).orderBy(F.desc("delivery_month"))


def new_vs_returning(sales: DataFrame, dates: DataFrame) -> DataFrame:
    """Customers per day, split by whether the day is their first; newest day first."""
    visits = sales.groupBy("customer_key", "date_key").agg(F.sum("revenue").alias("_revenue"))
    # At most one row per calendar day and customer is left, so a hot customer's window stays small.
    first_day = F.min("date_key").over(Window.partitionBy("customer_key"))
    known = F.col("customer_key").isNotNull()
    by_day = (
        visits.withColumn("_first", first_day)
        .groupBy("date_key")
        .agg(
            F.count("customer_key").alias("total_customers"),
            F.count_if(known & (F.col("date_key") == F.col("_first"))).alias("new_customers"),
            F.count_if(known & (F.col("date_key") > F.col("_first"))).alias("returning_customers"),
            F.sum("_revenue").alias("_revenue"),
        )
    )
    return (
        by_day.join(dates.select("date_key", "date"), "date_key")
        .select(
            "date",
            "total_customers",
            "new_customers",
            "returning_customers",
            _revenue("total_revenue"),
            E.percent(F.col("new_customers"), F.col("total_customers")).alias("new_customer_pct"),
            E.percent(F.col("returning_customers"), F.col("total_customers")).alias("returning_customer_pct"),
        )
        .orderBy(F.desc("date"))
    )


def _segment(value: Column, steps: tuple[tuple[float, str], ...], top: str, inclusive: bool) -> Column:
    label = F.lit(top)
    for limit, name in reversed(steps):
        label = F.when(value <= limit if inclusive else value < limit, name).otherwise(label)
    return label


def customer_distribution(
    sales: DataFrame,
    customers: DataFrame,
    tiers: Mapping[str, str] = E.CITY_TIER,
    frequency: tuple[tuple[float, str], ...] = FREQUENCY,
    value: tuple[tuple[float, str], ...] = VALUE,
) -> DataFrame:
    """Customers, lifetime value and segments per city, highest revenue first."""
    per_customer = sales.groupBy("customer_key").agg(
        F.sum("revenue").alias("_revenue"),
        F.count("sale_id").alias("_sales"),
        F.min("date_key").alias("_first"),
        F.max("date_key").alias("_last"),
    )
    span = F.datediff(E.key_date(F.col("_last")), E.key_date(F.col("_first")))
    cities = (
        per_customer.join(customers.select("customer_key", "city"), "customer_key")
        .groupBy("city")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.sum("_revenue").alias("_revenue"),
            F.sum("_sales").cast("bigint").alias("total_transactions"),
            F.sum(span).cast("bigint").alias("_days"),
        )
    )
    mean_revenue = E.ratio(F.col("_revenue"), F.col("customer_count"))
    mean_sales = E.ratio(F.col("total_transactions"), F.col("customer_count"))
    return cities.select(
        "city",
        E.tier_of(F.col("city"), tiers).alias("city_tier"),
        "customer_count",
        _revenue("total_revenue"),
        mean_revenue.alias("avg_clv"),
        "total_transactions",
        E.ratio(F.col("_revenue"), F.col("total_transactions")).alias("avg_transaction_value"),
        E.ratio(F.col("_days"), F.col("customer_count")).alias("customer_lifespan_days"),
        _segment(mean_sales, frequency, "Loyal", True).alias("purchase_frequency_segment"),
        _segment(mean_revenue, value, "Premium", False).alias("value_segment"),
    ).orderBy(F.desc("total_revenue"), "city")


def quick_summary(sales: DataFrame) -> DataFrame:
    """Five headline figures as (metric, value, formatted_value).

    Every distinct count reads one column of its own; putting them in one aggregate would copy each
    row once per count before the shuffle.
    """
    totals = sales.agg(F.sum("revenue").alias("_revenue"), F.count("sale_id").alias("_sales"))
    revenue = totals.select(
        F.lit("Total Revenue").alias("metric"),
        F.col("_revenue").cast("double").alias("value"),
        F.concat(F.lit("₹"), F.round("_revenue", 2).cast("decimal(38,2)").cast("string")).alias("formatted_value"),
    )

    def counted(metric: str, df: DataFrame, count: Column) -> DataFrame:
        return df.agg(count.alias("_n")).select(
            F.lit(metric).alias("metric"),
            F.col("_n").cast("double").alias("value"),
            F.col("_n").cast("string").alias("formatted_value"),
        )

    result = revenue.unionByName(counted("Total Transactions", sales, F.count("sale_id")))
    for metric, key in (
        ("Total Customers", "customer_key"),
        ("Total Products", "product_key"),
        ("Total Stores", "store_key"),
    ):
        result = result.unionByName(counted(metric, sales, F.count_distinct(key)))
    return result


# Figures the dashboards derive from the results above.


def revenue_headline(last_days: DataFrame) -> DataFrame:
    """Total and mean over the listed days, and the newest day against the one before in percent."""
    rows = last_days.agg(
        F.sum("revenue").alias("total_revenue"),
        F.avg("revenue").alias("avg_daily_revenue"),
        F.reverse(F.array_sort(F.collect_list(F.struct("date", "revenue")))).alias("_days"),
    )
    latest = F.coalesce(F.get("_days", F.lit(0))["revenue"], F.lit(0.0))
    before = F.coalesce(F.get("_days", F.lit(1))["revenue"], F.lit(0.0))
    return rows.select(
        F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
        F.coalesce("avg_daily_revenue", F.lit(0.0)).alias("avg_daily_revenue"),
        F.when(before > 0, F.try_divide(latest - before, before) * 100).otherwise(F.lit(0.0)).alias(
            "revenue_trend_pct"
        ),
    )


def dashboard_totals(cities: DataFrame, customers: DataFrame) -> DataFrame:
    """Cities, stores and customers over the city and customer results."""
    return cities.agg(
        F.count(F.lit(1)).alias("total_cities"),
        F.coalesce(F.sum("active_stores"), F.lit(0)).cast("bigint").alias("total_stores"),
        F.coalesce(customers.agg(F.sum("customer_count")).scalar(), F.lit(0)).cast("bigint").alias("total_customers"),
    )


def daily_bars(last_days: DataFrame, shown: int = 10) -> DataFrame:
    """Each listed day as percent of the best listed day, and whether it beats their mean."""
    listed = Window.partitionBy()
    return (
        last_days.withColumn("pct_of_max", F.round(F.col("revenue") / F.max("revenue").over(listed) * 100, 2))
        .withColumn("is_above_avg", F.col("revenue") > F.avg("revenue").over(listed))
        .orderBy(F.desc("date"))
        .limit(shown)
    )


def city_bars(cities: DataFrame, shown: int = 8) -> DataFrame:
    """Best cities with their revenue as percent of the best one."""
    best = F.max("total_revenue").over(Window.partitionBy())
    return (
        cities.select(
            "city",
            "region",
            "total_revenue",
            F.round(F.col("total_revenue") / best * 100, 2).alias("pct_of_max"),
        )
        .orderBy(F.desc("total_revenue"), "city", "region")
        .limit(shown)
    )


def city_shares(customers: DataFrame, shown: int = 6) -> DataFrame:
    """Share of all customers and of all revenue per city, for the first cities."""
    everyone = F.sum("customer_count").over(Window.partitionBy())
    revenue = F.sum("total_revenue").over(Window.partitionBy())
    return (
        customers.select(
            "city",
            "customer_count",
            "total_revenue",
            E.percent(F.col("customer_count"), everyone).alias("customer_pct"),
            E.percent(F.col("total_revenue"), revenue).alias("revenue_pct"),
        )
        .orderBy(F.desc("total_revenue"), "city")
        .limit(shown)
    )
