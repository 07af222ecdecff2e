from datetime import date, datetime
from decimal import Decimal

import pytest
from conftest import rows

from shelfsight.operators import dimensions, kpi
from shelfsight.schemas import STAR

SALES = STAR["fact_sales"]


def sale(key, day, customer=1, product=1, store=1, quantity=1, revenue="10.0000"):
    return (key, day, customer, product, store, quantity, Decimal(revenue), Decimal("0.0000"))


@pytest.fixture
def dates(spark):
    return dimensions.dim_date(spark, date(2023, 12, 1), date(2024, 12, 31))


@pytest.fixture
def products(spark):
    return spark.createDataFrame([(i, f"P{i}", f"N{i}", "Toys", None, Decimal("5.00")) for i in (1, 2, 3, 4)], STAR["dim_product"])


def test_span_uses_days_not_key_differences(spark, dates, products):
    sales = spark.createDataFrame([sale("a", 20240228, quantity=4), sale("b", 20240301, quantity=4)], SALES)
    row = kpi.sales_velocity(sales, products).first()
    assert (row["sales_span_days"], row["days_sold"], row["avg_daily_sales"]) == (2, 2, 4.0)
    assert (row["first_sale_date"], row["last_sale_date"]) == (date(2024, 2, 28), date(2024, 3, 1))
    assert (row["projected_monthly_sales"], row["projected_annual_sales"]) == (120.0, 1460.0)


def test_movement_limits_are_exclusive(spark, products):
    per_day = {1: 11, 2: 10, 3: 3, 4: 2}
    sales = spark.createDataFrame([sale(str(p), 20240101, product=p, quantity=q) for p, q in per_day.items()], SALES)
    found = {r["product_id"]: r["movement_category"] for r in kpi.sales_velocity(sales, products).collect()}
    assert found == {"P1": "Fast Moving", "P2": "Medium Moving", "P3": "Medium Moving", "P4": "Slow Moving"}
    assert [r["product_id"] for r in kpi.sales_velocity(sales, products, top=2).collect()] == ["P1", "P2"]


def test_growth_and_season(spark, dates):
    sales = spark.createDataFrame(
        [sale("a", 20231231, revenue="100"), sale("b", 20240101, revenue="150"), sale("c", 20240901, revenue="0")], SALES
    )
    assert rows(kpi.monthly_revenue(sales, dates), "year", "month", "month_name", "prev_month_revenue", "revenue_growth_pct") == [
        (2023, 12, "December", None, None),
        (2024, 1, "January", 100.0, 50.0),
        (2024, 9, "September", 150.0, -100.0),
    ]
    assert [r["season"] for r in kpi.seasonal_demand(sales, dates).collect()] == ["Winter", "Winter", "Monsoon"]
    assert [r["revenue_share_pct"] for r in kpi.seasonal_demand(sales, dates).collect()] == [40.0, 60.0, 0.0]


def test_daily_and_last_days(spark, dates):
    sales = spark.createDataFrame([sale("a", 20240106, quantity=2), sale("b", 20240106), sale("c", 20240108)], SALES)
    daily = kpi.daily_revenue(sales, dates).collect()
    assert [(r["date"], r["day_type"], r["daily_revenue"], r["transaction_count"], r["total_units_sold"]) for r in daily] == [
        (date(2024, 1, 8), "Weekday", 10.0, 1, 1),
        (date(2024, 1, 6), "Weekend", 20.0, 2, 3),
    ]
    last = kpi.last_days_revenue(sales, dates, 30)
    assert [tuple(r) for r in last.collect()] == [("2024-01-08", 10.0), ("2024-01-06", 20.0)]
    assert kpi.revenue_headline(last).first().asDict() == {
        "total_revenue": 30.0,
        "avg_daily_revenue": 15.0,
        "revenue_trend_pct": -50.0,
    }
    assert rows(kpi.daily_bars(last)) == [("2024-01-06", 20.0, 100.0, True), ("2024-01-08", 10.0, 50.0, False)]
    one = kpi.last_days_revenue(sales, dates, 1)
    assert kpi.revenue_headline(one).first()["revenue_trend_pct"] == 0.0
    assert kpi.revenue_headline(one.limit(0)).first()["total_revenue"] == 0.0


def test_new_and_returning(spark, dates):
    sales = spark.createDataFrame(
        [sale("a", 20240101, 1), sale("b", 20240101, 1), sale("c", 20240101, 2), sale("d", 20240102, 1), sale("e", 20240102, 3)],
        SALES,
    )
    assert rows(kpi.new_vs_returning(sales, dates)) == [
        (date(2024, 1, 1), 2, 2, 0, 30.0, 100.0, 0.0),
        (date(2024, 1, 2), 2, 1, 1, 20.0, 50.0, 50.0),
    ]


@pytest.mark.parametrize(
    "count,revenue,frequency,value",
    [
        (1, "999", "One-time", "Low Value"),
        (2, "1000", "Occasional", "Medium Value"),
        (5, "4999", "Occasional", "Medium Value"),
        (6, "5000", "Regular", "High Value"),
        (15, "19999", "Regular", "High Value"),
        (16, "20000", "Loyal", "Premium"),
    ],
)
def test_customer_segments(spark, count, revenue, frequency, value):
    customers = spark.createDataFrame(
        [(1, "C1", "Ann", None, None, "Mumbai", datetime(2024, 1, 1), None, True, 1)], STAR["dim_customer"]
    )
    sales = [sale("x", 20240101, revenue=revenue)] + [sale(str(i), 20240131, revenue="0") for i in range(count - 1)]
    row = kpi.customer_distribution(spark.createDataFrame(sales, SALES), customers).first()
    assert (row["city_tier"], row["purchase_frequency_segment"], row["value_segment"]) == ("Metro", frequency, value)
    assert row["customer_lifespan_days"] == (30.0 if count > 1 else 0.0)


def test_city_sales_and_derived_shares(spark):
    stores = spark.createDataFrame(
        [(1, "S1", "a", "Pune", "West"), (2, "S2", "b", "Pune", "West"), (3, "S3", "c", "Delhi", "North")], STAR["dim_store"]
    )
    sales = spark.createDataFrame(
        [sale("a", 20240101, store=1, revenue="30"), sale("b", 20240101, store=2, revenue="30"), sale("c", 20240101, store=3, revenue="40")],
        SALES,
    )
    cities = kpi.city_sales(sales, stores)
    assert rows(cities, "city", "active_stores", "total_revenue", "revenue_share_pct") == [
        ("Delhi", 1, 40.0, 40.0),
        ("Pune", 2, 60.0, 60.0),
    ]
    assert rows(kpi.city_bars(cities), "city", "pct_of_max") == [("Delhi", 66.67), ("Pune", 100.0)]


def test_turnover_without_stock_is_null(spark, products):
    inventory = spark.createDataFrame([(None, 20240101, 1, 1, 0, 20), (None, 20240101, 2, 1, 4, 20)], STAR["fact_inventory"])
    sales = spark.createDataFrame([sale("a", 20240101, product=1), sale("b", 20240101, product=2, quantity=6)], SALES)
    assert [(r["product_id"], r["inventory_turnover_ratio"]) for r in kpi.inventory_turnover(sales, inventory, products).collect()] == [
        ("P2", 1.5),
        ("P1", None),
    ]


def test_delivery(spark, dates):
    shipments = spark.createDataFrame(
        [("a", 20240105, 1, 1, 3.0, True), ("b", 20240120, 1, 1, 8.0, False), ("c", 20240120, 1, 1, None, False)],
        STAR["fact_shipments"],
    )
    assert rows(kpi.delivery_performance(shipments, dates)) == [(datetime(2024, 1, 1), 3, 5.5, 3.0, 8.0, 33.33)]


def test_summary_formats_money(spark):
    sales = spark.createDataFrame([sale("a", 20240101, revenue="12345678.1250"), sale("b", 20240102, customer=2, revenue="0")], SALES)
    found = {r["metric"]: (r["value"], r["formatted_value"]) for r in kpi.quick_summary(sales).collect()}
    assert found["Total Revenue"] == (12345678.125, "₹12345678.13")
    assert found["Total Customers"] == (2.0, "2") and found["Total Stores"] == (1.0, "1")
