from datetime import datetime
from decimal import Decimal

from conftest import rows

from shelfsight.operators import cleaning

AS_OF = datetime(2024, 7, 1)
SCHEMA = (
    "transaction_id string, date string, store_id string, customer_id string, product_id string, quantity int, "
    "price decimal(12,2), payment_method string, discount decimal(18,4)"
)


def line(key, day="2024-01-05", store="S", customer="C", product="P", quantity=1, price="10.00", pay="Cash", discount="1.0000"):
    return (key, day, store, customer, product, quantity, Decimal(price), pay, None if discount is None else Decimal(discount))


RAW = [
    line("T1"),
    line("T1", day="2024-01-04", price="12.00"),
    line("T2", discount=None),
    line("T3", store=None),
    line(None),
    line(None, product="Q"),
    line("T4", price="-5.00"),
    line("T5", quantity=0),
    line("T6", quantity=None),
    line("T7", day="2025-01-01"),
    line("T8", day="nonsense"),
    line("T9", customer=None),
]


def staged(raw):
    return cleaning.staged(raw, AS_OF)


def report_of(raw):
    return {r["metric"]: r["value"] for r in cleaning.report(raw, staged(raw)).collect()}


def test_steps_and_report(spark):
    raw = spark.createDataFrame(RAW, SCHEMA)
    report = report_of(raw)
    assert report == {
        "initial_rows": 12.0,
        "duplicates_removed": 2.0,
        "nulls_fixed": 1.0,
        "critical_rows_removed": 2.0,
        "invalid_values_fixed": 1.0,
        "invalid_quantity_removed": 2.0,
        "future_rows_removed": 2.0,
        "anomalies_flagged": 0.0,
        "final_rows": 4.0,
        "retention_rate": 33.33,
    }
    removed = ("duplicates_removed", "critical_rows_removed", "invalid_quantity_removed", "future_rows_removed")
    assert report["initial_rows"] - sum(report[r] for r in removed) == report["final_rows"]
    assert rows(cleaning.cleaned(staged(raw)), "transaction_id", "price", "discount") == [
        ("T1", Decimal("12.00"), Decimal("1.0000")),
        ("T2", Decimal("10.00"), Decimal("0.0000")),
        ("T4", Decimal("5.00"), Decimal("1.0000")),
        ("T9", Decimal("10.00"), Decimal("1.0000")),
    ]


def test_declared_order_decides_which_copy_is_first(spark):
    raw = spark.createDataFrame(RAW[:2], SCHEMA)
    assert rows(cleaning.staged(raw, AS_OF, order_by=["price"]), "price") == [(Decimal("10.00"),)]
    assert rows(staged(raw), "price") == [(Decimal("12.00"),)]


def test_absent_discount_column(spark):
    raw = spark.createDataFrame(RAW, SCHEMA).drop("discount")
    assert report_of(raw)["nulls_fixed"] == 0.0
    assert {r["discount"] for r in cleaning.cleaned(staged(raw)).collect()} == {Decimal("0.0000")}


def test_anomalies_are_flagged_and_kept(spark):
    data = [line(f"T{i}") for i in range(30)] + [line("X", price="900.00")]
    kept = cleaning.cleaned(staged(spark.createDataFrame(data, SCHEMA)))
    assert kept.count() == 31
    assert [r["transaction_id"] for r in kept.where("is_anomaly").collect()] == ["X"]


def test_empty_input(spark):
    raw = spark.createDataFrame([], SCHEMA)
    assert cleaning.cleaned(staged(raw)).count() == 0
    report = report_of(raw)
    assert report["initial_rows"] == 0.0 and report.get("retention_rate") is None


def test_many_copies_are_cut_before_the_shuffle(spark):
    plan = staged(spark.createDataFrame(RAW, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[exchange:]
