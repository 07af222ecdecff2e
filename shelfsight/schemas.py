"""Explicit schemas: raw inputs, star tables and operational logs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

MONEY = "decimal(18,4)"
PRICE = "decimal(12,2)"


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
    PRICE: T.DecimalType(12, 2),
    MONEY: T.DecimalType(18, 4),
}


def _struct(columns: str) -> T.StructType:
    """Schema from "name type, name type"; needs no running session."""
    pairs = (column.split() for column in columns.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


RAW = {
    "stores": _struct("store_id string, store_name string, city string, opened_date date"),
    "customers": _struct(
        "customer_id string, name string, email string, phone string, city string, age int, registration_date date"
    ),
    "products": _struct(
        f"product_id string, product_name string, category string, base_price {PRICE}, cost_price {PRICE}"
    ),
    "transactions": _struct(
        "transaction_id string, date string, store_id string, customer_id string, product_id string, "
        f"quantity int, price {PRICE}, payment_method string"
    ),
    # The file header names the columns in another order than the data holds them; this is the data order.
    "inventory": _struct("store_id string, product_id string, date string, stock_level int"),
    "shipments": _struct(
        "shipment_id string, transaction_id string, ship_date timestamp, delivery_date timestamp, "
        "status string, courier string"
    ),
    "web_clickstream": _struct(
        "session_id string, timestamp timestamp, event_type string, product_id string, user_id string, device string"
    ),
}

# Columns a raw input may have beyond those above.
OPTIONAL = {"transactions": _struct(f"discount {MONEY}"), "products": _struct("brand string")}

STAR = {
    "dim_date": _struct(
        "date_key int, date date, year int, month int, day int, is_weekend boolean, is_holiday boolean, "
        "festival_name string"
    ),
    "dim_customer": _struct(
        "customer_key bigint, customer_id string, name string, email string, phone string, city string, "
        "valid_from timestamp, valid_to timestamp, is_current boolean, version int"
    ),
    "dim_product": _struct(
        f"product_key bigint, product_id string, name string, category string, brand string, price {PRICE}"
    ),
    "dim_store": _struct("store_key bigint, store_id string, store_name string, city string, region string"),
    "dim_external_events": _struct(
        "event_id bigint, event_name string, event_date date, region string, demand_impact double"
    ),
    "fact_sales": _struct(
        "sale_id string, date_key int, customer_key bigint, product_key bigint, store_key bigint, quantity int, "
        f"revenue {MONEY}, discount {MONEY}"
    ),
    "fact_inventory": _struct(
        "inventory_id bigint, date_key int, product_key bigint, store_key bigint, stock_level int, reorder_point int"
    ),
    "fact_shipments": _struct(
        "shipment_id string, date_key int, product_key bigint, store_key bigint, delivery_time double, "
        "on_time_flag boolean"
    ),
}

LOGS = {
    "streaming_orders": _struct(
        f"order_id bigint, timestamp timestamp, product_id string, store_id string, quantity int, price {PRICE}, "
        "customer_id string, payment_method string, order_source string"
    ),
    "ml_alerts": _struct(
        "timestamp timestamp, product_id string, store_id string, risk_level string, confidence double, "
        "recommended_reorder int"
    ),
    "ml_reasoning_log": _struct(
        "id bigint, timestamp timestamp, model_name string, product_id string, store_id string, prediction double, "
        "confidence double, explanation_json string"
    ),
    "schema_change_log": _struct(
        "batch_id string, change_id bigint, table_name string, change_type string, column_name string, "
        "old_value string, new_value string, confidence_score double, status string, detected_at timestamp, "
        "approved_at timestamp, approved_by string, affected_rows int, sample_data string"
    ),
    "schema_approval_queue": _struct(
        "queue_id bigint, batch_id string, table_name string, action string, reason string, decision_json string, "
        "status string, created_at timestamp"
    ),
    "schema_decisions": _struct("queue_id bigint, status string, decided_at timestamp"),
    "run_events": _struct(
        "run_id bigint, pipeline_name string, event_time timestamp, status string, rows_processed bigint, "
        "rows_quarantined bigint, error_message string"
    ),
    "pipeline_metrics": _struct("run_id bigint, metric_name string, metric_value double, timestamp timestamp"),
    "quarantine_log": _struct("table_name string, quarantine_reason string, timestamp timestamp"),
}

# What the live feed stores.
FEED = {
    "orders": LOGS["streaming_orders"],
    "alerts": _struct(
        "order_id bigint, timestamp timestamp, product_id string, store_id string, risk_level string, confidence double, "
        "recommended_reorder int"
    ),
    "messages": _struct("order_id bigint, timestamp timestamp, body string"),
}

EXPLANATION = _struct(
    "risk_level string, ml_confidence double, current_stock double, avg_daily_demand double, volatility_cv double"
)


@dataclass(frozen=True)
class TableRule:
    """Which columns a logical table must have and may have."""

    name: str
    required: tuple[str, ...] = ()
    optional: tuple[str, ...] = ()

    @property
    def known(self) -> frozenset[str]:
        return frozenset(self.required) | frozenset(self.optional)


@dataclass(frozen=True)
class Registry:
    """Logical tables by name."""

    rules: dict[str, TableRule] = field(default_factory=dict)

    @classmethod
    def of(cls, *rules: TableRule) -> "Registry":
        return cls({rule.name: rule for rule in rules})

    def rule(self, table: str) -> TableRule:
        if table not in self.rules:
            raise ValueError(f"no rule registered for table {table!r}")
        return self.rules[table]


def optional_names(table: str) -> list[str]:
    return OPTIONAL[table].names if table in OPTIONAL else []


def raw_fields(table: str) -> list[T.StructField]:
    """All columns a raw input is known to have or may have."""
    extra = OPTIONAL[table].fields if table in OPTIONAL else []
    return [*RAW[table].fields, *extra]


def default_registry() -> Registry:
    """Every column of the raw schema known, the identifying ones required."""
    required = {
        "stores": ("store_id",),
        "customers": ("customer_id",),
        "products": ("product_id",),
        "transactions": ("transaction_id", "product_id", "store_id", "date", "quantity", "price"),
        "inventory": ("store_id", "product_id", "date"),
        "shipments": ("shipment_id", "transaction_id"),
        "web_clickstream": ("session_id", "timestamp"),
    }
    return Registry.of(
        *(
            TableRule(
                name,
                required[name],
                tuple(c for c in [*schema.names, *optional_names(name)] if c not in required[name]),
            )
            for name, schema in RAW.items()
        )
    )
