"""Every operator as a query over a data folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import basket, cleaning, dimensions, facts, governance, ingest, kpi, ops, scd, secure, stockout
from ..schemas import FEED, LOGS, RAW, STAR, Registry, TableRule, raw_fields
from ..sources import files
from ..sources.tables import Log, PartedTable, VersionedTable
from ..streaming import orders as live
from ..streaming import visits
from .flow import Warehouse, resume_batch, run_batch, schema_changes
from .flow import requests as approval_requests
from .model import (
    AS_OF,
    FREQUENCY,
    MOVEMENT,
    REGIONS,
    SNAPSHOT_AT,
    TIERS,
    TRANSACTION_RULE,
    VALUE,
    RetailModel,
    retail_model,
)

Query = Callable[[SparkSession, str], DataFrame]
DETECTED = datetime(2002, 1, 2)
DECIDED = datetime(2002, 1, 3)
STREAM_DELAY = "40 days"
DAY = 19980302

_queries: dict[str, Query] = {}


def query(function: Callable[[RetailModel], DataFrame]) -> Callable[[RetailModel], DataFrame]:
    """Register a function of the model under its own name."""
    _queries[function.__name__] = lambda spark, sf_dir: function(retail_model(spark, sf_dir))
    return function


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def _as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# KPIs


@query
def k1_daily_revenue(m: RetailModel) -> DataFrame:
    return kpi.daily_revenue(m.fact_sales, m.dim_date)


@query
def k1a_last_30_days(m: RetailModel) -> DataFrame:
    return kpi.last_days_revenue(m.fact_sales, m.dim_date)


@query
def k2_monthly_growth(m: RetailModel) -> DataFrame:
    return kpi.monthly_revenue(m.fact_sales, m.dim_date)


@query
def k3_city_sales(m: RetailModel) -> DataFrame:
    return kpi.city_sales(m.fact_sales, m.dim_store)


@query
def k4_top_products(m: RetailModel) -> DataFrame:
    return kpi.top_products(m.fact_sales, m.dim_product)


@query
def k5_velocity(m: RetailModel) -> DataFrame:
    return kpi.sales_velocity(m.fact_sales, m.dim_product, MOVEMENT)


@query
def k5_stockout_top20(m: RetailModel) -> DataFrame:
    return kpi.sales_velocity(m.fact_sales, m.dim_product, MOVEMENT, top=20)


@query
def k6_turnover(m: RetailModel) -> DataFrame:
    return kpi.inventory_turnover(m.fact_sales, m.fact_inventory, m.dim_product)


@query
def k6_turnover_top20(m: RetailModel) -> DataFrame:
    return kpi.inventory_turnover(m.fact_sales, m.fact_inventory, m.dim_product, top=20)


@query
def k7_delivery(m: RetailModel) -> DataFrame:
    return kpi.delivery_performance(m.fact_shipments, m.dim_date)


@query
def k8_seasonal(m: RetailModel) -> DataFrame:
    return kpi.seasonal_demand(m.fact_sales, m.dim_date)


@query
def k9_new_vs_returning(m: RetailModel) -> DataFrame:
    return kpi.new_vs_returning(m.fact_sales, m.dim_date)


@query
def k10_clv(m: RetailModel) -> DataFrame:
    return kpi.customer_distribution(m.fact_sales, m.dim_customer, TIERS, FREQUENCY, VALUE)


@query
def k11_basket(m: RetailModel) -> DataFrame:
    return basket.product_pairs(m.fact_sales, m.dim_product, m.work)


@query
def k11_large_baskets(m: RetailModel) -> DataFrame:
    """What the suppliers of a nation sold in a year as one basket, of hundreds of products and more."""
    lines = m.table("lineitem").join(m.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = lines.join(m.table("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").cast("bigint").alias("customer_key"), F.year("o_orderdate").alias("date_key"), F.col("l_partkey").alias("product_key")
    )
    products = m.table("part").select(F.col("p_partkey").alias("product_key"), F.col("p_name").alias("product_id"))
    return basket.product_pairs(sold, products, m.work)


@query
def k12_summary(m: RetailModel) -> DataFrame:
    return kpi.quick_summary(m.fact_sales)


@query
def k13_ai_decisions(m: RetailModel) -> DataFrame:
    return stockout.decision_feed(m.decision_log)


@query
def k14_headline(m: RetailModel) -> DataFrame:
    headline = kpi.revenue_headline(k1a_last_30_days(m))
    return _rounded(_rounded(headline, 4, "total_revenue", "avg_daily_revenue"), 6, "revenue_trend_pct")


@query
def k15_totals(m: RetailModel) -> DataFrame:
    return kpi.dashboard_totals(k3_city_sales(m), k10_clv(m))


@query
def k16_daily_bars(m: RetailModel) -> DataFrame:
    return kpi.daily_bars(k1a_last_30_days(m))


@query
def k17_city_bars(m: RetailModel) -> DataFrame:
    return kpi.city_bars(k3_city_sales(m))


@query
def k18_city_shares(m: RetailModel) -> DataFrame:
    return kpi.city_shares(k10_clv(m))


@query
def k19_stockout_top10(m: RetailModel) -> DataFrame:
    return kpi.sales_velocity(m.fact_sales, m.dim_product, MOVEMENT, top=10)


@query
def k19_pairs_top10(m: RetailModel) -> DataFrame:
    return basket.product_pairs(m.fact_sales, m.dim_product, m.work, top=10)


# Cleaning and validation


@query
def c_clean(m: RetailModel) -> DataFrame:
    return _as_double(m.cleaned.withColumn("date", F.to_date("date")), "price", "discount")


@query
def c_first_copy(m: RetailModel) -> DataFrame:
    """Events as sales that come twice, once without a store: the copy that stands first counts."""
    key = F.col("event_id")
    raw = m.table("events").select(
        F.concat(F.lit("T"), F.floor(key / 2).cast("string")).alias("transaction_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.when(key % 3 != 0, F.concat(F.lit("ST"), F.col("user_id").cast("string"))).alias("store_id"),
        F.concat(F.lit("P"), (key % 10).cast("string")).alias("product_id"),
        (key % 4 + 1).cast("int").alias("quantity"),
        F.col("value").cast("decimal(12,2)").alias("price"),
        key.alias(files.POSITION),
    )
    return cleaning.staged(raw, datetime(2030, 1, 1)).select("transaction_id", "store_id", "product_id", "quantity", "is_complete")


@query
def c_report(m: RetailModel) -> DataFrame:
    return cleaning.report(m.raw_transactions, m.staged)


@query
def v_valid(m: RetailModel) -> DataFrame:
    return _as_double(ingest.valid_rows(m.raw_transactions, TRANSACTION_RULE), "price", "discount")


@query
def v_quarantine(m: RetailModel) -> DataFrame:
    return _as_double(ingest.quarantined_rows(m.raw_transactions, TRANSACTION_RULE), "price", "discount")


@query
def v_counts(m: RetailModel) -> DataFrame:
    """Counted while the rows are written."""
    return ingest.counts_table(m.spark, [m.landed_transactions()])


@query
def v_missing_column(m: RetailModel) -> DataFrame:
    return ingest.reason_counts(m.raw_transactions, TableRule("transactions", ("store_id", "currency")))


# Schema governance: lines with their order and part attributes arrive as unregistered columns


def _drift_batch(m: RetailModel) -> DataFrame:
    orders = m.table("orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
        F.col("o_orderstatus").alias("order_status"),
    )
    parts = m.table("part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_size").alias("part_size"),
        F.col("p_name").alias("part_label"),
        F.col("p_brand").alias("part_brand"),
    )
    return (
        m.table("lineitem")
        .join(orders, "l_orderkey")
        .join(parts, "l_partkey")
        .select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("store_id"),
            F.col("l_returnflag").alias("return_flag"),
            F.col("l_tax").alias("tax_rate"),
            "priority",
            "order_status",
            F.col("l_shipdate").alias("shipped_at"),
            F.col("l_linestatus").alias("line_status"),
            "part_size",
            "part_label",
            "part_brand",
        )
    )


_DRIFT_RULE = TableRule("transactions", ("transaction_id", "product_id", "store_id"))
_DRIFT_ORDER = ["transaction_id", "product_id", "store_id"]


def _landed_batch(m: RetailModel) -> DataFrame:
    return m.once("drift_batch", lambda: m.work.save(_drift_batch(m), "drift_batch"))


def _governed(m: RetailModel) -> tuple[Log, Log]:
    """Change log and approval queue after the batch went through governance."""

    def run() -> tuple[Log, Log]:
        outcome = governance.process(
            "transactions", _landed_batch(m), Registry.of(_DRIFT_RULE), _DRIFT_ORDER, "batch-1", DETECTED, m.work
        )
        changes = Log(m.spark, m.work.fresh("schema_change_log"), LOGS["schema_change_log"])
        queue = Log(m.spark, m.work.fresh("schema_approval_queue"), LOGS["schema_approval_queue"])
        changes.append(outcome.log)
        queue.append(outcome.queue)
        return changes, queue

    return m.once("governed", run)


def _change_log(m: RetailModel) -> DataFrame:
    return _governed(m)[0].read()


def _queue(m: RetailModel) -> DataFrame:
    return _governed(m)[1].read()


def _decisions(queue: DataFrame) -> DataFrame:
    return queue.select("queue_id", F.lit("approved").alias("status"), F.lit(DECIDED).alias("decided_at"))


@query
def v_drift_scores(m: RetailModel) -> DataFrame:
    changes = governance.column_changes(_landed_batch(m), _DRIFT_RULE, _DRIFT_ORDER)
    return _rounded(changes.withColumn("sample_values", F.array_join("sample_values", "|")), 6, "confidence")


@query
def v_decision(m: RetailModel) -> DataFrame:
    return governance.decide(governance.column_changes(_landed_batch(m), _DRIFT_RULE, _DRIFT_ORDER))


@query
def v_change_log(m: RetailModel) -> DataFrame:
    log = _change_log(m)
    kept = ("table_name", "change_type", "column_name", "old_value", "new_value", "confidence_score", "status", "affected_rows")
    return _rounded(log.select(*kept), 6, "confidence_score")


@query
def v_queue_expanded(m: RetailModel) -> DataFrame:
    expanded = governance.expand_decision(_queue(m))
    samples = F.array_join("sample_values", "|").alias("sample_values")
    return _rounded(expanded.select("type", "column", "confidence", "data_type", samples), 6, "confidence")


@query
def v_pending(m: RetailModel) -> DataFrame:
    return governance.pending_requests(_queue(m)).select("table_name", "action", "reason")


@query
def v_approved(m: RetailModel) -> DataFrame:
    resolved = governance.resolve_changes(_change_log(m), _queue(m), _decisions(_queue(m)))
    return resolved.select("column_name", "status", "approved_by", "approved_at")


@query
def v_history(m: RetailModel) -> DataFrame:
    return _rounded(governance.change_history(_change_log(m), 20), 6, "confidence_score")


@query
def v_summary(m: RetailModel) -> DataFrame:
    return governance.change_summary(_change_log(m))


# Warehouse


@query
def d_dim_date(m: RetailModel) -> DataFrame:
    return m.dim_date


@query
def d_dim_customer(m: RetailModel) -> DataFrame:
    return m.dim_customer


@query
def d_dim_product(m: RetailModel) -> DataFrame:
    return _as_double(m.dim_product, "price")


@query
def d_dim_store(m: RetailModel) -> DataFrame:
    return m.dim_store


@query
def d_store_regions(m: RetailModel) -> DataFrame:
    return dimensions.store_region_counts(m.dim_store)


@query
def d_fact_sales(m: RetailModel) -> DataFrame:
    return _as_double(m.fact_sales, "revenue", "discount")


@query
def d_fact_inventory(m: RetailModel) -> DataFrame:
    return m.fact_inventory.drop("inventory_id")


@query
def d_fact_shipments(m: RetailModel) -> DataFrame:
    return m.fact_shipments


@query
def d_unmatched(m: RetailModel) -> DataFrame:
    return facts.unmatched_shipments(m.raw_shipments, m.fact_sales, m.dim_date)


@query
def d_unresolved_inventory(m: RetailModel) -> DataFrame:
    return facts.unresolved_inventory(m.raw_inventory, m.dim_product, m.dim_store)


@query
def d_row_counts(m: RetailModel) -> DataFrame:
    tables = m.star()
    facts.verify_columns(tables, {name: STAR[name].names for name in tables})
    return facts.row_counts(tables)


# Customer history


def _newest(m: RetailModel) -> DataFrame:
    newest = files.latest_per_key(m.customer_snapshots, "customer_id", "snapshot_ts").drop("snapshot_ts")
    return m.once("newest", lambda: m.work.save(newest, "newest_customers"))


def _extended(m: RetailModel) -> DataFrame:
    """The dimension with first versions of the customers it did not hold."""

    def build() -> DataFrame:
        added = scd.new_customers(m.dim_customer, m.customer_snapshots, SNAPSHOT_AT, m.work)
        return m.work.save(m.dim_customer.unionByName(added), "dim_customer_extended")

    return m.once("dim_customer_extended", build)


def _after(m: RetailModel) -> DataFrame:
    after = lambda: scd.apply_snapshot(_extended(m), _newest(m), SNAPSHOT_AT, m.work)
    return m.once("dim_customer_after", lambda: m.work.save(after(), "dim_customer_after"))


@query
def e_latest_snapshot(m: RetailModel) -> DataFrame:
    return _newest(m)


@query
def e_new_customers(m: RetailModel) -> DataFrame:
    return scd.new_customers(m.dim_customer, m.customer_snapshots, SNAPSHOT_AT, m.work)


@query
def e_changed_customers(m: RetailModel) -> DataFrame:
    return scd.changed_customers(_extended(m), _newest(m))


@query
def e_scd2_apply(m: RetailModel) -> DataFrame:
    return _after(m)


@query
def e_scd2_parts(m: RetailModel) -> DataFrame:
    """The same history stored in parts, of which a snapshot reads and writes only the current versions."""

    def run() -> PartedTable:
        stored = PartedTable(m.spark, m.work.fresh("customer_history"), STAR["dim_customer"], scd.history_part())
        stored.replace(_extended(m))
        scd.apply_to_parts(stored, _newest(m), SNAPSHOT_AT, m.work)
        return stored

    return m.once("customer_history", run).read()


@query
def e_orders_at(m: RetailModel) -> DataFrame:
    """Orders beside the customer version of their date. Customers have up to five versions, the first may begin after an order."""
    key = F.col("c_custkey")
    begun = lambda k: F.timestamp_add("DAY", 500 * k + key % 100, F.lit(datetime(1992, 3, 1)))
    history = m.table("customer").select(key, "c_nationkey", F.explode(F.sequence(F.lit(0).cast("bigint"), key % 5)).alias("k"))
    versions = history.select(
        key.alias("customer_id"),
        begun(F.col("k")).alias("valid_from"),
        F.when(F.col("k") < key % 5, begun(F.col("k") + 1)).alias("valid_to"),
        (F.col("k") + 1).cast("int").alias("version"),
        ((F.col("c_nationkey") + F.col("k")) % 25).cast("int").alias("nation"),
    )
    orders = m.table("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("ordered_at"))
    return scd.customers_at(versions, orders, "o_custkey", "ordered_at", columns=("nation",))


@query
def e_scd2_twice(m: RetailModel) -> DataFrame:
    """The same snapshot applied again changes nothing."""
    return scd.apply_snapshot(_after(m), _newest(m), SNAPSHOT_AT, m.work)


@query
def e_scd2_repeated(m: RetailModel) -> DataFrame:
    """A snapshot that stages every customer a second time, with a city that sorts after all others."""
    again = _newest(m).withColumn("city", F.lit("~elsewhere"))
    return scd.apply_snapshot(_extended(m), _newest(m).unionByName(again), SNAPSHOT_AT, m.work)


@query
def e_scd2_checks(m: RetailModel) -> DataFrame:
    return scd.checks(_after(m), _newest(m))


# Role views


@query
def g_analyst(m: RetailModel) -> DataFrame:
    return secure.analyst_sales(m.fact_sales, m.dim_customer)


@query
def g_analyst_page(m: RetailModel) -> DataFrame:
    return secure.page(g_analyst(m))


@query
def g_store_manager(m: RetailModel) -> DataFrame:
    return secure.store_manager_sales(m.fact_sales, m.dim_customer, m.dim_store, "ST000000000007")


@query
def g_store_manager_page(m: RetailModel) -> DataFrame:
    return secure.page(secure.store_manager_sales(m.fact_sales, m.dim_customer, m.dim_store))


@query
def g_finance(m: RetailModel) -> DataFrame:
    return secure.finance_sales(m.fact_sales, m.dim_customer, m.dim_product)


@query
def g_finance_page(m: RetailModel) -> DataFrame:
    return secure.page(g_finance(m))


@query
def g_admin(m: RetailModel) -> DataFrame:
    return secure.admin_summary(m.fact_sales, m.dim_customer, m.dim_product, m.dim_store, m.dim_date)


@query
def g_masked_customers(m: RetailModel) -> DataFrame:
    return secure.masked_customers(m.dim_customer)


# Stock-out risk


@query
def a_features(m: RetailModel) -> DataFrame:
    return _rounded(m.features, 6, "avg_qty", "std_qty")


@query
def a_category_codes(m: RetailModel) -> DataFrame:
    """The codes as the features carry them."""
    coded = stockout.with_codes(m.features, stockout.category_codes(m.features, m.work))
    return coded.select("category", "category_code").distinct()


@query
def a_labels(m: RetailModel) -> DataFrame:
    labelled = stockout.labels(m.features).select("product_id", "store_id", "risk", "reorder_qty")
    return _rounded(labelled, 6, "reorder_qty")


@query
def a_rule_scores(m: RetailModel) -> DataFrame:
    scored = m.rule_scores.drop("explanation_json", "volatility_cv")
    return _rounded(scored, 6, "avg_daily_demand")


@query
def a_scan_all(m: RetailModel) -> DataFrame:
    return stockout.scan_all(m.rule_scores)


@query
def a_decision_log(m: RetailModel) -> DataFrame:
    return m.decision_log.drop("explanation_json")


@query
def a_latest_decisions(m: RetailModel) -> DataFrame:
    return _rounded(stockout.latest_risks(m.decision_log, m.dim_product, m.dim_store), 6, "avg_daily_demand")


@query
def a_reasoning(m: RetailModel) -> DataFrame:
    return _rounded(stockout.reasoning(m.decision_log).drop("volatility_cv"), 6, "avg_daily_demand")


@query
def a_scores(m: RetailModel) -> DataFrame:
    return m.scores


@query
def a_model_quality(m: RetailModel) -> DataFrame:
    return stockout.model_quality(m.scores, m.features)


# Live orders


def _fed(m: RetailModel) -> str:
    """Run the order feed over the events once; the folder that holds what it wrote."""

    def run() -> str:
        out = m.work.fresh("feed")
        live.run_feed(m.orders_stream(), m.rule_scores, out, STREAM_DELAY).awaitTermination()
        return out

    return m.once("feed", run)


def _fed_orders(m: RetailModel) -> DataFrame:
    return live.read_feed(m.spark, _fed(m), "orders")


@query
def t_orders(m: RetailModel) -> DataFrame:
    return _as_double(_fed_orders(m), "price")


@query
def t_alerts(m: RetailModel) -> DataFrame:
    return live.read_feed(m.spark, _fed(m), "alerts")


@query
def t_messages(m: RetailModel) -> DataFrame:
    return live.read_feed(m.spark, _fed(m), "messages").drop("timestamp")


@query
def t_orders_folded(m: RetailModel) -> DataFrame:
    """The orders of a sink of twelve micro-batches, two of them written twice, folded three times."""

    def run() -> str:
        out = m.work.fresh("folded_feed")
        table, orders = live.sink(m.spark, out, "orders"), m.work.save(m.orders_batch, "feed_orders")
        for batch in range(12):
            part = orders.where(F.pmod(F.xxhash64("order_id"), F.lit(12)) == batch).select(*FEED["orders"].names)
            for _ in range(2 if batch % 6 == 5 else 1):
                table.write(part, batch)
            if batch % 4 == 3:
                table.compact(most_folders=2)
        return out

    return _as_double(live.read_feed(m.spark, m.once("folded_feed", run), "orders"), "price")


@query
def t_daily_window(m: RetailModel) -> DataFrame:
    out = m.work.fresh("daily_stats")
    live.run_daily_stats(m.orders_stream(), out, STREAM_DELAY).awaitTermination()
    return live.read_daily_stats(m.spark, out).drop("approx_customers")


@query
def t_daily_repeated(m: RetailModel) -> DataFrame:
    """The stream with every tenth order sent twice."""
    out, orders = m.work.fresh("daily_repeated"), m.orders_stream()
    live.run_daily_stats(orders.union(m.orders_stream().where("order_id % 10 = 0")), out, STREAM_DELAY).awaitTermination()
    return live.read_daily_stats(m.spark, out).drop("approx_customers")


@query
def t_day_stats(m: RetailModel) -> DataFrame:
    orders = _fed_orders(m)
    newest = orders.agg(F.max(F.to_date("timestamp"))).scalar()
    return _rounded(live.day_stats(orders, newest), 6, "avg_order_value")


@query
def t_recent_orders(m: RetailModel) -> DataFrame:
    return _as_double(live.recent_orders(_fed_orders(m)), "price")


GAP_HOURS = 12


def _visits(m: RetailModel, found: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a stream over the events gives out: the visits that the newest event has closed."""

    def run() -> str:
        out = m.work.fresh(name)
        stream = m.spark.readStream.schema(m.table("events").schema).parquet(f"{m.dir}/events.parque[t]")
        visits.run_visits(found(stream), out).awaitTermination()
        return out

    return live.read_sink(m.spark, m.once(name, run), "visits", visits.VISIT)


@query
def t_sessions(m: RetailModel) -> DataFrame:
    """Visits as session windows of the stream."""
    return _visits(m, lambda events: visits.sessions(events, f"{GAP_HOURS} hours", "1 day"), "sessions")


@query
def t_visits(m: RetailModel) -> DataFrame:
    """The same visits from keyed state with timers."""
    return _visits(m, lambda events: visits.visits(events, GAP_HOURS * 3600, "1 day"), "visits")


@query
def t_sessions_batch(m: RetailModel) -> DataFrame:
    """All visits of the stored events, open ones too."""
    return visits.sessions(m.table("events"), f"{GAP_HOURS} hours", "1 day")


# Runs: every order is a run that starts on its date and, unless pending, ends some time later


def _run_events(m: RetailModel) -> DataFrame:
    orders = m.table("orders")
    start = F.col("o_orderdate").cast("timestamp")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    started = orders.select(
        key.alias("run_id"),
        F.col("o_orderpriority").alias("pipeline_name"),
        start.alias("event_time"),
        F.lit("running").alias("status"),
    )
    ended = orders.where(status != "P").select(
        key.alias("run_id"),
        F.col("o_orderpriority").alias("pipeline_name"),
        F.timestamp_seconds(F.unix_seconds(start) + 30 + key % 600).alias("event_time"),
        F.when(status == "F", "success").otherwise("failed").alias("status"),
        F.floor("o_totalprice").cast("bigint").alias("rows_processed"),
        (key % 13).cast("bigint").alias("rows_quarantined"),
        F.when(status != "F", F.concat(F.lit("status "), status)).alias("error_message"),
    )
    return started.unionByName(ended, allowMissingColumns=True)


def _run_log(m: RetailModel) -> DataFrame:
    return ops.run_log(_run_events(m))


@query
def o_run_log(m: RetailModel) -> DataFrame:
    return _run_log(m)


@query
def o_run_metrics(m: RetailModel) -> DataFrame:
    return ops.run_metrics(cleaning.report(m.raw_transactions, m.staged), 1, DETECTED).drop("timestamp")


@query
def o_run_history(m: RetailModel) -> DataFrame:
    return ops.run_history(_run_log(m))


@query
def o_last_run(m: RetailModel) -> DataFrame:
    return ops.run_history(_run_log(m), 1)


@query
def o_success_rate(m: RetailModel) -> DataFrame:
    return ops.success_rate(ops.run_history(_run_log(m)))


def _quarantine_log(m: RetailModel) -> DataFrame:
    errors = m.table("events").where(F.col("event_type") == "error")
    return errors.select(F.col("event_type").alias("quarantine_reason"), F.col("ts").cast("timestamp").alias("timestamp"))


@query
def o_quarantine_rate(m: RetailModel) -> DataFrame:
    return ops.quarantine_rate(_quarantine_log(m), datetime(2024, 1, 30), minutes=2880)


@query
def o_retention(m: RetailModel) -> DataFrame:
    return ops.keep_recent(_run_log(m), "start_time", datetime(2001, 7, 1), ops.RUN_DAYS)


def _week(column: str) -> Column:
    return F.date_format(F.date_trunc("week", column), "yyyy-MM-dd")


def _purged(m: RetailModel) -> tuple[PartedTable, dict[str, str]]:
    """The quarantine log stored by week and purged; what became of each week."""

    def run() -> tuple[PartedTable, dict[str, str]]:
        log = _quarantine_log(m)
        table = PartedTable(m.spark, m.work.fresh("quarantine_log"), log.schema, _week("timestamp"))
        table.replace(log)
        return table, ops.purge(table, "timestamp", datetime(2024, 2, 10), ops.QUARANTINE_DAYS)

    return m.once("purged_log", run)


@query
def o_quarantine_retention(m: RetailModel) -> DataFrame:
    """The log is stored by week, purged, and read back."""
    return _purged(m)[0].read()


@query
def o_retention_parts(m: RetailModel) -> DataFrame:
    """Weeks that the purge dropped, wrote again or left alone, with the rows they had."""
    states = m.spark.createDataFrame(sorted(_purged(m)[1].items()), "week string, state string")
    had = _quarantine_log(m).groupBy(_week("timestamp").alias("week")).agg(F.count(F.lit(1)).alias("rows_before"))
    return had.join(states, "week")


@query
def w_status_updates(m: RetailModel) -> DataFrame:
    """Run events appended in two batches and folded on read."""
    log = Log(m.spark, m.work.fresh("run_events"), LOGS["run_events"])
    events = _run_events(m)
    log.append(events.where("status = 'running'"))
    log.append(events.where("status <> 'running'"))
    return ops.run_log(log.read()).groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


# The whole batch


def _write_raw(m: RetailModel, **more: F.Column) -> str:
    """Raw inputs as the CSV files a batch starts from, with more columns of the transactions."""
    folder = m.work.fresh("raw_csv")
    shipments = m.raw_shipments.withColumn("courier", F.lit("Any"))
    # Cleaning keeps the copy that stands first in the files, so the files get an order that SQL can state.
    order = [F.col(c).asc_nulls_last() for c in m.raw_transactions.columns if c != "transaction_id"]
    inputs = {
        "customers": m.raw_customers,
        "products": m.raw_products,
        "stores": m.raw_stores,
        "inventory": m.raw_inventory,
        "transactions": m.raw_transactions.orderBy(*order).withColumns(more),
        "shipments": shipments,
    }
    for name, df in inputs.items():
        # Packed text is read a file at a time, so files hold limited rows.
        df.write.option("header", True).option("maxRecordsPerFile", 1 << 20).csv(f"{folder}/{name}.csv", compression="gzip")
    return folder


@query
def o_batch_flow(m: RetailModel) -> DataFrame:
    """Ingest, cleaning and warehouse build in one run from CSV files; the sales it arrives at."""

    def run() -> Warehouse:
        warehouse = Warehouse(m.spark, m.work.fresh("warehouse"))
        raw = _write_raw(m)
        run_batch(warehouse, raw, AS_OF, 1, *m.days, work=m.work, regions=REGIONS)
        files.remove(m.spark, raw)  # nothing reads the files of a batch again that is loaded
        return warehouse

    sales = m.once("batch_flow", run).table("fact_sales")
    return _as_double(sales, "revenue", "discount")


def _held_batch(m: RetailModel) -> tuple[Warehouse, DataFrame]:
    """A batch whose transactions bring four new columns: held, asked for again, approved, loaded; with the status after each step."""

    def run() -> tuple[Warehouse, DataFrame]:
        warehouse, seen = Warehouse(m.spark, m.work.fresh("held_warehouse")), []

        def told(step: str) -> None:
            status = ops.run_log(warehouse.log("run_events").read()).first()["status"]
            waiting = approval_requests(warehouse).where("status = 'pending'").count()
            seen.append(("transactions", step, status, waiting, warehouse.has("fact_sales")))

        new = {"till": F.expr("crc32(cast(transaction_id as binary)) % 7"), "channel": F.substring("payment_method", 1, 1), "promo": F.col("store_id"), "note": F.col("product_id")}
        raw = _write_raw(m, **new)
        run_batch(warehouse, raw, AS_OF, 1, *m.days, work=m.work, regions=REGIONS)
        files.remove(m.spark, raw)  # the batch has landed and resumes from there
        told("run")
        resume_batch(warehouse, AS_OF, DECIDED, 1, *m.days, work=m.work, regions=REGIONS)
        told("asked")
        warehouse.log("schema_decisions").append(_decisions(warehouse.log("schema_approval_queue").read()))
        resume_batch(warehouse, AS_OF, DECIDED, 1, *m.days, work=m.work, regions=REGIONS)
        told("approved")
        return warehouse, m.spark.createDataFrame(seen, "table_name string, step string, status string, waiting bigint, loaded boolean")

    return m.once("held_batch", run)


@query
def o_held_batch(m: RetailModel) -> DataFrame:
    """The sales that a held batch arrives at once it is approved."""
    return _as_double(_held_batch(m)[0].table("fact_sales"), "revenue", "discount")


@query
def o_held_steps(m: RetailModel) -> DataFrame:
    """What each step of the held batch left: run status, open requests, whether sales are loaded, changes by status."""
    warehouse, steps = _held_batch(m)
    changes = schema_changes(warehouse).groupBy("table_name", F.col("status").alias("change_status"), "approved_by").agg(F.count(F.lit(1)).alias("changes"))
    return steps.join(changes, "table_name")


# Layout, files


def _partitioned(m: RetailModel) -> str:

    def write() -> str:
        path = m.work.fresh("sales_by_month")
        files.write_partitioned_sales(m.fact_sales, m.dim_date, m.dim_store, path)
        return path

    return m.once("sales_by_month", write)


@query
def o_revenue_flat(m: RetailModel) -> DataFrame:
    return ops.revenue_of_day(m.fact_sales, DAY)


@query
def o_revenue_partitioned(m: RetailModel) -> DataFrame:
    month = files.read_partitioned_sales(m.spark, _partitioned(m), STAR["fact_sales"], dates=["1998-03"])
    return ops.revenue_of_day(month, DAY)


@query
def w_partition_roundtrip(m: RetailModel) -> DataFrame:
    """Written twice: the second write replaces the first."""
    path = m.work.fresh("sales_by_month")
    for _ in range(2):
        files.write_partitioned_sales(m.fact_sales, m.dim_date, m.dim_store, path)
    copy = files.read_partitioned_sales(m.spark, path, STAR["fact_sales"])
    return _as_double(copy, "revenue").select("sale_id", "date_key", "revenue", "date_partition", "region")


@query
def w_partition_replaced(m: RetailModel) -> DataFrame:
    """Written again without one month: nothing of it is left."""
    path = m.work.fresh("sales_by_month")
    files.write_partitioned_sales(m.fact_sales, m.dim_date, m.dim_store, path)
    files.write_partitioned_sales(m.fact_sales.where("date_key NOT BETWEEN 19980301 AND 19980331"), m.dim_date, m.dim_store, path)
    copy = files.read_partitioned_sales(m.spark, path, STAR["fact_sales"])
    return copy.groupBy("date_partition", "region").agg(F.count("*").alias("sales"), F.sum("revenue").cast("double").alias("revenue"))


@query
def w_quarantine(m: RetailModel) -> DataFrame:
    """What the ingest put aside, read back by reason."""
    m.landed_transactions()
    log = files.read_quarantine_log(m.spark, m.work.location("landing"), ["transactions", "customers"])
    return log.groupBy("table_name", "quarantine_reason").agg(F.count("*").alias("row_count"))


@query
def w_samples(m: RetailModel) -> DataFrame:
    path = m.work.fresh("sample_fact_sales")
    files.write_sample(m.fact_sales.select("sale_id", "date_key", "revenue"), ["date_key", "sale_id"], path)
    return files.read_csv(m.spark, path, m.fact_sales.select("sale_id", "date_key", F.col("revenue").cast("double")).schema).drop(
        files.CORRUPT
    )


@query
def s_csv_ingest(m: RetailModel) -> DataFrame:
    path = m.work.fresh("transactions_csv")
    m.raw_transactions.write.option("header", True).csv(path)
    read = files.read_csv_by_name(m.spark, path, raw_fields("transactions")).drop(files.CORRUPT)
    return _as_double(ingest.with_reason(read, TRANSACTION_RULE), "price", "discount")


@query
def s_csv_layouts(m: RetailModel) -> DataFrame:
    """Customers in two files of different column order, one with ages that are no numbers; unreadable text is kept."""
    path = m.work.fresh("customers_csv")
    customers = m.table("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    odd = F.col("c_custkey") % 2 == 1
    bad = F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("c_nationkey").cast("string")).alias("c_nationkey")
    customers.where(odd).select("c_custkey", "c_name", bad, "c_mktsegment").write.option("header", True).csv(path)
    customers.where(~odd).select("c_mktsegment", "c_nationkey", "c_custkey", "c_name").write.mode("append").option("header", True).csv(path)
    read = files.read_csv_by_name(m.spark, path, customers.schema.fields)
    return read.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", files.CORRUPT)


@query
def s_inventory_relabel(m: RetailModel) -> DataFrame:
    """Stock written under a header in another order than its data, read by position."""
    path = m.work.fresh("inventory_csv")
    m.raw_inventory.toDF("date", "store_id", "product_id", "stock_level").write.option("header", True).csv(path)
    return files.read_csv(m.spark, path, RAW["inventory"]).drop(files.CORRUPT)


@query
def s_snapshots(m: RetailModel) -> DataFrame:
    """Customer snapshots written one directory each and read together."""
    root = m.work.fresh("snapshots")
    schema = m.customer_snapshots.drop("snapshot_ts").schema
    for at in (datetime(2002, 1, 15), SNAPSHOT_AT):
        taken = m.customer_snapshots.where(F.col("snapshot_ts") == F.lit(at)).drop("snapshot_ts")
        files.write_snapshot(taken, root, "customers", at)
    return files.read_snapshots(m.spark, root, "customers", schema)
