import time
from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from shelfsight.operators import ops
from shelfsight.plans import flow
from shelfsight.session import fit_shuffles
from shelfsight.sources import files
from shelfsight.workspace import Workspace

FIRST, LAST = date(2024, 1, 1), date(2024, 12, 31)


def write_raw(folder, city="Delhi"):
    folder.mkdir(exist_ok=True)
    files = {
        "customers": ["customer_id,name,email,phone,city,age,registration_date", f"C1,Ann,ann@x.org,5551234,{city},30,2023-01-01", "C2,Bo,,,Pune,31,2023-01-01"],
        "products": ["product_id,product_name,category,base_price,cost_price", "P1,Pen,Toys,10,6", "P2,Cup,Home,20,9"],
        "stores": ["store_id,store_name,city,opened_date", "S1,One,Mumbai,2020-01-01", "S2,Two,Kolkata,2020-01-01"],
        "inventory": ["date,store_id,product_id,stock_level"] + [f"S{s},P{p},2024-0{m}-28,{m * p + s}" for s in (1, 2) for p in (1, 2) for m in (1, 2)],
        "transactions": ["transaction_id,date,store_id,customer_id,product_id,quantity,price,payment_method"]
        + [f"T{i},2024-02-{1 + i % 28:02d},S{1 + i % 2},C{1 + i % 2},P{1 + i % 2},{1 + i % 4},{10 * (1 + i % 2)},Cash" for i in range(40)]
        + ["T1,2024-02-02,S2,C2,P2,2,20,Cash", "T90,2024-02-02,,C2,P2,2,20,Cash", "T91,2024-02-02,S1,C1,P1,2,-10,Cash"],
        "shipments": ["shipment_id,transaction_id,ship_date,delivery_date,status,courier", "H1,T1,2024-02-03,2024-02-05,Delivered,X", "H2,T999,2024-02-03,2024-02-05,Delivered,X"],
        "web_clickstream": ["session_id,timestamp,event_type,product_id,user_id,device", "w1,2024-02-03 10:00:00,view,P1,,mobile"],
    }
    for name, lines in files.items():
        (folder / f"{name}.csv").write_text("\n".join(lines) + "\n")


@pytest.fixture
def warehouse(spark, tmp_path):
    return flow.Warehouse(spark, str(tmp_path / "warehouse"))


def run(warehouse, raw, run_id, at):
    return flow.run_batch(warehouse, str(raw), at, run_id, FIRST, LAST)


def test_two_runs_keep_history_and_logs(spark, warehouse, tmp_path):
    write_raw(tmp_path / "raw")
    first = run(warehouse, tmp_path / "raw", 1, datetime(2024, 7, 1))
    assert first.report["initial_rows"] == 42 and first.report["duplicates_removed"] == 1 and first.report["invalid_values_fixed"] == 1
    assert {t.table_name: t.quarantined_rows for t in first.tables}["transactions"] == 1
    assert {n: df.count() for n, df in warehouse.tables().items()} == {
        "dim_date": 366, "dim_customer": 2, "dim_product": 2, "dim_store": 2, "dim_external_events": 0,
        "fact_sales": 41, "fact_inventory": 8, "fact_shipments": 1,
    }
    assert rows(flow.quarantine_log(warehouse), "table_name", "quarantine_reason") == [("transactions", "missing_required_value:store_id")]

    write_raw(tmp_path / "raw", city="Goa")
    run(warehouse, tmp_path / "raw", 2, datetime(2024, 7, 2))
    history = warehouse.table("dim_customer").where("customer_id = 'C1'")
    assert rows(history, "version", "city", "is_current", "customer_key") == [(1, "Delhi", False, 1), (2, "Goa", True, 3)]
    used = warehouse.table("fact_sales").select("customer_key").distinct()
    assert rows(used) == [(2,), (3,)]

    runs = ops.run_log(warehouse.log("run_events").read())
    assert rows(runs, "run_id", "status", "rows_quarantined") == [(1, "success", 1), (2, "success", 1)]
    metrics = warehouse.log("pipeline_metrics").read().where("run_id = 1")
    assert {r["metric_name"] for r in metrics.collect()} == {"duplicates_removed", "nulls_fixed", "anomalies_flagged", "data_quality_score"}

    warehouse.create_views()
    assert spark.sql("SELECT count(*) FROM analyst_sales").first()[0] == 41
    assert spark.sql("SELECT row_count FROM admin_all WHERE table_name = 'fact_sales'").first()[0] == 41
    copy = spark.read.parquet(warehouse.partitioned_sales())
    assert copy.count() == 41 and set(copy.columns) >= {"date_partition", "region"}

    warehouse.export_samples(str(tmp_path / "samples"), 10)
    sample = spark.read.option("header", True).csv(str(tmp_path / "samples" / "dim_customer_sample"))
    assert "ann@x.org" not in str(sample.collect()) and sample.count() == 3


def test_retrain_logs_decisions(warehouse, tmp_path, work):
    write_raw(tmp_path / "raw")
    run(warehouse, tmp_path / "raw", 1, datetime(2024, 7, 1))
    scored = flow.retrain(warehouse, datetime(2024, 7, 1), work, rounds=3)
    assert scored.count() == 4
    flow.retrain(warehouse, datetime(2024, 7, 2), work, rounds=3)
    log = warehouse.log("ml_reasoning_log").read()
    assert rows(log.select(F.count("id"), F.max("id"))) == [(8, 8)]


def test_failure_is_logged(warehouse, tmp_path):
    write_raw(tmp_path / "raw")
    (tmp_path / "raw" / "customers.csv").write_text("customer_id,nom\nC1,Ann\n")
    with pytest.raises(Exception):
        run(warehouse, tmp_path / "raw", 7, datetime(2024, 7, 1))
    runs = ops.run_log(warehouse.log("run_events").read()).collect()
    assert [(r["run_id"], r["status"]) for r in runs] == [(7, "failed")] and runs[0]["error_message"]


def test_retrain_without_stock_logs_nothing(warehouse, work):
    assert flow.retrain(warehouse, datetime(2024, 7, 1), work).count() == 0
    assert warehouse.log("ml_reasoning_log").read().count() == 0


def drifted(folder, columns):
    write_raw(folder)
    first, *lines = (folder / "transactions.csv").read_text().splitlines()
    values = [",".join(f"{k * 10 + i % 7}" for k in range(len(columns))) for i in range(len(lines))]
    (folder / "transactions.csv").write_text("\n".join([",".join([first, *columns]), *(f"{a},{b}" for a, b in zip(lines, values))]) + "\n")


def status_of(warehouse, run_id):
    return ops.run_log(warehouse.log("run_events").read()).where(F.col("run_id") == run_id).first()["status"]


def decided(warehouse, status, at):
    queue = warehouse.log("schema_approval_queue").read()
    warehouse.log("schema_decisions").append(queue.select("queue_id", F.lit(status).alias("status"), F.lit(at).alias("decided_at")))


def test_a_drifted_batch_is_held_then_approved_then_loaded(warehouse, tmp_path):
    at, later = datetime(2024, 7, 1), datetime(2024, 7, 2)
    drifted(tmp_path / "raw", ["n1", "n2", "n3", "n4"])
    for _ in range(2):  # a second try asks no second time
        result = run(warehouse, tmp_path / "raw", 1, at)
        assert result.held == ("transactions",) and status_of(warehouse, 1) == "held" and not warehouse.has("fact_sales")
        assert warehouse.log("schema_change_log").read().count() == 4
        assert rows(flow.requests(warehouse), "table_name", "status") == [("transactions", "pending")]
    assert flow.resume_batch(warehouse, at, later, 1, FIRST, LAST).held == ("transactions",) and not warehouse.has("fact_sales")
    decided(warehouse, "approved", later)
    done = flow.resume_batch(warehouse, at, later, 1, FIRST, LAST)
    assert not done.held and done.report["initial_rows"] == 42 and warehouse.table("fact_sales").count() == 41
    assert rows(ops.run_log(warehouse.log("run_events").read()), "status", "rows_quarantined") == [("success", 1)]
    assert {r["status"] for r in flow.schema_changes(warehouse).collect()} == {"approved"}
    assert rows(flow.quarantine_log(warehouse), "table_name") == [("transactions",)]


def test_a_refused_batch_stays_apart_and_an_old_one_is_not_loaded_after_a_newer(warehouse, tmp_path):
    at, later = datetime(2024, 7, 1), datetime(2024, 7, 3)
    drifted(tmp_path / "raw", ["n1", "n2", "n3", "n4"])
    run(warehouse, tmp_path / "raw", 1, at)
    decided(warehouse, "rejected", later)
    assert flow.resume_batch(warehouse, at, later, 1, FIRST, LAST).held == ("transactions",)
    assert status_of(warehouse, 1) == "rejected" and not warehouse.has("fact_sales")
    write_raw(tmp_path / "known")
    assert not run(warehouse, tmp_path / "known", 2, datetime(2024, 7, 2)).held
    decided(warehouse, "approved", datetime(2024, 7, 4))
    with pytest.raises(ValueError, match="later"):
        flow.resume_batch(warehouse, at, later, 1, FIRST, LAST)
    with pytest.raises(ValueError, match="no batch"):
        flow.resume_batch(warehouse, datetime(2023, 1, 1), later, 9, FIRST, LAST)


def test_one_sure_new_column_needs_no_approval(warehouse, tmp_path):
    drifted(tmp_path / "raw", ["loyalty_points"])
    result = run(warehouse, tmp_path / "raw", 1, datetime(2024, 7, 1))
    log = rows(warehouse.log("schema_change_log").read(), "column_name", "status")
    assert result.held == () and warehouse.table("fact_sales").count() == 41 and log == [("loyalty_points", "auto_approve")]


def test_released_rows_are_moved_not_written_again(spark, tmp_path):
    at, root = datetime(2024, 7, 1), str(tmp_path / "landing")
    kept = spark.range(20).selectExpr("id", "if(id % 5 = 0, 'quarantined', 'held') state").repartition(3)
    files.write_split(kept, root, "sales", at)
    snapshot = tmp_path / "landing" / "sales" / f"snapshot={at.strftime(files.STAMP)}"
    written = {p.name: p.read_bytes() for p in (snapshot / "state=held").glob("part-*")}
    # An earlier try stopped halfway: one file has moved, of another a copy lies at its target.
    moved, copied, *_ = sorted(written)
    files.move(spark, str(snapshot / "state=held" / moved), str(snapshot / "state=valid" / moved))
    (snapshot / "state=valid" / copied).write_bytes(b"half")
    for _ in range(2):
        files.release(spark, root, "sales", at)
    assert {p.name: p.read_bytes() for p in (snapshot / "state=valid").glob("part-*")} == written
    assert files.landed(spark, root, "sales", at, files.HELD) is None and files.landed(spark, root, "sales", at, files.QUARANTINED).count() == 4
    assert rows(files.landed(spark, root, "sales", at), "id") == sorted([(i,) for i in range(20) if i % 5], key=str)


def test_a_loaded_batch_leaves_no_staged_table(spark, warehouse, tmp_path):
    write_raw(tmp_path / "raw")
    work = Workspace(spark, "staged-once")
    flow.run_batch(warehouse, str(tmp_path / "raw"), datetime(2024, 7, 1), 1, FIRST, LAST, work=work)
    left = files.children(spark, work.path)
    assert left and not [name for name in left if name.startswith("staged_transactions")]


def test_packed_text_counts_as_its_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 100)
    spark.range(100).selectExpr("id").coalesce(1).write.csv(str(tmp_path / "b.csv"), compression="gzip")
    packed = sum(p.stat().st_size for p in (tmp_path / "b.csv").glob("*.gz"))
    assert packed and files.text_bytes(spark, str(tmp_path)) == 100 + files.PACKED_TIMES * packed


def test_shuffle_files_go_with_their_execution(spark, tmp_path):
    def held():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    fit_shuffles(spark, 0)
    before = held()
    grouped = spark.range(10_000).groupBy(F.expr("id % 100").alias("k")).count()
    assert grouped.count() == 100
    grouped.write.parquet(str(tmp_path / "out"))
    assert [len(grouped.collect()) for _ in range(2)] == [100, 100]  # files that are gone are made again
    until = time.monotonic() + 20
    while held() - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not held() - before
