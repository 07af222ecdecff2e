import gzip
from datetime import datetime

import pytest
from conftest import rows

from shelfsight.operators import ingest
from shelfsight.schemas import RAW, Registry, TableRule, default_registry
from shelfsight.sources import files, stores

RULE = TableRule("t", ("b", "a"), ("c",))


def test_reasons_are_sorted_and_joined(spark):
    df = spark.createDataFrame([(1, None, None), (None, "x", "y"), (None, None, "z"), (4, "p", None)], "a int, b string, c string")
    assert rows(ingest.with_reason(df, RULE), "a", "quarantine_reason") == sorted(
        [
            (1, "missing_required_value:b"),
            (None, "missing_required_value:a"),
            (None, "missing_required_value:a;missing_required_value:b"),
            (4, ""),
        ],
        key=str,
    )
    assert ingest.valid_rows(df, RULE).count() + ingest.quarantined_rows(df, RULE).count() == df.count()
    assert ingest.row_counts(df, RULE).first().asDict() == {"table_name": "t", "valid_rows": 1, "quarantined_rows": 3}


def test_absent_column_rejects_every_row(spark):
    df = spark.createDataFrame([(1, "q"), (None, "r")], "a int, z string")
    assert {r["quarantine_reason"] for r in ingest.quarantined_rows(df, RULE).collect()} == {
        "missing_required_column:b",
        "missing_required_column:b;missing_required_value:a",
    }
    assert ingest.valid_rows(df, RULE).count() == 0
    assert ingest.drifted_columns(df, RULE) == ["z"]


def test_empty_rule_keeps_all_and_reports_all_as_drift(spark):
    df = spark.createDataFrame([(None, "r")], "a int, z string")
    empty = TableRule("t")
    assert ingest.valid_rows(df, empty).count() == 1
    assert ingest.drifted_columns(df, empty) == ["a", "z"]


def test_batch_over_files(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    (raw / "stores.csv").write_text("store_id,store_name,city,opened_date,extra\nST1,One,Delhi,2020-01-01,e\n,Two,Pune,2020-01-02,f\n")
    (raw / "inventory.csv").write_text("date,store_id,product_id,stock_level\nST1,P1,2024-01-31,7\n")
    at = datetime(2024, 2, 1, 10, 0, 0)
    job = ingest.BatchIngest(spark, default_registry(), str(raw), str(out))
    results = {r.table_name: r for r in job.run_all(at)}
    assert (results["stores"].valid_rows, results["stores"].quarantined_rows) == (1, 1)
    assert results["stores"].new_columns == ("extra",)
    assert results["customers"].valid_rows == 0
    assert ingest.batch_totals(list(results.values())) == {"total_rows": 2, "quarantined_rows": 1}
    stock = files.read_snapshots(spark, str(out), "inventory", RAW["inventory"])
    assert rows(stock, "store_id", "product_id", "date", "stock_level", "snapshot_ts") == [("ST1", "P1", "2024-01-31", 7, at)]
    log = files.read_quarantine_log(spark, str(out), ["stores", "customers"])
    assert rows(log) == [("stores", "missing_required_value:store_id", at)]
    assert "extra" in files.landed(spark, str(out), "stores", at).columns


def test_unregistered_table_is_an_error(spark, tmp_path):
    job = ingest.BatchIngest(spark, Registry.of(), str(tmp_path), str(tmp_path / "o"))
    try:
        job.run_table("stores", "stores.csv", datetime(2024, 1, 1))
    except ValueError as error:
        assert "stores" in str(error)
    else:
        raise AssertionError("expected an error")


def test_bad_values_become_null_and_are_quarantined(spark, tmp_path):
    (tmp_path / "transactions.csv").write_text(
        "transaction_id,date,store_id,customer_id,product_id,quantity,price,payment_method\n"
        "T1,2024-01-01,ST1,C1,P1,two,10.5,Cash\nT2,2024-01-01,ST1,C1,P1,2,10.5,Cash\n"
    )
    df = files.read_csv_by_name(spark, str(tmp_path / "transactions.csv"), RAW["transactions"].fields).drop(files.CORRUPT)
    rule = default_registry().rule("transactions")
    assert [r["quarantine_reason"] for r in ingest.quarantined_rows(df, rule).collect()] == ["missing_required_value:quantity"]
    assert [r["transaction_id"] for r in ingest.valid_rows(df, rule).collect()] == ["T2"]


def test_latest_row_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, v int, city string")
    assert rows(files.latest_per_key(df, "k", "v")) == [("a", 2, "y"), ("b", 1, None)]


def jobs_of(spark, group, action):
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = action()
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_rows_are_read_once_and_counted_by_the_write(spark, tmp_path):
    (tmp_path / "inventory.csv").write_text("date,store_id,product_id,stock_level\nST1,P1,2024-01-31,7\nST2,,2024-01-31,x\n")
    job = ingest.BatchIngest(spark, default_registry(), str(tmp_path), str(tmp_path / "out"))
    at = datetime(2024, 2, 1)
    result, jobs = jobs_of(spark, "inventory", lambda: job.run_table("inventory", "inventory.csv", at))
    assert (result.valid_rows, result.quarantined_rows, jobs) == (1, 1, 1)
    log = rows(files.read_quarantine_log(spark, str(tmp_path / "out"), ["inventory"]))
    assert log == [("inventory", "missing_required_value:product_id;unreadable_value", at)]
    # Run again with the same time over mended rows: nothing of the first run is left.
    (tmp_path / "inventory.csv").write_text("date,store_id,product_id,stock_level\nST1,P1,2024-01-31,7\nST2,P2,2024-01-31,8\n")
    result = job.run_table("inventory", "inventory.csv", at)
    assert (result.valid_rows, result.quarantined_rows) == (2, 0)
    assert files.read_quarantine_log(spark, str(tmp_path / "out"), ["inventory"]).count() == 0
    assert files.read_snapshots(spark, str(tmp_path / "out"), "inventory", RAW["inventory"]).count() == 2


def test_a_table_without_rows_lands_nothing(spark, tmp_path):
    (tmp_path / "stores.csv").write_text("store_id,store_name,city,opened_date\n")
    job = ingest.BatchIngest(spark, default_registry(), str(tmp_path), str(tmp_path / "out"))
    result = job.run_table("stores", "stores.csv", datetime(2024, 2, 1))
    assert (result.valid_rows, result.quarantined_rows) == (0, 0)
    assert files.landed(spark, str(tmp_path / "out"), "stores", datetime(2024, 2, 1)) is None
    empty = spark.createDataFrame([], RAW["stores"])
    assert ingest.land(empty, default_registry().rule("stores"), str(tmp_path / "o2"), datetime(2024, 2, 1)).valid_rows == 0


def test_headers_of_many_files(spark, tmp_path):
    folder = tmp_path / "in [1] {a}"
    folder.mkdir()
    for k in range(2_000):
        text = f"a,b\n{k},x\n" if k % 2 else f"b,a\ny,{k}\n"
        (folder / f"part {k:04d}.csv").write_text(text)
    pattern = files._named(str(folder))
    found, jobs = jobs_of(spark, "layouts", lambda: files.csv_layouts(spark, pattern))
    assert {columns: len(paths) for columns, paths in found.items()} == {("a", "b"): 1000, ("b", "a"): 1000}
    assert jobs < 40  # not one per file
    read = files.read_csv_by_name(spark, pattern, spark.createDataFrame([], "a int, b string").schema.fields)
    assert rows(read.groupBy("b").agg({"a": "sum", "b": "count"})) == [("x", 1_000_000, 1000), ("y", 999_000, 1000)]


def test_one_layout_names_no_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n")
    (tmp_path / "b.csv").write_text('"k",v\r\n2,y\r\n')
    (tmp_path / "c.csv").write_text("")
    assert files.csv_layouts(spark, str(tmp_path)) == {("k", "v"): [str(tmp_path)]}
    (tmp_path / "d.csv.gz").write_bytes(gzip.compress(b"v,k\nz,3\n"))
    assert set(files.csv_layouts(spark, str(tmp_path))) == {("k", "v"), ("v", "k")}
    read = files.read_csv_by_name(spark, str(tmp_path), spark.createDataFrame([], "k int, v string").schema.fields)
    assert rows(read, "k", "v") == [(1, "x"), (2, "y"), (3, "z")]


def test_a_store_that_only_spark_reaches(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n")
    (tmp_path / "b.csv").write_text("v,k\ny,2\n")
    monkeypatch.setattr(stores, "reaches", lambda path: False)
    assert set(files.csv_layouts(spark, str(tmp_path))) == {("k", "v"), ("v", "k")}


def test_first_line_reads_the_head_only(tmp_path, monkeypatch):
    (tmp_path / "long.csv").write_bytes(b"a,b,c\r\n" + b"x" * 10_000_000)
    asked = []

    class Watched:
        def __init__(self, stream):
            self.stream = stream

        def __enter__(self):
            return self

        def __exit__(self, *rest):
            self.stream.close()

        def read(self, size):
            asked.append(size)
            return self.stream.read(size)

    system, name = stores.locate(str(tmp_path / "long.csv"))

    class Opening:
        def open_input_stream(self, *rest, **more):
            return Watched(system.open_input_stream(*rest, **more))

    monkeypatch.setattr(stores, "locate", lambda path: (Opening(), name))
    assert stores.first_line("any") == "a,b,c" and sum(asked) <= 1 << 15


@pytest.mark.parametrize("path,name", [("/a b/c", "/a b/c"), ("file:/a/c%20d", "/a/c%20d"), ("file:///a/c", "/a/c")])
def test_paths_of_local_files(path, name):
    assert stores.locate(path)[1] == name


def test_stores_that_tasks_cannot_open():
    assert stores.locate("viewfs://store/in/a.csv") is None and not stores.reaches("viewfs://store/in/a.csv")
