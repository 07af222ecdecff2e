"""Tables in parts: what a change writes, what a purge leaves alone, and history read at a time."""

from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from shelfsight.operators import ops, scd
from shelfsight.schemas import STAR
from shelfsight.sources import files
from shelfsight.sources.tables import PartedTable, VersionedTable

EVENTS = "k int, at timestamp"


def month():
    return F.date_format("at", "yyyy-MM")


def stored(spark, path, days):
    table = PartedTable(spark, str(path), spark.createDataFrame([], EVENTS).schema, month())
    table.replace(spark.createDataFrame([(k, day) for k, day in enumerate(days)], EVENTS))
    return table


DAYS = [datetime(2024, m, d) for m in (1, 2, 3, 4) for d in (3, 20)] + [None]


def test_a_purge_writes_no_other_month(spark, tmp_path):
    table = stored(spark, tmp_path, DAYS[:-1])
    before = dict(table.folders())
    assert ops.purge(table, "at", datetime(2024, 4, 10), 30) == {"2024-01": "dropped", "2024-02": "dropped", "2024-03": "rewritten", "2024-04": "kept"}
    after = dict(table.folders())
    assert sorted(after) == ["2024-03", "2024-04"] and after["2024-04"] == before["2024-04"] and after["2024-03"] != before["2024-03"]
    assert rows(table.read(), "k") == [(5,), (6,), (7,)]
    # Whole months alone: no rows are written.
    written = files.children(spark, f"{tmp_path}/data")
    assert ops.purge(table, "at", datetime(2024, 4, 30), 29) == {"2024-03": "dropped", "2024-04": "kept"}
    assert files.children(spark, f"{tmp_path}/data") == written
    assert ops.purge(table, "at", datetime(2024, 4, 30), 29) == {"2024-04": "kept"}


def test_old_folders_go_when_no_list_names_them(spark, tmp_path):
    table = stored(spark, tmp_path, DAYS)
    assert table.read("2024-02").count() == 2 and table.read().count() == 9
    reader = table.read()  # of the first list
    table.change(["2024-01"], spark.createDataFrame([(90, datetime(2024, 1, 9)), (91, datetime(2024, 2, 9))], EVENTS))
    assert rows(table.read("2024-01"), "k") == [(90,)] and rows(table.read("2024-02"), "k") == [(2,), (3,), (91,)]
    assert table.remove_old(keep=2) == 0 and reader.count() == 9
    assert table.remove_old(keep=1) == 1
    assert table.read().count() == 9 and table.remove_old(keep=1) == 0
    table.delete_where(F.lit(True))
    assert table.read().count() == 0 and table.folders() == []


def test_old_versions_go(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), spark.range(1).schema)
    for k in range(4):
        table.replace(spark.range(k))
    assert table.remove_old(keep=2) == [1, 2] and table.read().count() == 3 and table.remove_old(keep=2) == []


def test_old_quarantine_goes_by_folder(spark, tmp_path):
    bad = spark.createDataFrame([("r",)], "quarantine_reason string")
    for day in (1, 2, 3):
        files.write_quarantine(bad, str(tmp_path), "sales", datetime(2024, 1, day))
        files.write_snapshot(bad, str(tmp_path), "sales", datetime(2024, 1, day))
    assert len(files.drop_old_quarantine(spark, str(tmp_path), ["sales", "none"], datetime(2024, 1, 3))) == 2
    assert rows(files.read_quarantine_log(spark, str(tmp_path), ["sales"])) == [("sales", "r", datetime(2024, 1, 3))]
    assert files.read_snapshots(spark, str(tmp_path), "sales", bad.schema).count() == 3


def person(key, city, start, end=None, version=1, customer="C1"):
    return (key, customer, "Ann", "a@x.org", "1", city, start, end, end is None, version)


def test_a_snapshot_writes_current_versions_only(spark, work, tmp_path):
    schema = STAR["dim_customer"]
    history = PartedTable(spark, str(tmp_path), schema, scd.history_part())
    a, b, c = datetime(2024, 1, 1), datetime(2024, 2, 5), datetime(2024, 3, 9)
    held = spark.createDataFrame([person(1, "Goa", a, b), person(3, "Pune", b, None, 2), person(2, "Delhi", a, customer="C2")], schema)
    history.replace(held)
    before = dict(history.folders())
    staged = spark.createDataFrame([("C1", "Ann", "a@x.org", "1", "Agra"), ("C2", "Ann", "a@x.org", "1", "Delhi"), ("C9", "Cy", None, None, "Goa")], "customer_id string, name string, email string, phone string, city string")
    scd.apply_to_parts(history, staged, c, work)
    after = dict(history.folders())
    assert sorted(after) == ["2024-02", "2024-03", scd.CURRENT] and after["2024-02"] == before["2024-02"]
    extended = held.unionByName(scd.new_customers(held, staged, c, work))
    assert rows(history.read()) == rows(scd.apply_snapshot(work.save(extended, "extended"), staged, c, work))


def test_history_at_a_time_with_many_versions_of_one_id(spark):
    days = [datetime(2020, 1, 1)]
    from datetime import timedelta

    starts = [days[0] + timedelta(days=k, hours=k % 5) for k in range(1000)]
    versions = [("hot", s, e, k + 1, f"c{k}") for k, (s, e) in enumerate(zip(starts, [*starts[1:], None]))]
    versions += [("b", datetime(2021, 1, 1), datetime(2021, 6, 1), 1, "x"), ("c", datetime(2019, 1, 1), None, 1, "y")]
    history = spark.createDataFrame(versions, "customer_id string, valid_from timestamp, valid_to timestamp, version int, city string")
    facts = [("hot", datetime(2020, 1, 1) + timedelta(hours=9 * k)) for k in range(3000)]
    facts += [("b", datetime(2020, 12, 31)), ("b", datetime(2021, 1, 1)), ("b", datetime(2021, 6, 1)), ("c", datetime(2020, 5, 5)), ("d", datetime(2020, 5, 5)), ("c", None)]
    told = spark.createDataFrame(facts, "who string, at timestamp")
    expected = []
    for who, at in facts:
        for c, s, e, v, city in versions:
            if at is not None and c == who and s <= at and (e is None or at < e):
                expected.append((who, at, v, city))
    found = scd.customers_at(history, told, "who", "at", columns=("city",))
    assert rows(found, "who", "at", "version", "city") == sorted(expected, key=str)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "_bucket" in plan
    assert scd.customers_at(history, told.limit(0), "who", "at", columns=("city",)).count() == 0


def test_a_version_is_not_repeated_for_the_months_it_lasts(spark):
    """A version open for three thousand years, beside many short ones; facts, versions and their copies meet as in SQL."""
    history = spark.range(300).selectExpr("id % 3 customer_id", "timestamp'2000-01-01' + make_dt_interval(id) valid_from", "if(id % 7 = 0, null, timestamp'2000-01-05' + make_dt_interval(id)) valid_to", "cast(id as int) version", "concat('c', id) city")
    history = history.unionByName(spark.sql("select 9L customer_id, timestamp'0001-01-01' valid_from, cast(null as timestamp) valid_to, 1 version, 'Old' city"))
    history = history.unionByName(history.where("version = 8")).unionByName(spark.sql("select cast(null as bigint) customer_id, timestamp'2000-01-01' valid_from, cast(null as timestamp) valid_to, 1 version, 'x' city"))
    facts = spark.range(200).selectExpr("id fact", "if(id % 50 = 0, null, if(id % 4 = 3, 9L, id % 4)) who", "if(id = 7, timestamp'3000-01-01', timestamp'1999-12-30' + make_dt_interval(id)) at")
    found = scd.customers_at(history, facts, "who", "at", columns=("city",), chunk=16)
    history.createOrReplaceTempView("versions_held")
    facts.createOrReplaceTempView("facts_held")
    told = spark.sql("select who, fact, at, version, city from facts_held join versions_held on who = customer_id and at >= valid_from and (valid_to is null or at < valid_to)")
    assert found.columns == told.columns and found.count() > 500 and rows(found) == rows(told)
    plan = found._jdf.queryExecution().toString()
    assert "sequence(" not in plan and "Explode" not in plan and "Broadcast" not in plan


def test_tables_of_the_model_are_packed_tightly(spark, tmp_path):
    from shelfsight.plans.model import RetailModel
    from shelfsight.sources import files

    spark.range(40).selectExpr("id l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    model = RetailModel(spark, str(tmp_path))
    names = files.children(spark, model.work.save(spark.range(5), "packed").inputFiles()[0].rpartition("/")[0])
    assert [n for n in names if n.startswith("part-")] and all(n.endswith(".zstd.parquet") for n in names if n.startswith("part-"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    with model.work.lent(spark.range(3), "lent") as lent:
        assert lent.count() == 3
    assert not [n for n in files.children(spark, model.work.path) if n.startswith("lent")]
