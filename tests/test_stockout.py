from datetime import datetime
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shelfsight.operators import stockout
from shelfsight.schemas import LOGS, STAR

FEATURES = "product_id string, store_id string, category string, current_stock int, avg_qty double, std_qty double"


@pytest.fixture(scope="module")
def feats(spark):
    data = [
        (f"P{i}", f"S{i % 5}", ("Toys", "Food")[i % 2], (i * 37) % 40, float((i * 11) % 23), 1.0 + i % 3) for i in range(400)
    ]
    return spark.createDataFrame(data, FEATURES)


@pytest.fixture(scope="module")
def models(feats):
    return stockout.train(feats, trees=20, rounds=15)


def test_features(spark):
    inventory = spark.createDataFrame(
        [(None, 20240131, 1, 1, 9, 20), (None, 20240229, 1, 1, 3, 20), (None, 20240131, 2, 1, 7, 20)], STAR["fact_inventory"]
    )
    money = (Decimal("1.0000"), Decimal("0.0000"))
    sales = spark.createDataFrame([("a", 20240101, 1, 1, 1, 2, *money), ("b", 20240102, 1, 1, 1, 4, *money)], STAR["fact_sales"])
    products = spark.createDataFrame([(i, f"P{i}", "n", "Toys", None, Decimal("1.00")) for i in (1, 2)], STAR["dim_product"])
    stores = spark.createDataFrame([(1, "S1", "n", "Pune", "West")], STAR["dim_store"])
    found = stockout.features(sales, inventory, products, stores)
    assert rows(found) == [("P1", "S1", "Toys", 3, 3.0, pytest.approx(2**0.5)), ("P2", "S1", "Toys", 7, 0.0, 0.0)]
    one = stockout.features(sales.limit(1), inventory, products, stores)
    assert rows(one.where("product_id = 'P1'"), "std_qty") == [(0.0,)]


def test_labels(spark):
    df = spark.createDataFrame([("a", "s", "c", 3, 4.0, 1.0), ("b", "s", "c", 4, 4.0, 1.0), ("c", "s", "c", 50, 4.0, 1.0)], FEATURES)
    assert rows(stockout.labels(df), "product_id", "risk", "reorder_qty") == [("a", 1, 5.0), ("b", 0, 4.0), ("c", 0, 0.0)]


def test_levels_and_explanation(spark):
    df = spark.createDataFrame([(p,) for p in (0.81, 0.8, 0.6, 0.4, 0.39)], "p double").selectExpr(
        "'P' product_id", "'S' store_id", "p", "8 current_stock", "0.0D avg_qty", "2.0D std_qty"
    )
    scored = stockout.explained(df, F.col("p"), F.lit(7.9)).orderBy(F.desc("confidence")).collect()
    assert [r["risk_level"] for r in scored] == ["Critical", "High", "Medium", "Low", "Low"]
    assert scored[0]["recommended_reorder"] == 7 and scored[0]["volatility_cv"] == 0.0
    assert scored[0]["explanation_json"] == (
        '{"risk_level":"Critical","ml_confidence":81.0,"current_stock":8.0,"avg_daily_demand":0.0,"volatility_cv":0.0}'
    )


def test_models_follow_the_label_rule(feats, models, tmp_path):
    scored = stockout.score(models, feats)
    quality = stockout.model_quality(scored, feats).first()
    assert quality["pairs"] == 400 and quality["accuracy"] > 0.9 and quality["reorder_mean_error"] < 3
    assert stockout.lookup(scored, "P7", "S2").count() == 1 and stockout.lookup(scored, "P7", "S9").count() == 0
    models.save(str(tmp_path / "m"))
    again = stockout.score(stockout.RiskModels.load(str(tmp_path / "m")), feats)
    assert rows(again, "product_id", "confidence") == rows(scored, "product_id", "confidence")


def test_unseen_category_is_scored(spark, models):
    new = spark.createDataFrame([("X", "S", "Garden", 1, 9.0, 1.0)], FEATURES)
    assert stockout.score(models, new).count() == 1


def test_one_class_needs_no_classifier(spark):
    df = spark.createDataFrame([(f"P{i}", "S", "c", 50 + i, 4.0, 1.0) for i in range(20)], FEATURES)
    models = stockout.train(df, rounds=2)
    assert models.classifier is None
    assert {(r["confidence"], r["risk_level"]) for r in stockout.score(models, df).collect()} == {(0.0, "Low")}


def test_no_rows_no_model(feats):
    assert stockout.train(feats.limit(0)) is None
    assert stockout.score(None, feats).count() == 0


def test_codes_of_many_categories(spark, work):
    names = spark.range(100_000).selectExpr("concat('c', lpad(id * 7 % 100000, 6, '0')) category", "id")
    codes = stockout.category_codes(names.unionByName(names.limit(5).selectExpr("cast(null as string) category", "id")), work)
    assert codes.count() == 100_000 and codes.where("category <> concat('c', lpad(category_code, 6, '0'))").count() == 0
    asked = spark.createDataFrame([("c000007",), ("zz",), (None,)], "category string")
    assert rows(stockout.with_codes(asked, codes), "category", "category_code") == sorted([("c000007", 7), ("zz", 100_000), (None, 100_000)], key=str)


def test_category_codes(feats):
    assert rows(stockout.category_codes(feats)) == [("Food", 0), ("Toys", 1)]


def log(spark, *entries):
    return spark.createDataFrame(list(entries), LOGS["ml_reasoning_log"])


def test_log_ids_continue(spark, work, feats):
    held = log(spark, (41, datetime(2024, 1, 1), "m", "P", "S", 1.0, 0.5, "{}"))
    added = stockout.log_rows(stockout.rule_score(feats.limit(3)), F.lit(datetime(2024, 1, 2)), held, work)
    assert rows(added, "id") == [(42,), (43,), (44,)]
    assert added.columns == LOGS["ml_reasoning_log"].names


def test_feed_survives_bad_json(spark):
    good = '{"risk_level":"High","current_stock":8.0,"avg_daily_demand":4.0}'
    entries = log(
        spark,
        (1, datetime(2024, 1, 1), "m", "P1", "S1", 5.9, 0.7, "{broken"),
        (2, datetime(2024, 1, 2), "m", "P1", "S1", 5.9, 0.7, good),
        (3, datetime(2024, 1, 3), "m", "P2", "S1", 5.0, 0.7, None),
    )
    feed = [(r["decision_id"], r["impact"], r["action"]) for r in stockout.decision_feed(entries).collect()]
    assert feed == [
        ("ML-3", "Unknown stockout risk", "Recommend reorder of 5 units"),
        ("ML-2", "High stockout risk", "Recommend reorder of 5 units"),
        ("ML-1", "Unknown stockout risk", "Recommend reorder of 5 units"),
    ]
    assert [r["id"] for r in stockout.reasoning(entries, 2).collect()] == [3, 2]
    products = spark.createDataFrame([(1, "P1", "Pen", "Toys", None, Decimal("1.00"))], STAR["dim_product"])
    stores = spark.createDataFrame([(1, "S1", "One", "Pune", "West")], STAR["dim_store"])
    assert rows(stockout.latest_risks(entries, products, stores), "product_name", "store_name", "days_remaining") == [("Pen", "One", 2.0)]
    assert stockout.decision_feed(entries.limit(0)).count() == 0


def test_scan_puts_severe_first(spark):
    scored = spark.createDataFrame(
        [("a", "s", 0.3, 1, "Low"), ("b", "s", 0.5, 1, "Medium"), ("c", "s", 0.9, 1, "Critical"), ("d", "s", 0.7, 1, "High")],
        "product_id string, store_id string, confidence double, recommended_reorder int, risk_level string",
    )
    assert [r["risk_level"] for r in stockout.scan_all(scored).collect()] == ["Critical", "High", "Medium", "Low"]


def test_the_rounds_run_over_a_table_bounded_by_the_ranges(spark, monkeypatch):
    """Sixty thousand pairs with values of their own; the rows both learners take are as many as ranges, not as pairs."""
    seen = []
    fit = stockout.Stages.fit
    monkeypatch.setattr(stockout.Stages, "fit", lambda stages, data: seen.append(data.agg(F.count("*"), F.sum("pairs")).first()) or fit(stages, data))
    many = spark.range(60_000).selectExpr("concat('P', id) product_id", "'S' store_id", "'Toys' category", "cast(id * 37 % 100 as int) current_stock", "id * 11 % 601 / 7.0D avg_qty", "0.0D std_qty")
    models = stockout.train(many, trees=10, rounds=10)
    assert len(seen) == 2 and all(rows <= 2 * 32 * 32 and pairs == 60_000 for rows, pairs in seen) and models.rows == 60_000
    quality = stockout.model_quality(stockout.score(models, many), many).first()
    assert quality["pairs"] == 60_000 and quality["accuracy"] > 0.9


def test_decisions_of_two_days_are_written_once(spark, feats, work):
    from shelfsight.plans.model import RetailModel
    from shelfsight.sources import files

    model = RetailModel.__new__(RetailModel)
    model.work = type(work)(spark, "two_days")
    model.spark, model.rule_scores = spark, stockout.rule_score(feats.limit(30))
    log = model.decision_log
    assert [r["id"] for r in log.orderBy("timestamp", "product_id", "store_id").collect()] == list(range(1, 61))
    assert [name.partition("-")[0] for name in files.children(spark, model.work.path)] == ["decisions"]


def test_pairs_alike_in_all_ranges_are_scored_once(spark, feats, models, work, monkeypatch):
    """Each pair gets what the models say of it alone, though they see fewer rows than there are pairs."""
    coded = models.regressor.transform(stockout.with_codes(feats, models.codes))
    alone = models.classifier.transform(coded).select(
        "product_id", "store_id", stockout.vector_to_array("risk_probability")[1].alias("confidence"), F.col("reorder_prediction").cast("int").alias("recommended_reorder")
    )
    seen = []
    monkeypatch.setattr(work, "save", lambda df, name: seen.append((name, df.count())) or type(work).save(work, df, name))
    twice = feats.unionByName(feats.withColumn("store_id", F.concat("store_id", F.lit("b"))))
    scored = stockout.score(models, twice, work)
    assert seen == [("alike_scores", coded.select(*stockout.BINNED).distinct().count())] and seen[0][1] <= 400 and scored.count() == 800
    got = scored.select("product_id", F.regexp_replace("store_id", "b$", "").alias("store_id"), "confidence", "recommended_reorder")
    assert rows(got) == sorted(2 * rows(alone), key=str)


def test_ranges_take_two_passes_and_gather_few_values(spark):
    many = spark.range(0, 50_000, 1, 4).selectExpr("cast(if(id % 9 = 0, null, id % 7) as int) current_stock", "id / 7.0D avg_qty", "0.0D std_qty", "cast(id % 40 as int) category_code")
    gathered = many.select(*(F.col(c).cast("double").alias(c) for c in stockout.FEATURES)).mapInArrow(stockout._few_values, "column int, value double")
    assert gathered.count() < 50_000 / 10
    found = dict(zip(stockout.FEATURES, stockout._ranges(many).getSplitsArray()))
    inf = float("inf")
    assert found["current_stock"] == [-inf, *(float(i) for i in range(1, 7)), inf] and found["std_qty"] == [-inf, 0.0, inf]
    for name in ("avg_qty", "category_code"):
        cuts = many.select(F.col(name).cast("double").alias(name)).approxQuantile(name, [k / 32 for k in range(1, 32)], stockout.RANK_ERROR)
        assert found[name] == [-inf, *sorted(set(cuts)), inf]


def test_models_score_in_a_session_that_observed_something(spark, feats):
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 5}
    models = stockout.train(feats, trees=3, rounds=2)
    assert models.classifier is not None and not models.classifier.stages[0].hasSummary and stockout.score(models, feats).count() == 400
