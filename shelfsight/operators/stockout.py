"""Stock-out risk: features, labels, tree models, scored decisions and their log."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml import Pipeline as Stages
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.keys import assign_keys
from ..schemas import EXPLANATION
from ..workspace import Workspace

FEATURES = ["current_stock", "avg_qty", "std_qty", "category_code"]
#: The trees see each feature in at most so many ranges, numbered; no more than their learner tells apart by itself.
BINS, RANK_ERROR = 32, 0.001
BINNED = [f"{c}_bin" for c in FEATURES]
LEVELS = ((0.8, "Critical"), (0.6, "High"), (0.4, "Medium"))
SEVERITY = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
MODEL_NAME = "stockout_risk_classifier"
_MODEL_FACTS = "constant_risk double, rows long"
_CODES = "category string, category_code int"


def features(sales: DataFrame, inventory: DataFrame, products: DataFrame, stores: DataFrame) -> DataFrame:
    """Latest stock and quantity statistics per (product, store) that has stock."""
    pair = ["product_key", "store_key"]
    # By date, then by stock, in one number: the aggregate keeps two numbers per pair and hashes.
    recency = F.col("date_key").cast("bigint") * (1 << 32) + F.coalesce("stock_level", F.lit(0))
    latest = inventory.groupBy(*pair).agg(F.max_by("stock_level", recency).alias("current_stock"))
    stats = sales.groupBy(*pair).agg(
        F.avg("quantity").alias("avg_qty"), F.coalesce(F.stddev_samp("quantity"), F.lit(0.0)).alias("std_qty")
    )
    return (
        latest.join(stats, pair, "left")
        .join(products.select("product_key", "product_id", "category"), "product_key")
        .join(stores.select("store_key", "store_id"), "store_key")
        .select(
            "product_id",
            "store_id",
            "category",
            "current_stock",
            F.coalesce("avg_qty", F.lit(0.0)).alias("avg_qty"),
            F.coalesce("std_qty", F.lit(0.0)).alias("std_qty"),
        )
    )


def labels(feats: DataFrame) -> DataFrame:
    """Risk when the stock is below the average sale, and the reorder quantity that covers two."""
    stock = F.col("current_stock").cast("double")
    return feats.withColumn("risk", (stock < F.col("avg_qty")).cast("int")).withColumn(
        "reorder_qty", F.greatest(F.col("avg_qty") * 2 - stock, F.lit(0.0))
    )


def category_codes(feats: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(category, category_code): the categories numbered in alphabetical order, from 0. A table made on the cluster."""
    work = work or Workspace(feats.sparkSession, "models")
    known = feats.select("category").where("category IS NOT NULL").distinct()
    keyed = assign_keys(known, ["category"], "_key", work, "categories")
    return work.save(keyed.select("category", (F.col("_key") - 1).cast("int").alias("category_code")), "category_codes")


def with_codes(feats: DataFrame, codes: DataFrame) -> DataFrame:
    """Features with the code of their category; those without one, or of one not in the table, share the next number."""
    unseen = codes.agg(F.count(F.lit(1)).cast("int")).scalar()
    return feats.join(codes, "category", "left").withColumn("category_code", F.coalesce("category_code", unseen))


@dataclass
class RiskModels:
    """Category codes and fitted stages; those of the regressor begin with the ranges and vectors that both models take. ``constant_risk`` stands in for the classifier when only one class was seen."""

    codes: DataFrame
    classifier: PipelineModel | None
    regressor: PipelineModel
    constant_risk: float | None
    rows: int

    def save(self, path: str) -> None:
        self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        self.regressor.write().overwrite().save(f"{path}/regressor")
        if self.classifier is not None:
            self.classifier.write().overwrite().save(f"{path}/classifier")
        facts = SparkSession.getActiveSession().createDataFrame([(self.constant_risk, self.rows)], _MODEL_FACTS)
        facts.coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def load(cls, path: str) -> "RiskModels":
        constant, rows = SparkSession.getActiveSession().read.schema(_MODEL_FACTS).parquet(f"{path}/facts").first()
        return cls(
            SparkSession.getActiveSession().read.schema(_CODES).parquet(f"{path}/codes"),
            None if constant is not None else PipelineModel.load(f"{path}/classifier"),
            PipelineModel.load(f"{path}/regressor"),
            constant,
            rows,
        )


def _few_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(column, value) of a batch: the values of each column, or just more than ``BINS`` of them."""
    for batch in batches:
        found = [np.unique(column.drop_null().to_numpy(zero_copy_only=False))[: BINS + 1] for column in batch.columns]
        at = np.repeat(np.arange(len(found), dtype="i4"), [len(values) for values in found])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate(found))], ["column", "value"])


def _ranges(coded: DataFrame) -> Bucketizer:
    """Numbers the ranges of each feature: its values if there are no more than ``BINS``, else quantiles over all rows.

    All features take one pass each way. Of a feature with many values few leave a batch, so these are never gathered.
    """
    numbers = coded.select(*(F.col(c).cast("double").alias(c) for c in FEATURES))
    values = numbers.mapInArrow(_few_values, "column int, value double").distinct()
    first = F.row_number().over(Window.partitionBy("column").orderBy("value")) <= BINS + 1
    limits: dict[str, list[float]] = {c: [] for c in FEATURES}
    for row in values.withColumn("_first", first).where("_first").orderBy("value").collect():
        limits[FEATURES[row["column"]]].append(row["value"])
    many = [c for c in FEATURES if len(limits[c]) > BINS]
    if many:
        cuts = numbers.approxQuantile(many, [k / BINS for k in range(1, BINS)], RANK_ERROR)
        limits |= {c: [float("-inf"), *found] for c, found in zip(many, cuts)}
    splits = [[float("-inf"), *sorted(set(limits[c][1:])), float("inf")] for c in FEATURES]
    # A bucketizer wants three limits at least; the first range of a feature with one value stays empty.
    return Bucketizer(splitsArray=[s if len(s) > 2 else [s[0], 0.0, s[1]] for s in splits], inputCols=FEATURES, outputCols=BINNED)


def train(
    feats: DataFrame, trees: int = 50, rounds: int = 100, depth: int = 3, seed: int = 42, work: Workspace | None = None
) -> RiskModels | None:
    """Random forest for the risk and boosted trees for the reorder quantity; None without rows."""
    classes = [(r["risk"], r["count"]) for r in labels(feats).groupBy("risk").count().collect()]
    if not classes:
        return None
    codes = category_codes(feats, work)
    coded = with_codes(labels(feats), codes)
    ranges, vectors = _ranges(coded), VectorAssembler(inputCols=BINNED, outputCol="features")
    # Pairs alike in all ranges and in risk are one row with their number as its weight, so the many rounds run over a table whose
    # size is bounded by the ranges. Splits and leaves of the boosted trees depend on sums, which the mean and the weight keep.
    alike = ranges.transform(coded).groupBy(*BINNED, "risk").agg(F.count(F.lit(1)).cast("double").alias("pairs"), F.avg("reorder_qty").alias("reorder_qty"))
    # Written once, so that the small table comes back in few partitions for the many rounds.
    alike = (work or Workspace(feats.sparkSession, "models")).save(alike, "alike_pairs")
    data = vectors.transform(alike).select("features", F.col("risk").cast("double").alias("risk"), "reorder_qty", "pairs")
    data = data.persist()
    try:
        forest = RandomForestClassifier(
            featuresCol="features", labelCol="risk", weightCol="pairs", numTrees=trees, maxDepth=8, seed=seed, probabilityCol="risk_probability",
            rawPredictionCol="risk_votes", predictionCol="risk_prediction",
        )
        boosted = GBTRegressor(
            featuresCol="features", labelCol="reorder_qty", weightCol="pairs", predictionCol="reorder_prediction", maxIter=rounds,
            stepSize=0.1, maxDepth=depth, seed=seed,
        )
        single = float(classes[0][0]) if len(classes) == 1 else None
        # A fitted forest holds its summary and so the session, which can't be sent to tasks once anything was observed in it. A copy holds none.
        classifier = None if single is not None else PipelineModel([stage.copy() for stage in Stages(stages=[forest]).fit(data).stages])
        regressor = PipelineModel([ranges, vectors, *Stages(stages=[boosted]).fit(data).stages])
        return RiskModels(codes, classifier, regressor, single, sum(n for _, n in classes))
    finally:
        data.unpersist()


def score(models: RiskModels | None, feats: DataFrame, work: Workspace | None = None) -> DataFrame:
    """Probability, reorder quantity and explanation for every pair; no rows without models.

    The trees see ranges, so pairs alike in all of them have one score: it is computed once, written, and joined to them.
    """
    if models is None:
        empty = feats.where(F.lit(False))
        return explained(empty, F.lit(0.0), F.lit(0.0))
    ranges, *stages = models.regressor.stages
    ranged = ranges.transform(with_codes(feats, models.codes))
    ready = PipelineModel(stages).transform(ranged.select(*BINNED).distinct())
    if models.classifier is None:
        probability = F.lit(models.constant_risk)
    else:
        ready = models.classifier.transform(ready)
        probability = vector_to_array("risk_probability")[1]
    scores = ready.select(*BINNED, probability.alias("_probability"), F.col("reorder_prediction").alias("_reorder"))
    scores = (work or Workspace(feats.sparkSession, "models")).save(scores, "alike_scores")
    return explained(ranged.join(scores, BINNED), F.col("_probability"), F.col("_reorder"))


def rule_score(feats: DataFrame) -> DataFrame:
    """Scores straight from the label rule, without a model."""
    labelled = labels(feats)
    return explained(labelled, F.col("risk").cast("double"), F.col("reorder_qty"))


def risk_level(probability: Column) -> Column:
    label = F.lit("Low")
    for limit, name in reversed(LEVELS):
        label = F.when(probability > limit, name).otherwise(label)
    return label


def severity(level: Column) -> Column:
    rank = F.lit(0)
    for name, value in SEVERITY.items():
        rank = F.when(level == name, value).otherwise(rank)
    return rank


def explained(df: DataFrame, probability: Column, reorder: Column) -> DataFrame:
    """Scored pairs with the explanation as JSON text."""
    volatility = F.when(F.col("avg_qty") > 0, F.round(E.ratio(F.col("std_qty"), F.col("avg_qty")), 2)).otherwise(F.lit(0.0))
    scored = df.withColumn("confidence", probability).select(
        "product_id",
        "store_id",
        F.col("confidence"),
        reorder.cast("int").alias("recommended_reorder"),
        risk_level(F.col("confidence")).alias("risk_level"),
        F.round(F.col("confidence") * 100, 2).alias("ml_confidence"),
        F.col("current_stock").cast("double").alias("current_stock"),
        F.col("avg_qty").alias("avg_daily_demand"),
        volatility.alias("volatility_cv"),
    )
    return scored.withColumn("explanation_json", F.to_json(F.struct(*EXPLANATION.names)))


def lookup(scored: DataFrame, product_id: str, store_id: str) -> DataFrame:
    """The score of one pair, or no row."""
    return scored.where((F.col("product_id") == product_id) & (F.col("store_id") == store_id))


def scan_all(scored: DataFrame) -> DataFrame:
    """All pairs, most severe first."""
    return (
        scored.withColumn("confidence_pct", F.round(F.col("confidence") * 100, 1))
        .orderBy(F.desc(severity(F.col("risk_level"))), F.desc("confidence_pct"), "product_id", "store_id")
        .select("product_id", "store_id", "risk_level", "confidence_pct", "recommended_reorder")
    )


def log_rows(scored: DataFrame, at: datetime | Column, log: DataFrame, work: Workspace, name: str = "decisions") -> DataFrame:
    """Decisions as rows for the reasoning log, with ids that go on from the largest logged one."""
    stamp = at if isinstance(at, Column) else F.lit(at)
    rows = scored.select(
        stamp.cast("timestamp").alias("timestamp"),
        F.lit(MODEL_NAME).alias("model_name"),
        "product_id",
        "store_id",
        F.col("recommended_reorder").cast("double").alias("prediction"),
        "confidence",
        "explanation_json",
    )
    largest = log.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return assign_keys(rows, ["timestamp", "product_id", "store_id"], "id", work, name, after=largest)


def _explained(name: str) -> Column:
    """A part of the explanation; text that is missing or not JSON gives the default."""
    text = F.get_json_object("explanation_json", f"$.{name}")
    if name == "risk_level":
        return F.coalesce(text, F.lit("Unknown")).alias(name)
    return F.coalesce(text.try_cast("double"), F.lit(0.0)).alias(name)


def decision_feed(log: DataFrame, rows: int = 20) -> DataFrame:
    """Newest decisions in the words the feed shows."""
    newest = log.orderBy(F.desc("timestamp"), F.desc("id")).limit(rows)
    return newest.select(
        F.concat(F.lit("ML-"), F.col("id").cast("string")).alias("decision_id"),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("model_name").alias("decision_type"),
        F.concat_ws(" @ ", "product_id", "store_id").alias("entity"),
        F.concat(F.lit("Recommend reorder of "), F.col("prediction").cast("bigint").cast("string"), F.lit(" units")).alias(
            "action"
        ),
        "confidence",
        F.concat(_explained("risk_level"), F.lit(" stockout risk")).alias("impact"),
        F.lit("executed").alias("status"),
    )


def latest_risks(log: DataFrame, products: DataFrame, stores: DataFrame, rows: int = 20) -> DataFrame:
    """Latest High or Critical decision per pair with the days the stock lasts, shortest first.

    Decisions of a pair that share the latest time all count. The latest time is an aggregate, so a
    pair with a long log is reduced before it is shuffled.
    """
    pair = ["product_id", "store_id"]
    last = log.groupBy(*pair).agg(F.max("timestamp").alias("timestamp"))
    current = log.join(last, [*pair, "timestamp"], "left_semi").withColumn("risk_level", _explained("risk_level"))
    days = F.round(E.ratio(F.col("current_stock"), F.col("avg_daily_demand")), 1)
    return (
        current.where(F.col("risk_level").isin("High", "Critical"))
        .select("*", _explained("current_stock"), _explained("avg_daily_demand"))
        .join(products.select("product_id", F.col("name").alias("product_name")), "product_id")
        .join(stores.select("store_id", "store_name"), "store_id")
        .withColumn("days_remaining", days)
        .orderBy(F.asc_nulls_last("days_remaining"), "product_id", "store_id", "id")
        .limit(rows)
        .select(
            "store_id",
            "product_id",
            "product_name",
            "store_name",
            F.col("prediction").alias("recommended_reorder"),
            "confidence",
            "risk_level",
            "current_stock",
            "avg_daily_demand",
            "days_remaining",
        )
    )


def reasoning(log: DataFrame, rows: int = 50) -> DataFrame:
    """Newest predictions with the factors behind them."""
    newest = log.orderBy(F.desc("timestamp"), F.desc("id")).limit(rows)
    factors = ("risk_level", "current_stock", "avg_daily_demand", "volatility_cv")
    return newest.select(
        "id", "timestamp", "store_id", "product_id", "prediction", "confidence", *(_explained(f) for f in factors)
    )


def model_quality(scored: DataFrame, feats: DataFrame) -> DataFrame:
    """Agreement of the scores with the label rule."""
    truth = labels(feats).select("product_id", "store_id", "risk", "reorder_qty")
    hit = (F.col("confidence") > 0.5).cast("int") == F.col("risk")
    return scored.join(truth, ["product_id", "store_id"]).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg(hit.cast("double")).alias("accuracy"),
        F.avg(F.abs(F.col("recommended_reorder") - F.col("reorder_qty"))).alias("reorder_mean_error"),
    )
