"""Cleaning of raw transactions and the report on what each step did.

Both outputs start from ``staged``: one row per transaction id with a flag per step. Spark pushes the
"first row per id" below the shuffle, so map tasks send one row per id and an id with many copies is
never gathered.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expressions as E
from ..sources.files import POSITION

CRITICAL = ("transaction_id", "product_id", "store_id")
SIGMAS = 3.0


def staged(raw: DataFrame, as_of: datetime, order_by: list[str] | None = None) -> DataFrame:
    """First row per transaction id with its repairs and flags, before any row is dropped.

    Of several copies the first in the raw files counts, where the rows carry their ``POSITION``. ``order_by`` states
    another order. Rows without a position go by all columns in order, NULLs last. NULL ids count as one id.
    """
    has_discount = "discount" in raw.columns
    other = [F.col(c).asc_nulls_last() for c in raw.columns if c != "transaction_id"]
    order = order_by or ([POSITION] if POSITION in raw.columns else other)
    place = F.row_number().over(Window.partitionBy("transaction_id").orderBy(*order))
    one_each = raw.withColumn("_place", place).where("_place = 1").drop("_place", POSITION)
    stamp = one_each.schema["date"].dataType.simpleString()
    when = F.try_to_timestamp("date") if stamp == "string" else F.col("date").cast("timestamp")
    return (
        one_each.withColumn("discount_was_null", F.col("discount").isNull() if has_discount else F.lit(False))
        .withColumn("discount", F.coalesce("discount", F.lit(0)) if has_discount else F.lit(0).cast("decimal(18,4)"))
        .withColumn("is_complete", _all_present(CRITICAL))
        .withColumn("price_was_negative", F.col("price") < 0)
        .withColumn("price", F.abs("price"))
        .withColumn("has_quantity", F.coalesce(F.col("quantity") > 0, F.lit(False)))
        .withColumn("date", when)
        .withColumn("is_past", F.coalesce(F.col("date") <= F.lit(as_of), F.lit(False)))
    )


def _all_present(columns: tuple[str, ...]) -> Column:
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    return present


def _kept() -> Column:
    return F.col("is_complete") & F.col("has_quantity") & F.col("is_past")


def _threshold(kept: DataFrame, sigmas: float) -> Column:
    """Anomaly limit as a scalar subquery; NULL (so no anomaly) for fewer than two rows."""
    price = F.col("price").cast("double")
    return kept.agg(F.avg(price) + F.lit(sigmas) * F.stddev_samp(price)).scalar()


def cleaned(stage: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """Rows that survive every step, with anomalous prices flagged and kept."""
    kept = stage.where(_kept())
    flag = F.coalesce(F.col("price").cast("double") > _threshold(kept, sigmas), F.lit(False))
    dropped = ("discount_was_null", "is_complete", "price_was_negative", "has_quantity", "is_past")
    return kept.withColumn("is_anomaly", flag).drop(*dropped)


def report(raw: DataFrame, stage: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """(metric, value) rows: what each step removed or repaired, plus the retention rate in percent."""
    limit = _threshold(stage.where(_kept()), sigmas)
    initial = raw.agg(F.count(F.lit(1))).scalar()
    complete, quantity, past = F.col("is_complete"), F.col("has_quantity"), F.col("is_past")
    counts = stage.agg(
        initial.alias("initial_rows"),
        (initial - F.count(F.lit(1))).alias("duplicates_removed"),
        F.count_if("discount_was_null").alias("nulls_fixed"),
        F.count_if(~complete).alias("critical_rows_removed"),
        F.count_if(complete & F.col("price_was_negative")).alias("invalid_values_fixed"),
        F.count_if(complete & ~quantity).alias("invalid_quantity_removed"),
        F.count_if(complete & quantity & ~past).alias("future_rows_removed"),
        F.count_if(_kept() & (F.col("price").cast("double") > limit)).alias("anomalies_flagged"),
        F.count_if(_kept()).alias("final_rows"),
    )
    names = counts.columns
    as_double = counts.select(
        *(F.col(c).cast("double").alias(c) for c in names),
        E.percent(F.col("final_rows"), F.col("initial_rows")).alias("retention_rate"),
    )
    return as_double.unpivot([], [*names, "retention_rate"], "metric", "value")
