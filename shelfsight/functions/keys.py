"""Surrogate keys without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace

_SEQ_BITS = 33


def assign_keys(
    df: DataFrame, order_by: list[str], key: str, work: Workspace, name: str, after: Column | None = None
) -> DataFrame:
    """Number the rows 1, 2, ... in ``order_by`` order, as ``ROW_NUMBER()`` over the whole table would.

    The rows are range-sorted across the cluster and written once with their (partition, position).
    The number of rows before each partition is then a table with one row per sort partition, so it is
    broadcast whatever the data size, and no task ever sees more than its own range.
    """
    positioned = work.save(df.orderBy(*order_by).withColumn("_pos", F.monotonically_increasing_id()), name)
    part = F.shiftright("_pos", _SEQ_BITS)
    sizes = positioned.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    sequence = F.col("_pos").bitwiseAND(F.lit((1 << _SEQ_BITS) - 1))
    base = F.lit(1) if after is None else after + F.lit(1)
    numbered = positioned.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.select((F.col("_start") + sequence + base).cast("bigint").alias(key), *df.columns)
