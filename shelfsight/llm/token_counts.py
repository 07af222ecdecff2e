"""Token counts from an exact histogram of encoded lengths.

Documents are aggregated by their encoded length. Every question about totals, quantiles or truncation at a context
limit is then answered from suffix sums over that histogram: with L tokens of context, a document gives min(n, L).

Defined results: null and empty texts have length 0 and are counted; an empty table gives no rows; ties can't occur, as a
length is one row; repeated rows count each time; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import count_tokens
from .common import saved

#: Lengths that one block of the suffix sums holds. Blocks are summed apart, then each is finished by itself.
BLOCK = 1024


def length_histogram(docs: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encoded length and number of documents that have it."""
    return histogram_of(count_tokens(docs, [], text, vocabulary), "n_tokens")


def histogram_of(lengths: DataFrame, column: str) -> DataFrame:
    """The histogram of lengths that are counted already; null counts as 0."""
    length = F.coalesce(F.col(column).cast("bigint"), F.lit(0).cast("bigint"))
    return lengths.groupBy(length.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length: documents and tokens of that length, and of documents at least as long."""
    blocks = histogram.withColumn("_block", F.expr(f"n_tokens div {BLOCK}")).withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    above = sums.select(
        "_block",
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_docs_above"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_tokens_above"),
    )
    inside = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.join(above, "_block").select(
        "n_tokens",
        "n_docs",
        (F.col("_docs_above") + F.sum("n_docs").over(inside)).alias("docs_from_here"),
        (F.col("_tokens_above") + F.sum("_tokens").over(inside)).alias("tokens_from_here"),
    )


def limits(histogram: DataFrame) -> DataFrame:
    """One row for every context limit at which an answer changes, that is for every length in the data.

    ``truncated_tokens`` is the total when documents are cut at ``context_limit``, ``docs_cut`` how many are longer,
    ``quantile_from`` and ``quantile_to`` the shares of documents that are shorter and that are at most as long: the
    q-quantile of the lengths is the row with quantile_from < q <= quantile_to.
    """
    histogram = saved(histogram, "lengths")  # a row for each length; the documents are encoded once
    sums = suffix_sums(histogram)
    every = histogram.agg(F.sum("n_docs")).scalar()
    total = histogram.agg(F.sum(F.col("n_tokens") * F.col("n_docs"))).scalar()
    shorter: Column = every - F.col("docs_from_here")
    return sums.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        (F.col("docs_from_here") - F.col("n_docs")).alias("docs_cut"),
        (total - F.col("tokens_from_here") + F.col("n_tokens") * F.col("docs_from_here")).alias("truncated_tokens"),
        total.alias("total_tokens"),
        (shorter / every).alias("quantile_from"),
        ((shorter + F.col("n_docs")) / every).alias("quantile_to"),
    )


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Total tokens and documents cut for one context limit, which needn't be a length in the data."""
    length, docs = F.col("n_tokens"), F.col("n_docs")
    return histogram.agg(
        F.coalesce(F.sum(F.least(length, F.lit(limit)) * docs), F.lit(0)).alias("truncated_tokens"),
        F.coalesce(F.sum(F.when(length > limit, docs)), F.lit(0)).alias("docs_cut"),
    )
