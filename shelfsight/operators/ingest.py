"""Validation at ingest: split rows into valid and quarantined, report drift and counts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schemas import RAW, Registry, TableRule, raw_fields
from ..sources import files

REASON = "quarantine_reason"
UNREADABLE = "unreadable_value"

# Logical tables of one batch and the files they come from.
BATCH_TABLES = tuple((name, f"{name}.csv") for name in (
    "customers", "products", "stores", "inventory", "transactions", "shipments", "web_clickstream"
))


def with_reason(df: DataFrame, rule: TableRule) -> DataFrame:
    """Add the reasons a row breaks the rule, alphabetically and ';'-joined; '' when it breaks none.

    A row that holds a value its column can't, with its text in ``_corrupt``, is unreadable.
    """
    absent = sorted(c for c in rule.required if c not in df.columns)
    present = sorted(c for c in rule.required if c in df.columns)
    parts = [F.lit(f"missing_required_column:{c}") for c in absent]
    parts += [F.when(F.col(c).isNull(), F.lit(f"missing_required_value:{c}")) for c in present]
    if files.CORRUPT in df.columns:
        parts.append(F.when(F.col(files.CORRUPT).isNotNull(), F.lit(UNREADABLE)))
    reason = F.concat_ws(";", *parts) if parts else F.lit("")
    return df.withColumn(REASON, reason)


def valid_rows(df: DataFrame, rule: TableRule) -> DataFrame:
    return with_reason(df, rule).where(F.col(REASON) == "").drop(REASON, files.CORRUPT)


def quarantined_rows(df: DataFrame, rule: TableRule) -> DataFrame:
    return with_reason(df, rule).where(F.col(REASON) != "")


def drifted_columns(df: DataFrame, rule: TableRule) -> list[str]:
    """Columns the rule does not know; they stay in the valid output."""
    return sorted(c for c in df.columns if c not in rule.known and c not in (files.CORRUPT, files.POSITION))


def row_counts(df: DataFrame, rule: TableRule) -> DataFrame:
    """One row (table_name, valid_rows, quarantined_rows) from a single pass."""
    bad = F.col(REASON) != ""
    return with_reason(df, rule).agg(
        F.lit(rule.name).alias("table_name"),
        F.count_if(~bad).alias("valid_rows"),
        F.count_if(bad).alias("quarantined_rows"),
    )


@dataclass(frozen=True)
class TableResult:
    table_name: str
    valid_rows: int
    quarantined_rows: int
    new_columns: tuple[str, ...] = ()


def land(df: DataFrame, rule: TableRule, root: str, at: datetime, hold: bool = False) -> TableResult:
    """Store the valid and the rejected rows in one write; their numbers are observed while it runs.

    The rows are read once. Each file belongs to one task of the write, and what a task that is run again had counted is dropped, so the
    numbers are those of the files. With ``hold``, the valid rows of a table that has new columns are held apart.
    """
    drifted = tuple(drifted_columns(df, rule))
    seen, bad = Observation(), F.col(REASON) != ""
    judged = with_reason(df, rule).withColumn("state", F.when(bad, files.QUARANTINED).otherwise(files.HELD if hold and drifted else files.VALID))
    kept = judged if files.CORRUPT in df.columns else judged.withColumn(files.CORRUPT, F.lit(None).cast("string"))
    files.write_split(kept.observe(seen, F.count_if(~bad).alias("valid"), F.count_if(bad).alias("rejected")), root, rule.name, at)
    counts = seen.get
    return TableResult(rule.name, counts.get("valid", 0), counts.get("rejected", 0), drifted)


def counts_table(spark: SparkSession, results: list[TableResult]) -> DataFrame:
    """(table_name, valid_rows, quarantined_rows) as observed."""
    return spark.createDataFrame([(r.table_name, r.valid_rows, r.quarantined_rows) for r in results], "table_name string, valid_rows bigint, quarantined_rows bigint")


def reason_counts(df: DataFrame, rule: TableRule) -> DataFrame:
    return quarantined_rows(df, rule).groupBy(REASON).agg(F.count(F.lit(1)).alias("row_count"))


class BatchIngest:
    """Read the CSV files of a batch, each once, keep valid rows as snapshots, quarantine the rest."""

    def __init__(self, spark: SparkSession, registry: Registry, raw: str, out: str) -> None:
        self.spark, self.registry, self.raw, self.out = spark, registry, raw, out

    def run_table(self, table: str, file_name: str, at: datetime, hold: bool = False) -> TableResult:
        rule = self.registry.rule(table)
        path = f"{self.raw}/{file_name}"
        if not files.exists(self.spark, path):
            return TableResult(table, 0, 0)
        if table == "inventory":
            df = files.read_csv(self.spark, path, RAW[table])
        else:
            # Cleaning keeps the first of several copies of a sale, so only sales carry their position.
            df = files.read_csv_by_name(self.spark, path, raw_fields(table), position=table == "transactions")
        return land(df, rule, self.out, at, hold)

    def run_all(self, at: datetime, tables: tuple[tuple[str, str], ...] = BATCH_TABLES, hold: bool = False) -> list[TableResult]:
        return [self.run_table(table, file_name, at, hold) for table, file_name in tables]


def batch_totals(results: list[TableResult]) -> dict[str, int]:
    return {
        "total_rows": sum(r.valid_rows for r in results),
        "quarantined_rows": sum(r.quarantined_rows for r in results),
    }
