"""File readers and writers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import stores

CORRUPT = "_corrupt"
#: Where a row stood: its file, the block of the file and the row within what one task read of it.
POSITION = "_position"
STAMP = "%Y%m%dT%H%M%S"
#: Packs what is written whole and kept (landed rows, versions of tables, tables of the retail model) tighter than Spark's default does.
TIGHT = "zstd"


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Headered CSV under an explicit schema; unreadable lines keep their text in ``_corrupt``.

    Columns follow the schema by position, so a file whose header names columns in another order than
    its data is read rightly once the schema states the data order. Read errors are retried per task by
    Spark (``spark.task.maxFailures``).
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path)
    )


def with_position(df: DataFrame) -> DataFrame:
    """Rows read from files with their ``POSITION``, which sorts as the rows stand in the files."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return df.select("*", place.alias(POSITION))


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files that a reader of ``path`` would read; none is opened."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def first_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, header) of the text files that hold anything.

    Tasks open each file of a list and read its first bytes, so the work follows the number of files and not their size. In a
    store that only Spark's readers reach, the first lines are looked for among all lines.
    """
    files = listed_files(spark, path)
    one = files.select("path").first()
    if one is None or stores.reaches(one["path"]):
        return files.select("path").mapInArrow(_headers, "path string, header string").where("header is not null")
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value"
    )
    return lines.where("block = 0").groupBy("path").agg(F.min_by("value", "row").alias("header"))


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        paths = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array([stores.first_line(p) for p in paths], pa.string())], ["path", "header"])


def csv_layouts(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """What to read of a CSV folder by the column names its files declare.

    Where all files declare the same, that is the folder itself and no file is named. Otherwise the files of each layout are.
    """
    first = first_lines(spark, path)
    headers = first.groupBy("header").agg(F.min("path").alias("path")).orderBy("header").collect()
    declared = {r["header"]: tuple(spark.read.option("header", True).option("inferSchema", False).csv(_named(r["path"])).columns) for r in headers}
    if len(set(declared.values())) == 1:
        return {columns: [path] for columns in declared.values()}
    layouts: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("header", "path").toLocalIterator():
        layouts.setdefault(declared[row["header"]], []).append(_named(row["path"]))
    return layouts


def _named(path: str) -> str:
    """A file's path as a pattern that only it matches."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def read_csv_by_name(spark: SparkSession, path: str, known: Iterable[T.StructField], position: bool = False) -> DataFrame:
    """CSV read by the column names of each file: known columns get their type, unknown ones stay text.

    This is the reader for inputs whose columns may drift. Files that declare the same columns are read together,
    the layouts are united by name, and a column that a file lacks is NULL in its rows.
    """
    types = {f.name: f.dataType for f in known}
    parts = []
    for columns, found in csv_layouts(spark, path).items():
        part = read_csv(spark, found, T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in columns]))
        part = with_position(part) if position else part
        parts.append(part.select(*(c for c in part.columns if c != CORRUPT), CORRUPT))
    if not parts:
        return spark.createDataFrame([], T.StructType([*known, T.StructField(CORRUPT, T.StringType())]))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names; no files are listed."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(context._jsc.hadoopConfiguration())
    return sorted(found.getPath().getName() for found in system.listStatus(place)) if system.exists(place) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def move(spark: SparkSession, path: str, target: str) -> None:
    """Move a file, into a folder that is made where there is none; a copy that an earlier try left there is replaced."""
    context = spark.sparkContext
    source, place = context._jvm.org.apache.hadoop.fs.Path(path), context._jvm.org.apache.hadoop.fs.Path(target)
    system = source.getFileSystem(context._jsc.hadoopConfiguration())
    system.mkdirs(place.getParent())
    system.delete(place, False)
    if not system.rename(source, place):
        raise OSError(f"{path} could not be moved to {target}")


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder in its file system."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


#: Endings of packed text, and how much smaller it is.
PACKED, PACKED_TIMES = r"\.(gz|bz2|deflate|zst|lz4|snappy)$", 8


def text_bytes(spark: SparkSession, path: str) -> int:
    """Size of the text files under a folder; of packed ones about that of their text."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    times = F.when(F.col("path").rlike(PACKED), PACKED_TIMES).otherwise(1)
    return found.agg(F.sum(F.col("length") * times)).first()[0] or 0


VALID, QUARANTINED, HELD = "valid", "quarantined", "held"
_SPLIT = [T.StructField("snapshot", T.StringType()), T.StructField("state", T.StringType())]


def _snapshot(root: str, table: str, at: datetime) -> str:
    return f"{root}/{table}/snapshot={at.strftime(STAMP)}"


def write_split(rows: DataFrame, root: str, table: str, at: datetime) -> None:
    """What one run kept and rejected of a table, told apart by its column ``state``: one pass over the rows and one write.

    Every run lands in its own directory, with one part for each state; a run that is tried again replaces its own.
    """
    split = rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("state")
    split.parquet(_snapshot(root, table, at), compression=TIGHT)


def write_snapshot(df: DataFrame, root: str, table: str, taken_at: datetime) -> str:
    """Snapshot of valid rows alone; a run that is tried again replaces its own."""
    target = f"{_snapshot(root, table, taken_at)}/state={VALID}"
    df.write.mode("overwrite").parquet(target)
    return target


def landed(spark: SparkSession, root: str, table: str, at: datetime, state: str = VALID) -> DataFrame | None:
    """The valid (or held) rows of one run with all their columns; None when it has none."""
    path = f"{_snapshot(root, table, at)}/state={state}"
    return spark.read.parquet(path) if exists(spark, path) else None


def release(spark: SparkSession, root: str, table: str, at: datetime) -> None:
    """Held rows of a run become valid ones: their files move, none is written again. What stops halfway can be done again."""
    held, valid = (f"{_snapshot(root, table, at)}/state={state}" for state in (HELD, VALID))
    if exists(spark, held):
        for name in children(spark, held):
            move(spark, f"{held}/{name}", f"{valid}/{name}")
        remove(spark, held)


def read_snapshots(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    """The valid rows of all snapshots of a table, with ``snapshot_ts`` recovered from the directory name."""
    df = spark.read.schema(T.StructType([*schema.fields, *_SPLIT])).parquet(f"{root}/{table}").where(F.col("state") == VALID)
    return df.withColumn("snapshot_ts", F.to_timestamp("snapshot", "yyyyMMdd'T'HHmmss")).drop("snapshot", "state")


def latest_per_key(df: DataFrame, key: str, version: str, *tie_break: str) -> DataFrame:
    """Newest row per key. Map tasks keep one row per key, so a hot key never travels whole."""
    order = [F.desc(version), *(F.desc(c) for c in tie_break)]
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def write_quarantine(df: DataFrame, root: str, table: str, at: datetime) -> None:
    """Rejected rows alone; a run that is tried again replaces its own."""
    df.write.mode("overwrite").parquet(f"{_snapshot(root, table, at)}/state={QUARANTINED}")


def read_quarantine_log(spark: SparkSession, root: str, tables: list[str]) -> DataFrame:
    """(table_name, quarantine_reason, timestamp) of every rejected row of the given tables."""
    wanted = T.StructType([T.StructField("quarantine_reason", T.StringType()), *_SPLIT])
    at = F.to_timestamp("snapshot", "yyyyMMdd'T'HHmmss").alias("timestamp")
    log = None
    for table in tables:
        path = f"{root}/{table}"
        if exists(spark, path):
            rows = spark.read.schema(wanted).parquet(path).where(F.col("state") == QUARANTINED).select(F.lit(table).alias("table_name"), "quarantine_reason", at)
            log = rows if log is None else log.unionByName(rows)
    return log if log is not None else spark.createDataFrame([], "table_name string, quarantine_reason string, timestamp timestamp")


def drop_old_quarantine(spark: SparkSession, root: str, tables: list[str], before: datetime) -> list[str]:
    """Delete the rejected rows of runs before a time: whole folders, nothing is rewritten. The folders that went."""
    gone = []
    for table in tables:
        for name in children(spark, f"{root}/{table}"):
            folder = f"{root}/{table}/{name}/state={QUARANTINED}"
            if name.startswith("snapshot=") and datetime.strptime(name.partition("=")[2], STAMP) < before and exists(spark, folder):
                remove(spark, folder)
                gone.append(folder)
    return gone


def write_partitioned_sales(sales: DataFrame, dates: DataFrame, stores: DataFrame, path: str, grain: str = "month") -> None:
    """Snappy Parquet copy of the sales fact, partitioned by date and region.

    ``grain`` is ``day`` or ``month``. Rows of one directory are brought together to avoid small files,
    as a rebalance and not a repartition: adaptive execution cuts a directory that holds much of the
    data into several tasks and files. Writing again replaces the whole copy, so nothing of an earlier one is left.
    """
    patterns = {"day": "yyyy-MM-dd", "month": "yyyy-MM"}
    joined = (
        sales.join(dates.select("date_key", "date"), "date_key")
        .join(stores.select("store_key", "region"), "store_key")
        .withColumn("date_partition", F.date_format("date", patterns[grain]))
        .drop("date")
    )
    balanced = sales.sparkSession.sql("SELECT /*+ REBALANCE(date_partition, region) */ * FROM {joined}", joined=joined)
    (
        balanced.write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .option("compression", "snappy")
        .partitionBy("date_partition", "region")
        .parquet(path)
    )


def read_partitioned_sales(
    spark: SparkSession, path: str, schema: T.StructType, dates: list[str] | None = None, where: Column | None = None
) -> DataFrame:
    """Partitioned copy.

    ``dates`` names the wanted date partitions: only their directories are listed. A condition on
    ``date_partition`` or ``region`` in ``where`` prunes directories after all have been listed.
    """
    full = T.StructType(
        [*schema.fields, T.StructField("date_partition", T.StringType()), T.StructField("region", T.StringType())]
    )
    if dates is None:
        df = spark.read.schema(full).parquet(path)
    else:
        wanted = [d for d in (f"{path}/date_partition={date}" for date in dates) if exists(spark, d)]
        if not wanted:
            return spark.createDataFrame([], full)
        df = spark.read.schema(full).option("basePath", path).parquet(*wanted)
    return df if where is None else df.where(where)


def write_sample(df: DataFrame, order_by: list[str], path: str, rows: int | None = 200) -> None:
    """Ordered sample as headered CSV: one file of the first rows, or the whole table in sorted files."""
    sample = df.orderBy(*order_by)
    if rows is not None:
        sample = sample.limit(rows).coalesce(1)
    sample.write.mode("overwrite").option("header", True).csv(path)
