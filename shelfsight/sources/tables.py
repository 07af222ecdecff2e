"""Tables on plain Parquet that change: append-only logs, versioned snapshots and tables in parts.

Plain Parquet has no UPDATE or MERGE. A log grows by appending rows and is folded when read; a table
that must be replaced is written beside the old version and then announced in a small commit list, so
readers see either the old or the new version and a failed write changes nothing. A table in parts has a
versioned list of its parts' folders instead: a change writes the parts it touches and names the others again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import TIGHT, children, exists, remove

_COMMIT = T.StructType([T.StructField("version", T.LongType())])


class Log:
    """Append-only table."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: DataFrame) -> None:
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields)).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        """All rows; an empty table where nothing was logged yet."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)


class VersionedTable:
    """Table replaced as a whole, with the current version named in a commit list."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def version(self) -> int | None:
        commits = f"{self.path}/commits"
        if not exists(self.spark, commits):
            return None
        return self.spark.read.schema(_COMMIT).parquet(commits).agg(F.max("version")).first()[0]

    def current_path(self) -> str | None:
        current = self.version()
        return None if current is None else f"{self.path}/version={current}"

    def next_version(self) -> tuple[int, str]:
        """Number and folder of a version that is written elsewhere and then announced with ``commit``."""
        following = (self.version() or 0) + 1
        return following, f"{self.path}/version={following}"

    def commit(self, version: int) -> None:
        self.spark.createDataFrame([(version,)], _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def read(self) -> DataFrame:
        current = self.version()
        if current is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/version={current}")

    def replace(self, rows: DataFrame) -> int:
        following, path = self.next_version()
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields)).write.mode("overwrite").parquet(path, compression=TIGHT)
        self.commit(following)
        return following

    def delete_where(self, condition: Column) -> int:
        """Keep the rows for which the condition is not true."""
        return self.replace(self.read().where(~F.coalesce(condition, F.lit(False))))


    def remove_old(self, keep: int = 2) -> list[int]:
        """Delete all but the newest ``keep`` versions, which no reader that began lately still needs; those that went."""
        current = self.version()
        held = [int(name.partition("=")[2]) for name in children(self.spark, self.path) if name.startswith("version=")]
        gone = [v for v in held if current is not None and v <= current - keep]
        for version in gone:
            remove(self.spark, f"{self.path}/version={version}")
        return gone


_FOLDERS = T.StructType([T.StructField("part", T.StringType()), T.StructField("folder", T.StringType()), T.StructField("mark", T.LongType())])


class PartedTable:
    """Table in parts, each one or more folders; a versioned list names the folders that hold now.

    ``part`` tells the part of a row as text; null is a part of its own. The list has one row per folder, so what passes the driver grows with the number of
    parts and not with their rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, part: Column) -> None:
        self.spark, self.path, self.schema, self.part = spark, path, schema, part
        self.list = VersionedTable(spark, f"{path}/parts", _FOLDERS)

    def folders(self, version: int | None = None) -> list[tuple[str | None, str]]:
        """(part, folder) of all that holds now, or did in an earlier version."""
        rows = self.list.read() if version is None else self.spark.read.schema(_FOLDERS).parquet(f"{self.list.path}/version={version}")
        return sorted(((r["part"], r["folder"]) for r in rows.where("folder is not null").collect()), key=lambda f: (f[0] or "", f[1]))

    def mark(self) -> int | None:
        """A number stored with the last change: how far a source had been taken in then."""
        return self.list.read().agg(F.max("mark")).first()[0]

    def _rows(self, folders: list[tuple[str, str]]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{folder}" for _, folder in folders))

    def read(self, *parts: str) -> DataFrame:
        """All rows, or those of the parts named: the folders of others are not listed."""
        return self._rows([(part, folder) for part, folder in self.folders() if not parts or part in parts])

    def _written(self, rows: DataFrame) -> list[tuple[str, str]]:
        """The folders that the rows now lie in. Rows of one part are brought together, a large one as several files."""
        name = uuid.uuid4().hex[:12]
        told = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields)).withColumn("_part", self.part)
        balanced = self.spark.sql("SELECT /*+ REBALANCE(_part) */ * FROM {told}", told=told)
        balanced.write.partitionBy("_part").parquet(f"{self.path}/data/{name}")
        unescaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        found = [child for child in children(self.spark, f"{self.path}/data/{name}") if child.startswith("_part=")]
        told = {child: unescaped(child.partition("=")[2]) for child in found}
        return [(None if part == "__HIVE_DEFAULT_PARTITION__" else part, f"{name}/{child}") for child, part in told.items()]

    def _commit(self, folders: list[tuple[str, str]], mark: int | None = None) -> None:
        rows = [(part, folder, None) for part, folder in folders] + ([(None, None, mark)] if mark is not None else [])
        self.list.replace(self.spark.createDataFrame(rows, _FOLDERS).coalesce(1))

    def replace(self, rows: DataFrame) -> None:
        self._commit(self._written(rows))

    def change(self, drop: list[str], add: DataFrame | None = None, mark: int | None = None) -> None:
        """Take parts away and add rows, in one step. Rows of parts that stay get a folder beside those they have."""
        kept = [(part, folder) for part, folder in self.folders() if part not in drop]
        self._commit(kept + (self._written(add) if add is not None else []), self.mark() if mark is None else mark)

    def delete_where(self, condition: Column) -> dict[str, str]:
        """Keep the rows for which the condition is not true; what became of each part.

        A part that goes whole is dropped from the list, one that goes in part is written again, others are left alone.
        """
        hit = F.coalesce(condition, F.lit(False))
        counts = self.read().groupBy(self.part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("gone")).collect()  # a row per part
        state = {r["part"]: "kept" if not r["gone"] else "dropped" if r["gone"] == r["n"] else "rewritten" for r in counts}
        rewritten = [part for part, what in state.items() if what == "rewritten"]
        touched = [part for part, what in state.items() if what != "kept"]
        if touched:
            self.change(touched, self.read(*rewritten).where(~hit) if rewritten else None)
        return state

    def remove_old(self, keep: int = 2) -> int:
        """Delete the lists before the newest ``keep`` and the folders that none of these names; the number of folders that went."""
        self.list.remove_old(keep)
        versions = [int(name.partition("=")[2]) for name in children(self.spark, self.list.path) if name.startswith("version=")]
        named = {folder for version in versions for _, folder in self.folders(version)}
        gone = 0
        for name in children(self.spark, f"{self.path}/data"):
            held = [child for child in children(self.spark, f"{self.path}/data/{name}") if child.startswith("_part=")]
            unnamed = [child for child in held if f"{name}/{child}" not in named]
            for child in unnamed:
                remove(self.spark, f"{self.path}/data/{name}/{child}")
            if len(unnamed) == len(held):
                remove(self.spark, f"{self.path}/data/{name}")
            gone += len(unnamed)
        return gone


def latest_event(events: DataFrame, key: str, at: str, rank: Column | None = None) -> DataFrame:
    """Fold an event log: per key the last known value of every column, by event time.

    Each column keeps its newest non-NULL value, so a later event need only carry what changed. Of events at the same
    instant the one with the higher ``rank`` is the later, then the one with the greater value.
    """
    rank = F.lit(0) if rank is None else rank
    newest = [
        F.max(F.when(F.col(c).isNotNull(), F.struct(F.col(at), rank.alias("_rank"), F.col(c).alias("_value"))))["_value"].alias(c)
        for c in events.columns
        if c not in (key, at)
    ]
    return events.groupBy(key).agg(F.min(at).alias(f"first_{at}"), F.max(at).alias(f"last_{at}"), *newest)
