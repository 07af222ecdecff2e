"""Shared folder for tables that several jobs read.

Intermediate results that more than one query needs are written as Parquet under
``spark.checkpoint.dir`` and read back, so that losing an executor costs a re-read and not a
re-run of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .sources.files import remove

_local_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if shared:
        return shared
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="shelfsight-")
    return _local_roots[app]


class Workspace:
    """One folder per application. ``save`` writes a table and reads it back.

    Every save takes a new directory, so a DataFrame that reads an earlier one stays valid. ``codec`` packs the tables
    otherwise than the session does.
    """

    def __init__(self, spark: SparkSession, name: str = "work", codec: str | None = None) -> None:
        self.spark, self.codec = spark, codec
        self.path = f"{_root(spark)}/shelfsight/{spark.sparkContext.applicationId}/{name}"

    def location(self, name: str) -> str:
        return f"{self.path}/{name}"

    def fresh(self, name: str) -> str:
        """A location nothing has been written to yet."""
        return f"{self.path}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self._written(df, self.fresh(name))

    def _written(self, df: DataFrame, target: str) -> DataFrame:
        df.write.parquet(target, compression=self.codec)
        return self.spark.read.schema(df.schema).parquet(target)

    @contextmanager
    def lent(self, df: DataFrame, name: str) -> Iterator[DataFrame]:
        """A saved table that goes when the block ends: for what nothing reads later."""
        target = self.fresh(name)
        try:
            yield self._written(df, target)
        finally:
            remove(self.spark, target)
