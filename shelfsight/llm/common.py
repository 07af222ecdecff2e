"""What the text operators share: batch mapping, bounded caches, shared folders and connected groups."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..workspace import Workspace

#: Rows of a batch that are turned into Python objects at a time.
ROWS_AT_A_TIME = 256
#: Groups whose sizes are broadcast.
MOST_GROUPS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model may learn from; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Cache(dict):
    """Remembers ``make(key)``; emptied when it holds ``most`` entries, so its memory has a bound."""

    def __init__(self, make: Callable, most: int = 400_000) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.make(key)
        return found


def schema_of(text: str) -> StructType:
    return _parse_datatype_string(text)


_held: dict[str, object] = {}


def give_back() -> None:
    """Return freed memory of this worker to the system: a worker lives on for tasks of other stages and keeps what it once took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass  # a C library without that call


def let_go() -> None:
    """Free what an operator left in this worker."""
    if _held:
        _held.clear()
        gc.collect()
    give_back()


def held_by_worker(key: str, make: Callable[[], object]):
    """``make()``, kept by the Python worker for its next tasks. It keeps one such object: what another operator left is let go first."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def map_texts(df: DataFrame, keep: list[str], text: str, start: Callable[[], Callable], out: str, together: bool = False) -> DataFrame:
    """``keep`` columns plus the ``out`` columns that ``start()(text)`` gives for each row.

    ``start`` runs once in a task and returns a function from a text (None for null) to a tuple, or ``together`` from a list of
    texts to a list of tuples. Only ``keep`` and ``text`` are read, so other columns of ``df`` can't clash with ``out``.
    """
    # A text that is kept is sent to Python once; otherwise it stands behind the kept columns and ends here.
    at_text = keep.index(text) if text in keep else len(keep)
    source = df.select(*keep, *([] if text in keep else [F.col(text).cast("string").alias("_text")]))
    added = schema_of(out)
    schema = StructType([*source.schema.fields[: len(keep)], *added.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = start()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
                piece = batch.slice(at, ROWS_AT_A_TIME)
                texts = piece.column(at_text).to_pylist()
                found = handle(texts) if together else [handle(t) for t in texts]
                columns = list(zip(*found))
                arrays = [c.cast(f.type) for c, f in zip(piece.columns[: len(keep)], arrow)]
                arrays += [pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(keep) :])]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        del handle
        give_back()

    return source.mapInArrow(run, schema)


def first_by_hash(ids: DataFrame, group: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``group``: those whose ``_id`` hashes lowest.

    A group is thinned to about twice as many rows by its size before they are ranked, so one with a third of all rows
    ranks no more of them than any other. The sizes of up to ``MOST_GROUPS`` groups are broadcast, so that rows are thinned where they
    lie and only those left are dealt by group; of more groups, the rows are dealt first.
    """
    sizes = saved(ids.groupBy(group).agg(F.count(F.lit(1)).alias("_size")), "group-sizes")
    few = sizes.count() <= MOST_GROUPS
    spot = F.pmod(F.xxhash64("_id"), F.lit(1 << 40))
    thin = ids.join(F.broadcast(sizes) if few else sizes, group).where(spot * F.col("_size") < F.lit(2.0 * most * (1 << 40)))
    return thin.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(spot, "_id"))).where(F.col("_n") <= most).drop("_n", "_size")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that nothing above it is run twice."""
    return Workspace(df.sparkSession, "llm").save(df, name)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own that every executor reaches."""
    return f"{Workspace(spark, 'llm').path}/{name}-{uuid.uuid4().hex[:12]}"
