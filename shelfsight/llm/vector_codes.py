"""Vector codes: product quantisation with codebooks from member-resident Lloyd rounds.

Every component x becomes floor(``SCALE`` * x), so all sums and distances are whole numbers and exact. A vector is cut into
``POSITIONS`` equal consecutive parts; each position has a codebook of up to ``ENTRIES`` entries.

A part is a row that lives with its owner: the partition of its (position, entry, salt), where an entry with more members than an even share
of the rows has several salts, so one with a third of all rows has many owners. In each round

* an owner sums the parts that live in it, without a shuffle, and the owners' sums (at most one row per entry and partition) give the new
  codebook, which is the only thing that passes the driver: ``ENTRIES`` entries per position, whatever the number of rows;
* an owner finds the nearest entry of each of its parts under the new codebook. Parts that keep theirs stay where they are, the others,
  and only these, are shuffled to their new owner.

Every state is a table in the shared folder, so a lost executor costs a re-read. In the end the codes are read off the vectors
themselves with the last codebooks, row by row.

Defined results: rows whose vector is null, empty or holds null or non-finite components, or whose length differs from that of the kept row with
the smallest id, are dropped; a length that ``POSITIONS`` doesn't divide is an error; null ids come after all others where the first
codebook is drawn, equal ids go by vector; repeated rows count each for itself; fewer than ``ENTRIES`` rows give shorter codebooks; ties go to the
lower entry; an entry without members stays; null labels are one label; an empty table gives no rows; other columns are not
read. Components beyond what 64 bits hold exactly stop the job instead of giving a wrong number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SCALE = 1024
POSITIONS, ENTRIES, ROUNDS = 4, 256, 4
#: Largest component that a double holds with all its neighbours.
LARGEST = 1 << 52
MEMBER = "position int, entry int, spread long, part array<long>"


def whole_vectors(df: DataFrame, embedding: str, *keep: Column) -> DataFrame:
    """``keep`` columns and the whole components ``v`` of the rows that take part."""
    rows = df.select(*keep, F.col(embedding).alias("v")).where("v is not null and size(v) > 0")
    sound = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    scaled = F.transform("v", lambda x: F.floor(x.cast("double") * SCALE))
    fits = ~F.exists("v", lambda x: F.abs(x.cast("double") * SCALE) >= float(LARGEST))
    return sound.withColumn("v", F.when(fits, scaled).otherwise(F.raise_error(F.lit("a component is too large for exact whole numbers"))))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of equal length as a matrix: of doubles where these are exact, else of Python's integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return flat.astype("f8" if kind == "double" else object)


def _nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower of ties, and the squared distance to it."""
    far = (entries * entries).sum(axis=1)[None, :] - 2 * (parts @ entries.T)
    # Of Python's integers, argmin keeps the first of ties as well.
    near = far.argmin(axis=1)
    return near, far[np.arange(len(parts)), near] + (parts * parts).sum(axis=1)


def _first_entries(books: Broadcast, kind: str):
    """From vectors: each part beside its nearest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("v"), kind)
            for position, book in enumerate(books.value):
                own = np.split(vectors, len(books.value), axis=1)[position]
                near, _ = _nearest(own, book.astype(vectors.dtype))
                yield _members(np.full(len(own), position), near, batch.column("spread"), own)

    return run


def _members(position: np.ndarray, entry: np.ndarray, spread: pa.Array, parts: np.ndarray, *more: pa.Array) -> pa.RecordBatch:
    flat = pa.array(parts.reshape(-1).astype("i8"))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype="i4") * parts.shape[1]), flat)
    names = ["position", "entry", "spread", "part", "moved"]
    return pa.RecordBatch.from_arrays([pa.array(position.astype("i4")), pa.array(entry.astype("i4")), spread, lists, *more], names[: 4 + len(more)])


def _own_sums(positions: int, entries: int, width: int):
    """What one owner gives out: (position, entry, members, sums) of the parts that live in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = np.zeros(positions * entries, "i8")
        sums = np.zeros((positions * entries, width), "i8")
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("position").to_numpy() * entries + batch.column("entry").to_numpy()
            order = np.argsort(own, kind="stable")
            held, starts = np.unique(own[order], return_index=True)
            parts = batch.column("part").flatten().to_numpy().reshape(len(own), width)[order]
            members[held] += np.diff([*starts, len(own)])
            sums[held] += np.add.reduceat(parts, starts, axis=0)
        held = np.flatnonzero(members)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype="i4") * width), pa.array(sums[held].reshape(-1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array((held // entries).astype("i4")), pa.array((held % entries).astype("i4")), pa.array(members[held]), lists], ["position", "entry", "members", "sums"]
        )

    return run


def _reassigned(books: Broadcast, kind: str):
    """From members: the same parts with their nearest entry now, and whether that is another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = _matrix(batch.column("part"), kind)
            position, before = batch.column("position").to_numpy(), batch.column("entry").to_numpy()
            now = np.empty(len(parts), "i4")
            for at in np.unique(position):
                rows = position == at
                now[rows] = _nearest(parts[rows], books.value[at].astype(parts.dtype))[0]
            yield _members(position, now, batch.column("spread"), parts, pa.array(now != before))

    return run


def _coded(books: Broadcast, kind: str):
    """From vectors: codes and errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("v"), kind)
            found = [_nearest(own, book.astype(vectors.dtype)) for own, book in zip(np.split(vectors, len(books.value), axis=1), books.value)]
            code = [bytes(row).hex() for row in np.stack([near for near, _ in found], axis=1).astype("u1")]
            error = [int(x) for x in sum(apart for _, apart in found)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def _dealt(members: DataFrame, counts: list, owners: int) -> DataFrame:
    """The rows dealt to the owners of their (position, entry); an entry has as many salts as it holds even shares of all rows."""
    share = max(1, -(-sum(n for _, _, n in counts) // owners))
    sizes = members.sparkSession.createDataFrame([(p, e, -(-n // share)) for p, e, n in counts], "position int, entry int, salts long")
    salted = members.join(F.broadcast(sizes), ["position", "entry"])  # a row per entry
    return salted.repartition("position", "entry", F.pmod("spread", "salts")).select("position", "entry", "spread", "part")


def train(rows: DataFrame, entries: int = ENTRIES, positions: int = POSITIONS, rounds: int = ROUNDS) -> tuple[list[np.ndarray], str]:
    """Codebooks from (vec_id, v, spread) rows, one matrix per position, and the kind of numbers that is exact for these vectors."""
    spark = rows.sparkSession
    first = np.array([r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()], "i8")
    if first.shape[1] % positions:
        raise ValueError(f"{positions} equal parts can't be cut from {first.shape[1]} components")
    width, entries = first.shape[1] // positions, len(first)
    largest = rows.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    # Every square, product and sum of the distances lies below what a double holds exactly.
    kind = "double" if 8 * width * (int(largest) + 1) ** 2 < 1 << 53 else "whole"
    books = [book.astype(object) for book in np.split(first, positions, axis=1)]
    owners = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def counted(members: DataFrame) -> list:
        return [tuple(r) for r in members.groupBy("position", "entry").agg(F.count("*").alias("n")).collect()]

    drawn = saved(rows.select("v", "spread").mapInArrow(_first_entries(spark.sparkContext.broadcast(books), kind), MEMBER), "first-entries")
    members = saved(_dealt(drawn, counted(drawn), owners), "members")
    for turn in range(rounds):
        sums = members.select("position", "entry", "part").mapInArrow(_own_sums(positions, entries, width), "position int, entry int, members long, sums array<long>")
        flat = sums.select("position", "entry", "members", F.posexplode("sums").alias("place", "x"))
        total = flat.groupBy("position", "entry", "place").agg(F.sum("members").alias("members"), F.sum("x").alias("x")).collect()  # one row per component of an entry
        for r in total:
            books[r["position"]][r["entry"], r["place"]] = r["x"] // r["members"]  # rounds down
        if turn == rounds - 1:
            break
        held = spark.sparkContext.broadcast(books)
        placed = saved(members.mapInArrow(_reassigned(held, kind), f"{MEMBER}, moved boolean"), "placed")
        movers = placed.where("moved").drop("moved")
        arrived = saved(_dealt(movers, counted(movers), owners), "arrived")
        members = placed.where("not moved").drop("moved").union(arrived)
    return books, kind


def code_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", entries: int = ENTRIES, positions: int = POSITIONS, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every row that takes part, and the codebooks."""
    spark = df.sparkSession
    every = whole_vectors(df, embedding, F.col(vec_id).alias("vec_id"), F.col(label).alias("label"))
    every = saved(every.withColumn("spread", F.abs(F.xxhash64(F.monotonically_increasing_id()) % F.lit(1 << 40))), "whole-vectors")
    head = every.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).select(F.size("v").alias("n")).first()
    if head is None:
        return every.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    rows = every.where(F.size("v") == head["n"])
    books, kind = train(rows, entries, positions, rounds)
    types = dict(every.dtypes)
    coded = rows.select("vec_id", "label", "v").mapInArrow(_coded(spark.sparkContext.broadcast(books), kind), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")
    return saved(coded, "vector-codes"), books


def codebook_text(books: list[np.ndarray]) -> str:
    return ",".join(str(int(x)) for book in books for entry in book for x in entry)


def digests(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256)."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    told = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).select("vec_id", "code", "error", "label_error", F.lit(told).alias("codebooks_sha256"))
