"""Exact top-k search by inner product as a Voronoi kNN join.

Every component x becomes floor(``SCALE`` * x). Distances that respect inner products come from one more coordinate: a
candidate gets sqrt(M - |x|^2), where M is the largest squared length, a query gets 0. Then the squared distance is
|q|^2 + M - 2 q.x, and the highest scores are the nearest neighbours.

Candidates and queries are put in the cell of their nearest pivot. Summaries of the cells (radius, and the distances of the
nearest candidates to their pivot) bound the k-th distance of each query cell from above. Neighbouring query cells form a
group, and a candidate is copied to a group only if the triangle inequality lets it lie within the bound of one of its
cells. Each group is solved locally in blocks of queries and candidates, and the blocks' best are merged.

Equal vectors are one candidate with their k + 1 smallest ids, which is all that a top k can show of them, and equal queries
are one query; so a vector that a third of the rows share is copied and solved once.

Defined results: vectors that are null, hold null or non-finite components, or differ in length from the shared ``dimension``
(that of the smallest id) take no part; ties go to the smaller id; a query never meets its own id, also where an id repeats;
an id that repeats with other vectors takes one place, with its best score over them and over the query's vectors;
repeated rows of one id and vector count once; null ids take no part; fewer than k candidates give all; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SCALE = 256
#: At most so many pivots, taken from distinct vectors by hash; about the root of their number.
MOST_PIVOTS = 256
#: Query groups at least; more if a group would hold more than ``BLOCK_QUERIES`` on average.
GROUPS = 8
BLOCK_QUERIES, BLOCK_CANDIDATES = 4_096, 8_192
#: Bounds are doubles; they are widened by this share and as many units, so that rounding never drops a candidate.
SLACK = 1e-6


def scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("double"))


def vectors(df: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v) with whole components, of rows that take part."""
    rows = df.select(F.col(vec_id).alias("id"), F.col(embedding).alias("v")).where("id is not null and v is not null and size(v) > 0")
    sound = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))))
    return sound.select("id", scaled(F.col("v")).alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _assigned(rows: DataFrame, pivots, largest: float, extra: bool) -> DataFrame:
    """Nearest pivot and the distance to it, in the space with one more coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pivots.value
        lengths = (table * table).sum(axis=1)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _matrix(batch.column("v"))
            squares = (own * own).sum(axis=1)
            more = np.sqrt(np.maximum(largest - squares, 0)) if extra else np.zeros(len(own))
            distance = squares[:, None] + (more * more)[:, None] + lengths[None, :] - 2 * (own @ table[:, :-1].T + more[:, None] * table[:, -1][None, :])
            near = distance.argmin(axis=1)
            found = np.sqrt(np.maximum(distance[np.arange(len(own)), near], 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype("i4")), pa.array(found)], [*batch.schema.names, "cell", "distance"])

    return rows.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema.fields)}, cell int, distance double")


def _bounds(cells: DataFrame, queries: DataFrame, table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query cell: its radius, and an upper bound of the k-th distance of every query in it."""
    between = np.sqrt(np.maximum(((table[:, None, :] - table[None, :, :]) ** 2).sum(axis=2), 0))
    radius = np.full(len(table), -1.0)
    for r in queries.groupBy("cell").agg(F.max("distance").alias("r")).collect():  # a row for each pivot
        radius[r["cell"]] = r["r"]
    # k + 1 near ids of each pivot, each by its nearest vector, as a query may have to leave one out.
    nearest = cells.select("cell", "distance", F.explode("ids").alias("id")).groupBy("cell", "id").agg(F.min("distance").alias("distance"))
    near = Window.partitionBy("cell").orderBy("distance", "id")
    first = nearest.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= k + 1).select("cell", "distance", "id").collect()
    bound = np.full(len(table), np.inf)
    for cell in np.flatnonzero(radius >= 0):
        reach = sorted((radius[cell] + between[cell, r["cell"]] + r["distance"], r["id"]) for r in first)
        met = set()  # an id may be near more than one pivot
        for distance, held in reach:
            met.add(held)
            if len(met) >= k + 1:
                bound[cell] = distance
                break
    return radius, bound


def _smallest_ids(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): distinct vectors with their smallest ids. A row number that is limited to ``most`` is cut below the shuffle."""
    first = Window.partitionBy("v").orderBy("id")
    kept = rows.distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    return kept.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _pivots(candidates: DataFrame, dimension: int) -> tuple[np.ndarray, float]:
    """Pivots with their further coordinate, and the largest squared length."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    told = candidates.agg(F.count("*").alias("n"), F.max(square).alias("m")).first()
    largest = float(told["m"] or 0)
    wanted = min(MOST_PIVOTS, max(1, round(float(told["n"]) ** 0.5)))
    chosen = candidates.orderBy(F.xxhash64("v"), "v").limit(wanted).select("v").collect()
    table = np.array([r["v"] for r in chosen] or [[0.0] * dimension], float).reshape(-1, dimension)
    return np.concatenate([table, np.sqrt(np.maximum(largest - (table * table).sum(axis=1, keepdims=True), 0))], axis=1), largest


def _copies(cells: DataFrame, pivots, bounds, group_of: np.ndarray, largest: float) -> DataFrame:
    """(v, ids, grp): each candidate for each query group that may need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (radius, bound) = pivots.value, bounds.value
        live = np.flatnonzero(radius >= 0)
        belongs = group_of[live][:, None] == np.arange(group_of.max() + 1)[None, :]
        centres, reach = table[live], (radius + bound)[live] * (1 + SLACK) + SLACK * (1 + np.sqrt(largest))
        for batch in batches:
            own = _matrix(batch.column("v"))
            if not len(own) or not len(live):
                continue
            squares = (own * own).sum(axis=1)
            whole = np.concatenate([own, np.sqrt(np.maximum(largest - squares, 0))[:, None]], axis=1)
            apart = (whole * whole).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * whole @ centres.T
            needed = np.sqrt(np.maximum(apart, 0)) <= reach[None, :]
            row, group = np.nonzero(needed.astype("f4") @ belongs.astype("f4") > 0)
            picked = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([picked.column("v"), picked.column("ids"), pa.array(group.astype("i4"))], ["v", "ids", "grp"])

    return cells.select("v", "ids").mapInArrow(run, "v array<double>, ids array<long>, grp int")


def _solver(k: int):
    """The k + 1 best distinct ids of each query among the candidates of one block, each by its best vector."""

    def solve(rows: pa.Table) -> pa.Table:
        asks = np.asarray(rows.column("ids").is_null())
        every = _matrix(rows.column("v").combine_chunks())
        queries, own = every[asks], every[~asks]
        lists = rows.column("ids").combine_chunks().filter(pa.array(~asks))
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        vector = np.repeat(np.arange(len(own)), lists.value_lengths().to_numpy(zero_copy_only=False))[order]
        names, starts = np.unique(ids[order], return_index=True)
        out: list[list] = [[], [], []]
        for query in queries if len(own) else ():
            scores = np.maximum.reduceat((own @ query)[vector], starts)  # of each id
            # All that tie with the last of k + 1 are compared by id.
            edge = np.partition(scores, -(k + 1))[-(k + 1)] if len(scores) > k + 1 else scores.min()
            near = np.flatnonzero(scores >= edge)
            best = near[np.argsort(-scores[near], kind="stable")[: k + 1]]
            out[0] += [query.tolist()] * len(best)
            out[1] += names[best].tolist()
            out[2] += [int(score) for score in scores[best]]
        return pa.table({"v": pa.array(out[0], pa.list_(pa.float64())), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return solve


def search(df: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with the rows of other ids."""
    spark = df.sparkSession
    rows = vectors(df, vec_id, embedding)
    first = rows.orderBy("id").limit(1).select(F.size("v").alias("n")).first()
    dimension = first["n"] if first else 1
    candidates = saved(_smallest_ids(rows.where(F.size("v") == dimension), k + 1), "vectors")
    asked = saved(vectors(df.where(is_query), vec_id, embedding).where(F.size("v") == dimension).distinct(), "queries")

    table, largest = _pivots(candidates, dimension)
    pivots = spark.sparkContext.broadcast(table)  # at most MOST_PIVOTS vectors
    cells = saved(_assigned(candidates, pivots, largest, True), "cells")
    questions = saved(_assigned(asked.select("v").distinct(), pivots, largest, False), "query-cells")
    bounds = spark.sparkContext.broadcast(_bounds(cells, questions, table, k))
    groups = min(len(table), max(GROUPS, questions.count() // BLOCK_QUERIES))
    group_of = ((table[:, None, :] - table[None, :groups, :]) ** 2).sum(axis=2).argmin(axis=1)

    data = saved(_copies(cells, pivots, bounds, group_of, largest), "copies")
    asking = questions.withColumn("grp", F.element_at(F.array(*(F.lit(int(g)) for g in group_of)), F.col("cell") + 1))
    sizes = data.groupBy("grp").agg(F.expr(f"cast(1 + count(*) div {BLOCK_CANDIDATES} as int)").alias("parts"))
    sizes = sizes.join(asking.groupBy("grp").agg(F.expr(f"cast(1 + count(*) div {BLOCK_QUERIES} as int)").alias("blocks")), "grp")

    def dealt(rows: DataFrame, own: str, other: str, by: str, ids: Column) -> DataFrame:
        """Each row in its own block, with every block of the other side."""
        spot = F.pmod(F.xxhash64("v"), F.col(by)).cast("int").alias(own)
        every = F.explode(F.expr(f"sequence(0, {'blocks' if by == 'parts' else 'parts'} - 1)")).alias(other)
        return rows.join(sizes, "grp").select("grp", spot, every, "v", ids.alias("ids")).select("grp", "part", "block", "v", "ids")

    blocks = dealt(data, "part", "block", "parts", F.col("ids")).union(dealt(asking, "block", "part", "blocks", F.lit(None).cast("array<long>")))
    solved = blocks.groupBy("grp", "part", "block").applyInArrow(_solver(k), "v array<double>, vec_id long, score long")
    # An id that repeats with other vectors gives its best score.
    scored = solved.groupBy("v", "vec_id").agg(F.max("score").alias("score"))
    best = scored.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("_n") <= k + 1)
    named = best.join(asked.withColumnRenamed("id", "query_id"), "v").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
