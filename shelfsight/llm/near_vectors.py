"""Near-duplicate embeddings: all pairs over a cosine, found by traversing cover trees in pairs.

On unit vectors cosine >= c means a distance of at most t = sqrt(2 - 2c), which obeys the triangle inequality. A cover tree has nested
levels of centres with halving radii: the centres of a level are taken farthest first until they cover what their parent covers
within half its radius. A pair of nodes whose centres lie farther apart than t and both covering radii holds no link and is
pruned; one whose centres and radii lie within t is linked throughout and not opened; the others are opened, down to leaves, whose
members are compared. Radii are measured over all members, never assumed, so the pairs are exact.

* The top level is common: ``CELLS`` centres at most, farthest first from a sample of ``SAMPLE`` distinct vectors. Every vector goes to its
  nearest centre, and the covering radii come from all of them.
* Neighbouring cells form groups, a group with more than ``UNIT_BYTES`` of vectors several units. A vector is sent to each pair of its own unit
  with another whose group has a cell that it may reach. Each pair of units is one task: it grows a tree for each side and
  traverses them together. Where vectors have no neighbourhoods, as random ones of many dimensions, nothing can be pruned: then the
  work is that of all blocks of vectors beside all others, but what is sent stays a fixed number of copies up to ``GROUPS`` units.
* A task gives out one row per linked vector: how many it is linked with, and a vector that stands for its local component. So a group of near
  copies costs rows in proportion to its members, not to its pairs. Components are then joined on the cluster.

Equal vectors are one node with a weight. Defined results: every row is returned; vectors that are null, empty, zero, hold null or non-finite
components, or differ in length from the sound one of the smallest id, link with nothing and are components of their own; repeated
rows, also of one id, are vectors of their own, linked with their copies; a component's id is its smallest one, null only if it has none;
``kept`` holds where the row's id is the component's, null or not; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import components

COSINE = 0.95
#: Distinct vectors, by hash, from which the top level's centres are taken, and these centres.
SAMPLE, CELLS = 4_096, 1_024
#: Groups of cells at least; more where a group would hold more than ``UNIT_BYTES`` of vectors.
GROUPS = 8
UNIT_BYTES = 32 << 20
#: Members of a leaf at most, and children of a node.
LEAF, FAN = 512, 64
#: Distances are rounded; bounds leave so much room.
SLACK = 1e-9


def _units(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, scaled to length 1. The largest component is divided out first, so that no square overflows."""
    own = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    own = own / np.abs(own).max(axis=1, keepdims=True)
    return own / np.sqrt((own * own).sum(axis=1, keepdims=True))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def farthest_first(points: np.ndarray, most: int, within: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres (indices) taken farthest first until all points lie ``within`` or there are ``most``; each point's nearest one and distance."""
    centres, near = [0], np.zeros(len(points), "i8")
    far = _apart(points, points[:1])[:, 0]
    while len(centres) < most:
        next_one = int(far.argmax())
        if far[next_one] <= within:
            break
        apart = _apart(points, points[next_one : next_one + 1])[:, 0]
        closer = apart < far
        near[closer], far[closer] = len(centres), apart[closer]
        near[next_one], far[next_one] = len(centres), 0.0
        centres.append(next_one)
    return np.array(centres), near, far


@dataclass
class Node:
    """A node of the tree: its centre, the distance that covers its members, and these."""

    centre: np.ndarray
    radius: float
    members: np.ndarray
    children: list[Node] = field(default_factory=list)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([c.centre for c in self.children]), np.array([c.radius for c in self.children])


def grow(points: np.ndarray, members: np.ndarray | None = None, centre: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Cover tree over the members; every level halves the radius as far as ``FAN`` children can."""
    members = np.arange(len(points)) if members is None else members
    centre = points[members[0]] if centre is None else centre
    far = _apart(points[members], centre[None, :])[:, 0]
    node = Node(centre, float(far.max()), members)
    if len(members) <= leaf:
        return node
    centres, near, _ = farthest_first(points[members], min(FAN, -(-2 * len(members) // leaf)), node.radius / 2)
    order = np.argsort(near, kind="stable")
    parts = np.split(members[order], np.searchsorted(near[order], np.arange(1, len(centres))))
    if max(map(len, parts)) == len(members):  # nothing comes apart: blocks with the same bound
        node.children = [Node(centre, node.radius, members[at : at + leaf]) for at in range(0, len(members), leaf)]
    else:
        node.children = [grow(points, part, points[members[c]], leaf) for part, c in zip(parts, centres) if len(part)]
    return node


class Links:
    """What a traversal finds: weights of the linked others, and edges that connect what is linked."""

    def __init__(self, points: np.ndarray, weights: np.ndarray, cosine: float) -> None:
        self.points, self.weights, self.cosine, self.reach = points, weights, cosine, float(np.sqrt(2 - 2 * cosine))
        self.rough = points.astype("f4")
        # What single precision may be off by; a block with anything above it is computed in double precision.
        self.least = np.float32(cosine - 4e-7 * max(64, points.shape[1]))
        self.linked = np.zeros(len(points), "i8")
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.compared = 0

    def traverse(self, first: Node, second: Node) -> None:
        waiting = [(first, second)]
        while waiting:
            a, b = waiting.pop()
            if a is b:
                if a.children:
                    centres, radii = a.bounds()
                    self._open(a.children, a.children, centres, radii, centres, radii, waiting, True)
                else:
                    self._compare(a.members, a.members, True)
            elif not a.children and not b.children:
                self._compare(a.members, b.members, False)
            else:
                # The larger one is opened; a leaf stays whole.
                left = a.children if a.children and (not b.children or a.radius >= b.radius / 2) else [a]
                right = b.children if b.children and (not a.children or b.radius >= a.radius / 2) else [b]
                self._open(left, right, *Node(a.centre, 0, a.members, left).bounds(), *Node(b.centre, 0, b.members, right).bounds(), waiting, False)

    def _open(self, left, right, left_centres, left_radii, right_centres, right_radii, waiting, same: bool) -> None:
        apart, cover = _apart(left_centres, right_centres), left_radii[:, None] + right_radii[None, :]
        may = apart <= cover + self.reach + SLACK
        sure = apart + cover <= self.reach - SLACK
        for i, j in zip(*np.nonzero(may)):
            if same and j < i:
                continue
            if sure[i, j]:
                self._all(left[i].members, right[j].members, same and i == j)
            else:
                waiting.append((left[i], right[j]))

    def _all(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        weights = self.weights
        self.linked[a] += weights[b].sum() - (weights[a] if same else 0)
        self.edges.append((a, np.full(len(a), b[0])))
        if not same:
            self.linked[b] += weights[a].sum()
            self.edges.append((b, np.full(len(b), a[0])))

    def _compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        self.compared += len(a) * len(b)
        rough = self.rough[a] @ self.rough[b].T
        if same:
            np.fill_diagonal(rough, -2)
        if rough.max(initial=-2) < self.least:
            return
        near = self.points[a] @ self.points[b].T >= self.cosine
        if same:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.linked[a] += near @ self.weights[b]
        if not same:
            self.linked[b] += self.weights[a] @ near
        # Each row's least label, then each column's, until they agree: the components of this block.
        label, none = np.arange(len(a)), len(a)
        while True:
            of_column = np.where(near, label[:, None], none).min(axis=0)
            now = np.minimum(label, np.where(near, of_column[None, :], none).min(axis=1))
            if (now == label).all():
                break
            label = now
        rows, columns = near.any(axis=1), of_column < none
        self.edges += [(a[rows], a[label[rows]]), (b[columns], a[of_column[columns]])]

    def roots(self) -> np.ndarray:
        """For each point the smallest one that its edges lead to."""
        root = np.arange(len(self.points))
        if not self.edges:
            return root
        a, b = (np.concatenate(x) for x in zip(*self.edges))
        while True:
            low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
            open_ones = low < high
            if not open_ones.any():
                return root
            np.minimum.at(root, high[open_ones], low[open_ones])
            while (root[root] != root).any():
                root = root[root]


def _solver(cosine: float, leaf: int):
    """The links between the members of two units, or among those of one."""

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        first, second = (k.as_py() for k in key)
        unit, node = rows.column("unit").to_numpy(), rows.column("node").to_numpy()
        points = rows.column("u").combine_chunks().flatten().to_numpy().reshape(len(unit), -1)
        links = Links(points, rows.column("weight").to_numpy(), cosine)
        sides = [np.flatnonzero(unit == u) for u in dict.fromkeys((first, second))]
        if all(map(len, sides)):
            trees = [grow(points, side, leaf=leaf) for side in sides]
            links.traverse(trees[0], trees[-1])
        found = np.flatnonzero(links.linked)
        return pa.table({"node": node[found], "linked": links.linked[found], "root": node[links.roots()[found]]})

    return solve


def _placed(top: Broadcast):
    """Each node with its unit vector, nearest centre and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _units(batch.column("v"))
            apart = _apart(own, top.value)
            near = apart.argmin(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype="i4") * own.shape[1]), pa.array(own.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("weight"), lists, pa.array(near.astype("i4")), pa.array(apart[np.arange(len(own)), near])], ["node", "weight", "u", "cell", "distance"]
            )

    return run


@dataclass
class Layout:
    """Where vectors are sent: the cells' centres, radii (negative without members) and groups, the salts of a group and its first unit."""

    centres: np.ndarray
    radii: np.ndarray
    group_of: np.ndarray
    salts: np.ndarray

    def units(self) -> np.ndarray:
        """The group of each unit."""
        return np.repeat(np.arange(len(self.salts)), self.salts)


def _layout(cells: DataFrame, top: np.ndarray, groups: int, unit_rows: int) -> Layout:
    radii, sizes = np.full(len(top), -1.0), np.zeros(len(top), "i8")
    for r in cells.groupBy("cell").agg(F.max("distance").alias("r"), F.count("*").alias("n")).collect():  # a row per cell
        radii[r["cell"]], sizes[r["cell"]] = r["r"], r["n"]
    # The first centres, which lie farthest apart, name the groups.
    group_of = _apart(top, top[:groups]).argmin(axis=1)
    held = np.bincount(group_of, sizes, groups).astype("i8")
    return Layout(top, radii, group_of, np.maximum(1, -(-held // unit_rows)))


def _sent(layout: Broadcast, reach: float):
    """One row per pair of units in which a node may have a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = layout.value
        live = np.flatnonzero(plan.radii >= 0)
        belongs = (plan.group_of[live][:, None] == np.arange(len(plan.salts))[None, :]).astype("f4")
        starts, group_of_unit = np.cumsum(plan.salts) - plan.salts, plan.units()
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                own = batch.column("u").flatten().to_numpy().reshape(batch.num_rows, -1)
                may = _apart(own, plan.centres[live]) <= plan.radii[live][None, :] + reach + SLACK
                group = plan.group_of[batch.column("cell").to_numpy()]
                unit = starts[group] + batch.column("spread").to_numpy() % plan.salts[group]
                row, other = np.nonzero((may.astype("f4") @ belongs > 0)[:, group_of_unit])
                picked = batch.take(pa.array(row))
                mine = unit[row]
                columns = [np.minimum(mine, other), np.maximum(mine, other), mine]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype("i8")) for c in columns), *(picked.column(c) for c in ("node", "weight", "u"))], ["a", "b", "unit", "node", "weight", "u"])

    return run


def _sound(v: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)


def dealt(nodes: DataFrame, dimension: int, cosine: float = COSINE, groups: int = GROUPS, unit_bytes: int = UNIT_BYTES, most_cells: int = CELLS) -> DataFrame:
    """(a, b, unit, node, weight, u): distinct vectors (node, v, weight) for each pair of units in which they may have a link."""
    spark = nodes.sparkSession
    count = nodes.count()
    sample = min(SAMPLE, max(1, UNIT_BYTES // (8 * dimension)))
    drawn = nodes.orderBy(F.xxhash64("v"), "node").limit(sample).select("v").collect()
    points = _units(pa.array([r["v"] for r in drawn], pa.list_(pa.float64())))
    top = points[farthest_first(points, min(most_cells, max(1, round(count**0.5))))[0]]
    unit_rows = max(1, unit_bytes // (8 * dimension))
    cells = saved(nodes.mapInArrow(_placed(spark.sparkContext.broadcast(top)), "node long, weight long, u array<double>, cell int, distance double"), "cells")
    plan = spark.sparkContext.broadcast(_layout(cells, top, min(len(top), max(groups, count // unit_rows)), unit_rows))
    spread = cells.withColumn("spread", F.pmod(F.xxhash64("node"), F.lit(1 << 40)))
    return spread.mapInArrow(_sent(plan, float(np.sqrt(2 - 2 * cosine))), "a long, b long, unit long, node long, weight long, u array<double>")


def node_links(nodes: DataFrame, dimension: int, cosine: float = COSINE, leaf: int = LEAF, **how: int) -> DataFrame:
    """(node, linked, root) rows: weights of linked others found in one task, and a node that is reached."""
    sent = dealt(nodes, dimension, cosine, **how)
    return saved(sent.groupBy("a", "b").applyInArrow(_solver(cosine, leaf), "node long, linked long, root long"), "vector-links")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, **how: int) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    sound = F.coalesce(_sound(F.col("v")), F.lit(False))
    first = rows.where(sound).orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).select(F.size("v").alias("n")).first()
    dimension = first["n"] if first else 0
    fit = sound & (F.size("v") == dimension)
    alone = rows.where(~F.coalesce(fit, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not first:
        return alone
    grouped = rows.where(fit).groupBy("v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("rep"))
    nodes = saved(grouped.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    found = node_links(nodes.select("node", "v", "weight"), dimension, cosine, **how)
    linked = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), "vector-components")
    rooted = nodes.join(roots, "node", "left").join(linked, "node", "left").select("v", "weight", "rep", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = saved(rooted.join(least, "root").select("v", (F.col("linked") + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-classes")
    told = rows.where(fit).join(classes, "v").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return told.union(alone)
