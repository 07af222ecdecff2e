"""Near vectors against all pairs, with bounds, copies, cliques and unfit vectors."""

import math
import random

import numpy as np
import pytest

from shelfsight.llm import near_vectors


def brute(rows, cosine=0.95):
    fit = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    if fit:
        width = len(rows[min(fit, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, rows[k][1]))][1])
        fit = [k for k in fit if len(rows[k][1]) == width]
    linked = {k: set() for k in range(len(rows))}
    for a in fit:
        for b in fit:
            x, y = rows[a][1], rows[b][1]
            if a != b and sum(p * q for p, q in zip(x, y)) / (math.hypot(*x) * math.hypot(*y)) >= cosine:
                linked[a].add(b)
    out, seen = [], {}
    for k in linked:
        if k not in seen:
            group, waiting = set(), [k]
            while waiting:
                at = waiting.pop()
                if at not in group:
                    group.add(at)
                    waiting += linked[at]
            least = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
            seen.update((g, least) for g in group)
        out.append((rows[k][0], len(linked[k]), seen[k], rows[k][0] == seen[k]))
    return sorted(out, key=str)


def found(spark, rows, kind="double", **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, embedding array<{kind}>, node string, u int").repartition(3)
    return sorted((tuple(r) for r in near_vectors.near_duplicates(df, **how).collect()), key=str)


def clustered(seed, centres, each, width=8, noise=0.09):
    dice = random.Random(seed)
    rows = []
    for _ in range(centres):
        middle = [dice.gauss(0, 1) for _ in range(width)]
        rows += [[m + dice.gauss(0, noise * 3) for m in middle] for _ in range(dice.randrange(1, each))]
    dice.shuffle(rows)
    return [(3 * k, v) for k, v in enumerate(rows)]


@pytest.mark.parametrize("how", [{}, {"unit_bytes": 600, "leaf": 3}, {"groups": 2, "leaf": 2, "most_cells": 5}])
def test_against_all_pairs(spark, how):
    rows = clustered(1, 12, 25)
    assert found(spark, rows, **how) == brute(rows)


def test_copies_cliques_and_scaled_vectors(spark):
    rows = clustered(2, 5, 12)
    rows += [(1000 + k, rows[0][1]) for k in range(80)]  # a hot vector
    rows += [(2000 + k, [1.0 + k * 1e-6] + [0.5] * 7) for k in range(60)]  # near copies, all linked
    rows += [(3000, [x * 1e200 for x in rows[3][1]]), (3001, [x * 1e-200 for x in rows[3][1]]), rows[5], rows[5]]
    rows += [(4000 + k, [math.cos(0.3 * k), math.sin(0.3 * k)] + [0.0] * 6) for k in range(15)]  # a chain
    expected = brute([(i, [x / max(map(abs, v)) for x in v]) for i, v in rows])
    assert found(spark, rows, leaf=4) == expected
    assert found(spark, rows, leaf=4, unit_bytes=640) == expected


def test_unfit_vectors_and_null_ids(spark):
    rows = clustered(3, 3, 6) + [(500, None), (501, []), (502, [0.0] * 8), (503, [None] + [1.0] * 7), (504, [math.nan] * 8), (505, [math.inf] * 8), (506, [1.0] * 4), (507, [1.0] * 4)]
    rows += [(None, [9.0] + [0.0] * 7), (None, [9.0] + [0.0] * 7), (None, None), (600, [0.0, 0.0, -5.0] + [0.0] * 5), (None, [0.0, 0.0, -5.0] + [0.0] * 5)]
    assert found(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, None)]) == [(5, 0, 5, True)]
    assert found(spark, [(5, [1.0])], "float") == [(5, 0, 5, True)]
    assert found(spark, [(5, [1.0]), (4, [2.0]), (3, [-2.0])], "float") == brute([(5, [1.0]), (4, [2.0]), (3, [-2.0])])


def test_levels_cover_and_prune():
    dice = np.random.default_rng(4)
    middles = dice.normal(size=(40, 16))
    points = np.repeat(middles, 50, axis=0) + dice.normal(size=(2000, 16)) * 0.02
    points /= np.linalg.norm(points, axis=1, keepdims=True)

    def walk(node):
        assert np.linalg.norm(points[node.members] - node.centre, axis=1).max() <= node.radius + 1e-7
        if node.children:
            assert sorted(m for c in node.children for m in c.members) == sorted(node.members)
            for child in node.children:
                walk(child)

    tree = near_vectors.grow(points, leaf=16)
    walk(tree)
    links = near_vectors.Links(points, np.ones(2000, "i8"), 0.95)
    links.traverse(tree, tree)
    near = points @ points.T >= 0.95
    assert (links.linked == near.sum(axis=1) - 1).all()
    assert links.compared < 2000 * 2000 / 20  # of all pairs
    assert len(set(links.roots())) == 40


def test_vectors_are_sent_only_where_they_may_link(spark):
    rows = [(k, [float(j == k % 8) + 1e-3 * random.Random(k * 8 + j).random() for j in range(8)]) for k in range(160)]
    df = spark.createDataFrame(rows, "node long, v array<double>").selectExpr("node", "v", "1L as weight")
    # Eight directions, eight groups: each vector meets its own only.
    assert near_vectors.dealt(df, 8).count() == 160
    assert near_vectors.node_links(df, 8).agg({"linked": "sum"}).first()[0] == 8 * 20 * 19
