"""Exact top k against all pairs, with ties, copies and unfit vectors."""

import math
import random

from pyspark.sql import functions as F

from shelfsight.llm import topk


def brute(rows, k):
    fit = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    width = len(min(fit)[1]) if fit else 0
    whole = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in fit if len(v) == width}
    out = []
    for q in sorted({i for i, _ in whole if i % 50 == 0}):
        best = {}
        for own in (v for i, v in whole if i == q):
            for i, v in whole:
                if i != q:
                    score = sum(a * b for a, b in zip(own, v))
                    best[i] = max(best.get(i, score), score)
        out += [(q, n + 1, i, s) for n, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k])]
    return out


def found(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, v string, score int").repartition(3)
    got = topk.search(df, F.col("vec_id") % 50 == 0, k)
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())




def test_ties_copies_and_unfit_vectors(spark):
    dice = random.Random(4)
    values = [0.0, 0.25, 0.5, -0.25, 1.0]
    rows = [(k, [dice.choice(values) for _ in range(4)]) for k in range(180)]
    rows += [(200 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(100)]  # a hot vector, some of them queries
    rows += [(400, None), (450, []), (500, [None, 1.0, 1.0, 1.0]), (501, [math.nan] * 4), (502, [math.inf] * 4), (550, [1.0, 1.0]), (None, [1.0] * 4), (50, rows[50][1]), (100, [1.0, 0.0, 0.0, 0.25])]
    assert found(spark, rows) == brute(rows, 5)
    assert found(spark, rows, 1) == brute(rows, 1)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (50, [0.5, 0.5]), (3, [0.25, 1.0])]
    assert found(spark, rows) == brute(rows, 5)
    assert found(spark, [(0, [1.0])]) == []
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty, F.col("vec_id") % 50 == 0).count() == 0


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(topk, "BLOCK_CANDIDATES", 5)
    dice = random.Random(9)
    rows = [(k * 10, [dice.choice([0.0, 0.25, -0.25, 2.0]) for _ in range(3)]) for k in range(120)]
    assert found(spark, rows) == brute(rows, 5)


def test_zero_vectors(spark):
    rows = [(k * 25, [0.0, 0.0]) for k in range(8)]
    assert found(spark, rows) == brute(rows, 5)


def test_ids_that_repeat_with_other_vectors(spark, monkeypatch):
    dice = random.Random(7)
    values = [0.0, 0.25, 0.5, -0.25, 1.0]
    rows = [(k, [dice.choice(values) for _ in range(4)]) for k in range(120)]
    rows += [(7, [8.0 + j, 8.0, 8.0, 8.0]) for j in range(10)]  # leads every list with ten vectors
    assert found(spark, rows) == brute(rows, 5)
    # Two ids, one of them a query, with a third of the rows each; the block of a part may hold one id only.
    rows += [(k, [dice.choice(values) * 4 for _ in range(4)]) for k in (9, 50) for _ in range(120)]
    assert found(spark, rows) == brute(rows, 5)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(topk, "BLOCK_CANDIDATES", 6)
    assert found(spark, rows) == brute(rows, 5)
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.25, 0.0])] + [(3, [9.0, float(j)]) for j in range(40)]
    assert found(spark, rows) == brute(rows, 5) and len(found(spark, rows)) == 3
