"""Vector codes against Lloyd rounds in plain whole numbers."""

import hashlib
import math
import random

import pytest

from shelfsight.llm import vector_codes


def brute(rows, entries=256, positions=4, rounds=4):
    fit = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    fit.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    fit = [r for r in fit if len(r[2]) == len(fit[0][2])]
    if not fit:
        return []
    width = len(fit[0][2]) // positions
    books, codes, errors = [], [""] * len(fit), [0] * len(fit)
    for at in range(positions):
        parts = [v[at * width : (at + 1) * width] for _, _, v in fit]
        book = [list(p) for p in parts[:entries]]

        def near(p):
            return min((sum((x - y) ** 2 for x, y in zip(p, e)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            found = [near(p)[1] for p in parts]
            for k in set(found):
                own = [p for p, f in zip(parts, found) if f == k]
                book[k] = [sum(x) // len(own) for x in zip(*own)]
        for k, p in enumerate(parts):
            error, entry = near(p)
            codes[k] += f"{entry:02x}"
            errors[k] += error
        books += [str(x) for e in book for x in e]
    told = hashlib.sha256(",".join(books).encode()).hexdigest()
    of_label = {}
    for (_, label, _), error in zip(fit, errors):
        of_label[label] = of_label.get(label, 0) + error
    return sorted(((i, c, e, of_label[label], told) for (i, label, _), c, e in zip(fit, codes, errors)), key=str)


def found(spark, rows, kind="float", **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], f"vec_id long, label int, embedding array<{kind}>, v string, error int").repartition(3)
    return sorted((tuple(r) for r in vector_codes.digests(*vector_codes.code_vectors(df, **how)).collect()), key=str)


def vectors(seed, n, width=8, values=None):
    dice = random.Random(seed)
    draw = (lambda: dice.choice(values)) if values else (lambda: round(dice.gauss(0, 0.4), 3))
    return [(k * 3, dice.choice([0, 1, None]), [draw() for _ in range(width)]) for k in range(n)]


@pytest.mark.parametrize("entries", [256, 5])
def test_against_plain_rounds(spark, entries):
    rows = vectors(1, 300)
    assert found(spark, rows, "double", entries=entries) == brute(rows, entries)


def test_ties_copies_and_a_hot_vector(spark):
    rows = vectors(2, 120, values=[0.0, 0.25, -0.25, 0.5])
    rows += [(1000 + k, 7, [0.25, -0.25] * 4) for k in range(150)] + rows[:9]
    assert found(spark, rows, entries=11) == brute(rows, 11)


def test_unfit_vectors_nulls_and_clashing_columns(spark):
    rows = vectors(3, 40) + [(1, 2, None), (2, 2, []), (4, 2, [None] + [1.0] * 7), (5, 2, [math.nan] * 8), (7, None, [math.inf] * 8), (8, 1, [1.0] * 4), (None, None, [0.5] * 8), (None, None, [0.25] * 8)]
    assert found(spark, rows, "double", entries=50) == brute(rows, 50)


def test_few_rows_and_none(spark):
    rows = vectors(4, 3)
    assert found(spark, rows, "double") == brute(rows)
    assert found(spark, []) == [] and found(spark, [(1, 1, None)]) == []
    with pytest.raises(ValueError, match="equal parts"):
        found(spark, [(1, 1, [1.0] * 6)])


def test_large_components_stay_exact(spark):
    dice = random.Random(5)
    rows = [(k, 1, [dice.uniform(-2e5, 2e5) for _ in range(4)]) for k in range(60)]
    assert found(spark, rows, "double", entries=4) == brute(rows, 4)
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, 1, [1e300] * 4)], "double")


def test_only_moved_parts_are_shuffled(spark, monkeypatch):
    dealt = []
    plain = vector_codes._dealt

    def watched(members, counts, owners):
        dealt.append(sum(n for _, _, n in counts))
        return plain(members, counts, owners)

    monkeypatch.setattr(vector_codes, "_dealt", watched)
    rows = [(k, 1, [float(k % 4), 0.01 * (k % 7)] * 4) for k in range(200)]
    assert found(spark, rows, "double", entries=4) == brute(rows, 4)
    assert dealt[0] == 800 and len(dealt) == 4 and all(n < 400 for n in dealt[1:])
