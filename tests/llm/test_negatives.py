"""Hard negatives against a plain search over all pairs."""

import math
import random

import numpy as np
import pytest

from sojourn.llm import negatives


def brute_force(rows):
    good = []
    for at, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((at, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(float(x) * 256) for x in v]))
    out = []
    for at, i, label, q in good:
        if i % 50:
            continue
        scores = [
            (-sum(a * b for a, b in zip(q, r, strict=True)), j, k, other)
            for k, j, other, r in good
            if k != at and len(r) == len(q)
        ]
        scores.sort()
        for ps, j, _, _ in [s for s in scores if s[3] == label][:5]:
            fits = [s for s in scores if s[3] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(i, j, r, n, -ps, -ns) for r, (ns, n, _, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in ("row", "q", "dim", "pair", "anchor", "score", "positives"):
        df = df.selectExpr("*", f"'x' AS {c}")
    out = negatives.hard_negatives(df)
    assert dict(out.dtypes) == {
        "anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint",
        "positive_score": "bigint", "negative_score": "bigint",
    }
    return sorted(map(tuple, out.collect()))


def vectors(n, dim, seed, classes):
    """Vectors around a few centres, one label with a third of all rows, coarse enough for ties."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((classes, dim))
    label = np.where(rng.random(n) < 0.33, 0, rng.integers(0, classes, n))
    x = np.round((centres[label] + rng.standard_normal((n, dim))) * 4) / 16
    return [(i, x[i].astype(np.float32).tolist(), int(label[i])) for i in range(n)]


@pytest.mark.parametrize(("rows", "dim"), [(2300, 3), (2300, 21)])
def test_blocks_tiles_and_ties(spark, monkeypatch, rows, dim):
    monkeypatch.setattr(negatives, "ROW_BLOCK", 1500)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 17)
    some = vectors(rows, dim, dim, 9)
    random.Random(1).shuffle(some)
    assert mined(spark, some) == brute_force(some)


def test_nulls_repeated_ids_and_odd_vectors(spark):
    some = vectors(120, 5, 3, 3)
    some += [(None, [1.0] * 5, 1), (200, None, 1), (250, [1.0, None, 1.0, 1.0, 1.0], 1), (300, [float("nan")] * 5, 1)]
    some += [(350, [float("inf")] * 5, 1), (400, [1.0] * 5, None), (450, [], 1), (451, [], 2), (457, [], 1)]
    some += [(500, [0.0] * 5, 1), (550, [9.0, -3.0], 2), (551, [9.0, -2.0], 2), (552, [7.0, 1.0], 1)]
    some += [some[0], some[50], some[50], some[1]]
    assert mined(spark, some) == brute_force(some)


def test_large_components_are_exact(spark):
    some = [(i, [2.0**18 + 8 * (i % 5), -(2.0**19), float(i)], i % 2) for i in range(60)]
    assert mined(spark, some) == brute_force(some)


def test_bounds_hold():
    x = np.random.default_rng(1).integers(-300, 300, (80, 19))
    side = negatives.Side(x)
    i, j = np.nonzero(np.ones((80, 80), bool))
    for level in range(len(side.levels)):
        lower, upper = negatives._bounded(side, side, i, j, level)
        assert (lower <= (x @ x.T)[i, j]).all() and ((x @ x.T)[i, j] <= upper).all()


def test_empty_table(spark):
    assert mined(spark, []) == []
