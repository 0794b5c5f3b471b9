"""Hard negatives against plain scores of all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score double, rank int"


def plain(rows, every=50):
    fine = {}
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        fine[vec_id] = ((label + 1) % 10 if vec_id % 7 == 0 else label, np.array([math.floor(256 * x) for x in vector], dtype=np.int64))
    out = []
    for anchor, (label, v) in fine.items():
        if anchor % every:
            continue
        ranked = sorted(((-int(v @ x), other, own == label) for other, (own, x) in fine.items() if other != anchor))
        for p, positive, same in [r for r in ranked if r[2]][:5]:
            some = [r for r in ranked if not r[2] and 50 * -p <= 100 * -r[0] <= 95 * -p][:3]
            out += [(anchor, positive, i, r[1], -p, -r[0]) for i, r in enumerate(some, 1)]
    return sorted(out)


def _rows(n, d, seed, kind):
    rng = np.random.default_rng(seed)
    if kind == "ties":
        x = rng.integers(0, 2, (n, d)) / 4
    elif kind == "clusters":
        x = rng.normal(size=(12, d))[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.05
    else:
        x = rng.normal(size=(n, d))
    labels = rng.integers(0, 10, n) if kind != "hot" else np.where(rng.random(n) < 0.7, 3, rng.integers(0, 10, n))
    return [(i, int(a), [float(np.float32(y)) for y in row]) for i, (a, row) in enumerate(zip(labels, x, strict=True))]


def _got(spark, rows, every=50):
    df = spark.createDataFrame([(*r, 0.5, 1) for r in rows], SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(negatives.prepared(df), F.col("vec_id") % every == 0).collect()))


@pytest.mark.parametrize("kind", ["ties", "clusters", "even", "hot"])
def test_as_plain_scores(spark, monkeypatch, kind):
    # small blocks, leaves and groups, so that a few rows make many
    for name, value in {"BLOCK": 40, "GROUP": 7, "LEAF": 3, "PIVOTS": 6}.items():
        monkeypatch.setattr(negatives, name, value)
    rows = _rows(700, 8, len(kind), kind)
    got = _got(spark, rows, 10)
    assert got == plain(rows, 10) and got


def test_edges(spark):
    rows = _rows(160, 6, 3, "even")
    odd = [(200, None, [1.0] * 6), (201, 1, None), (202, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (203, 2, [float("nan")] * 6), (250, 2, [float("inf")] * 6), (300, 4, [0.0] * 6), (350, 4, [1.0])]
    padded = [(i, a, v if v is None or len(v) == 6 else v + [0.0] * 5) for i, a, v in rows + odd]
    assert _got(spark, rows + odd + rows[:20]) == plain(padded)
    assert _got(spark, rows[:1]) == [] and _got(spark, []) == []
    assert _got(spark, [(i, 1, v) for i, _, v in rows if i % 7]) == []
    # a vector without components has the score 0 with all
    assert _got(spark, [(50, 1, []), (51, 1, []), (52, 2, [])]) == [(50, 51, 1, 52, 0, 0)]
    huge = [(50, 1, [3e38]), (51, 1, [3e38]), (52, 2, [2e38])]
    assert len(_got(spark, huge)) == 1


def test_covering_radii():
    x = np.random.default_rng(1).normal(size=(300, 5))
    rows, levels = negatives.tree(x)
    assert sorted(rows) == list(range(300))
    below = [np.arange(301)]
    for centre, radius, bounds in levels[::-1]:
        ends = below[-1][bounds]
        below.append(ends)
        for c, r, a, b in zip(centre, radius, ends[:-1], ends[1:], strict=True):
            assert c in rows[a:b] and np.linalg.norm(x[rows[a:b]] - x[c], axis=1).max() <= r + 1e-12
    # radii shrink with the levels
    assert all(a[1].max() >= b[1].max() for a, b in zip(levels, levels[1:], strict=False))
