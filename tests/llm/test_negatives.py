import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigsearch.llm import negatives
from sigsearch.llm.negatives import Block, Windows

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, r int"


def dot(a, b):
    return sum(int(x) * int(y) for x, y in zip(a, b))


def brute(rows, every, p=5, k=10, low=30, high=90):
    rows = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, lab in rows]
    out = []
    for i, lab, v in (r for r in rows if r[0] % every == 0):
        scored = sorted((-dot(v, w), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == lab][:p]:
            fit = [(t, n) for t, n, other in scored if other != lab and low * -s <= 100 * -t <= high * -s][:k]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, every):
    frame = spark.createDataFrame([(i, [float(x) for x in v], lab, "x", 1) for i, v, lab in rows], SCHEMA)
    return sorted(map(tuple, negatives.mine(negatives.usable(frame), F.col("vec_id") % every == 0).collect()))


@pytest.mark.parametrize("sample", [10, 60, 4_000])
def test_equal_to_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(negatives, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 9_000)
    monkeypatch.setattr(negatives, "CHUNK_ROWS", 70)
    rng = np.random.default_rng(sample)
    centres = rng.standard_normal((6, 12))
    rows = []
    for i in range(500):
        v = centres[i % 6] * (0.2 if i % 5 else 1) + rng.standard_normal(12) * 0.3
        rows.append((i, np.round(v, 1), int(rng.integers(0, 3)) if i % 3 else 0))
    rows += [(600 + i, np.zeros(12), 1) for i in range(3)] + [(700, rows[0][1], 0), (701, rows[0][1], 1), (800, -centres[0], 7)]
    found = mined(spark, rows, 20)
    assert found == brute(rows, 20) and len(found) > 300


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.4], 1), (2, [0.5, 0.5], 2), (3, [0.4], 2)]
    bad = [(10, None, 1), (11, [1.0, None], 1), (12, [1.0, nan], 2), (13, [1.0, -inf], 2), (14, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (15, [1e30, 1.0], 1)]
    repeated = [(2, [0.5, 0.5], 2), (1, [9.0, 9.0], 5)]
    frame = spark.createDataFrame([(i, v, lab, None, None) for i, v, lab in rows + bad + repeated], SCHEMA)
    points = negatives.usable(frame)
    assert sorted(r.vec_id for r in points.collect()) == [0, 1, 2, 3]
    got = sorted(map(tuple, negatives.mine(points, F.col("vec_id") == 0).collect()))
    padded = [(i, v + [0.0] * (2 - len(v)), lab) for i, v, lab in rows]
    assert got == [r for r in brute(padded, 1) if r[0] == 0]


def test_ties_and_long_scores(spark):
    rows = [(i, [1.0, 0.0, 0.0], 1) for i in range(0, 20)] + [(i, [0.5, float(i % 2), 0.0], 2) for i in range(20, 60)]
    assert mined(spark, rows, 10) == brute(rows, 10)
    far = [(i, [2.0 ** 20 + i % 3, -(2.0 ** 19), 2.0 ** 18], i % 2) for i in range(40)] + [(i, [2.0 ** 19, 2.0 ** 18, i], 0) for i in range(40, 70)]
    assert mined(spark, far, 7) == brute(far, 7)


def test_pairs_above_thresholds_are_all_found():
    rng = np.random.default_rng(1)
    for _ in range(30):
        rows, anchors = rng.integers(-300, 300, (200, 24)), rng.integers(-300, 300, (40, 24))
        rows[:, 8:] //= 20
        order = np.argsort(-(rows.astype(float) ** 2).sum(axis=0))
        scores = anchors @ rows.T
        low = np.array([int(np.quantile(s, rng.random())) for s in scores])
        low[:4] = [negatives.NO_END, -10**12, 10**12, 0]
        r, c, s = negatives.reaching(rows, anchors, low, order)
        assert {(a, b, x) for a, b, x in zip(r.tolist(), c.tolist(), s.tolist())} == {
            (j, i, int(scores[i, j])) for i in range(40) for j in range(200) if scores[i, j] >= low[i]}


def test_thresholds_only_go_down(spark):
    rng = np.random.default_rng(2)
    block = Block(np.arange(9), np.zeros(9, np.int32), rng.integers(-9, 9, (9, 4)))
    sample = Block(np.arange(5, 300), rng.integers(0, 2, 295), rng.integers(-9, 9, (295, 4)))
    asked = Windows(np.arange(9), True, np.full(9, negatives.NO_END), np.full(9, 10**9), 5)
    first, second, last = negatives.thresholds(asked, block, sample, 0.1)
    assert (first >= second).all() and (second >= last).all() and (first > second).any()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine(negatives.usable(empty), F.lit(True)).collect() == []
    hollow = spark.createDataFrame([(0, [], 1, None, None), (1, [], 1, None, None), (2, [], 2, None, None)], SCHEMA)
    assert sorted(map(tuple, negatives.mine(negatives.usable(hollow), F.col("vec_id") == 0).collect())) == [(0, 1, 1, 2, 0, 0)]
    one = spark.createDataFrame([(0, [1.0], 1, None, None)], SCHEMA)
    assert negatives.mine(negatives.usable(one), F.lit(True)).collect() == []
