import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dragline.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, at string, d string, anchor string, q string"
TOP = 1 << 20


def brute(rows, positives=5, negatives=10):
    """(anchor, positive, rank, negative, scores) by sorting everything for each anchor."""
    use = [(i, [max(-TOP, min(TOP, math.floor(256 * float(np.float32(x))))) for x in v], label) for i, v, label in rows
           if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (anchor, q, label) in enumerate(use):
        if anchor is None or anchor % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q, w, strict=True)), last(i), b, i, other) for b, (i, w, other) in enumerate(use)
                         if b != a and len(w) == len(q)))
        for down, _, _, i, _ in [s for s in scored if s[4] == label][:positives]:
            inside = [s for s in scored if s[4] != label and -30 * down <= -100 * s[0] <= -90 * down][:negatives]
            out += [(anchor, i, k + 1, s[3], -down, -s[0]) for k, s in enumerate(inside)]
    return sorted(out, key=str)


def got(spark, rows, **options):
    table = spark.createDataFrame([(*r, "?", "?", "?", "?") for r in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives.mine(table, F.col("vec_id") % 100 == 0, **options).collect()), key=str)


def vectors(n, dims, labels, seed, scale=1.0):
    rnd = random.Random(seed)
    return [(i, [rnd.gauss(0.3, 1) * scale for _ in range(dims)], rnd.choice(labels)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_brute_force(spark, seed):
    rows = vectors(700, 6, [0, 0, 0, 1, 2], seed)
    want = brute(rows)
    assert len(want) > 50
    assert got(spark, rows) == want
    assert got(spark, rows, block=2) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(300, 3, [0, 1], 3)
    rows += rows[:150]  # repeated rows, anchors included
    rows += [(100, None, 1), (200, [1.0, nan, 0.0], 1), (300, [1.0, None, 0.0], 0), (400, [inf, 0.0, 0.0], 0), (500, [1.0, 1.0, 1.0], None)]
    rows += [(None, [1.0, 1.0, 1.0], 0), (None, [0.5, 0.5, 0.5], 1), (None, [0.5, 0.5, 0.5], 1)]
    rows += [(600, [], 0), (601, [], 0), (602, [], 1), (700, [2.0, 1.0], 3), (701, [2.0, 1.0], 3), (702, [1.0, 1.0], 4), (800, [1.0] * 5, 9)]
    rows += [(900, [1e30, -1e30, 1e4], 7), (901, [1e30, -1e30, 0.0], 7), (902, [4000.0, 0.0, 0.0], 8), (903, [1e3, 0.1, 1e30], 8)]
    rows += [(1000 + i, [0.25, 0.25, 0.25, 0.25], i % 2) for i in range(60)]  # ties everywhere, no window
    rows += [(2000 + i, [1.0, 1.0, 1.0, 0.0] if i % 2 else [1.0, 0.5, 0.0, 0.0], 20 + i % 2) for i in range(80)]  # ties inside windows
    random.Random(5).shuffle(rows)
    want = brute(rows)
    assert {600, 700, 900, 2000} <= {r[0] for r in want}
    assert got(spark, rows) == want
    assert got(spark, rows, block=3) == want


def test_empty_tables(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0], 0), (2, None, None)]) == []


def test_windows_open_and_close_in_key_order():
    """The iterator alone: a zero-score positive takes zero-score negatives, a negative one nothing."""
    def keys(rows):
        cols = list(zip(*rows, strict=True))
        parts = [hard_negatives.packed(*(np.array([x], np.int64) for x in (a, a, s)), k, np.array([i]), np.array([0])).to_pylist()[0]
                 for a, s, k, i in zip(*cols, strict=True)]
        return [pa.record_batch([pa.array([p], pa.binary())], names=["key"]) for p in sorted(parts)]

    rows = [(7, 100, 0, 1), (7, 90, 1, 2), (7, 91, 1, 3), (7, 30, 1, 4), (7, 29, 1, 5), (7, 0, 0, 6), (7, 0, 1, 8), (7, -5, 0, 9), (7, -3, 1, 10),
            (8, 90, 1, 2)]
    out = [tuple(r.values()) for b in hard_negatives.mined_windows(iter(keys(rows)), 5, 10, 30, 90) for r in b.to_pylist()]
    assert out == [(7, 1, 1, 2, 100, 90), (7, 1, 2, 4, 100, 30), (7, 6, 1, 8, 0, 0)]
