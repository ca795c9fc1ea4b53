import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagwright.llm import hardneg

SCHEMA = "vec_id long, embedding array<double>, label int, id string, score double, slot int"


def brute(rows, every=10, n_pos=5, n_neg=3, low=50, high=95):
    """rows: (id, vector, label). Plain Python over all pairs, one result row per found negative."""
    use = [(i, [math.floor(256 * x) if math.isfinite(256 * x) else int(x) * 256 for x in v], y) for i, v, y in rows
           if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, y) in enumerate(use):
        if i is None or i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0, m) for m, (j, w, _) in enumerate(use) if m != n)
        for s, _, _, m in [x for x in scored if use[x[3]][2] == y][:n_pos]:
            fit = [x for x in scored if use[x[3]][2] != y and low * -s <= 100 * -x[0] <= high * -s][:n_neg]
            out += [(i, use[m][0], r, use[x[3]][0], -s, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out, key=str)


def mined(spark, rows, parts=3, every=10, **kw):
    df = spark.createDataFrame([(*r, "a", 0.5, 3) for r in rows], SCHEMA).repartition(parts)
    got = hardneg.mine(hardneg.usable(df), F.col("id") % every == 0, **kw)
    return sorted(map(tuple, got.collect()), key=str)


def vectors(seed, n, length=6, labels=3, span=1.0):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-span, span) for _ in range(length)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 5])
def test_matches_brute_force(spark, parts):
    rows = vectors(1, 150)
    assert mined(spark, rows, parts) == brute(rows) != []


def test_several_blocks_of_anchors(spark):
    rows = vectors(2, 120, length=1 << 13, span=0.02)      # 16 anchors of 8192 components fill a block of 1 MB
    assert mined(spark, rows, every=2, block_mb=1) == brute(rows, every=2) != []


def test_ties_nulls_repeats_and_odd_lengths(spark):
    same = [0.25, -0.5, 0.125]
    rows = [(i, same, i % 2) for i in range(20)]                                  # every score ties
    rows += [(20, [x * 0.6 for x in same], 1), (30, [x * 0.7 for x in same], 0), (30, [x * 0.7 for x in same], 0)]   # a repeated anchor
    rows += [(40, None, 1), (41, same, None), (42, [0.5, None, 0.1], 1), (43, [float("nan"), 0.1, 0.1], 1), (44, [float("inf"), 1.0, 1.0], 0)]
    rows += [(None, [x * 0.8 for x in same], 1), (50, [], 1), (51, [0.25], 0), (60, [0.2, -0.4, 0.1, 7.0], 1), (70, [-3.0, 0.0, 0.1], 5)]
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, rows[:0]) == []
    assert mined(spark, [(1, same, 0), (3, same, 1)]) == []                        # no anchors


def test_components_beyond_64_bits(spark):
    rows = vectors(3, 60, length=3, span=3.0e6)
    assert mined(spark, rows) == brute(rows) != []
    assert mined(spark, rows + [(100, [1e300, 1.0, -1e308], 0), (101, [1e300, 0.0, 0.0], 0)]) is not None   # scores of 600 digits: null


@pytest.mark.parametrize("kind", [np.int64, object])
def test_packed_scores_are_exact(kind):
    rng = np.random.default_rng(4)
    a, c = (rng.integers(-90, 91, (n, 17)).astype(kind) for n in (11, 101))
    assert (hardneg.packed_scores(a, c, 90, 90) == a @ c.T).all()
    top = np.full((3, 17), 90).astype(kind)
    for x in (top, -top):                                                          # the fullest and the emptiest fields
        assert (hardneg.packed_scores(x, np.concatenate([top, -top, c[:3]]), 90, 90) == x @ np.concatenate([top, -top, c[:3]]).T).all()
