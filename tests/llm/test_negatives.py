"""Hard negatives against all pairs, and how much the bounds spare."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, anchor_id long, score double, v string"


def brute_force(rows, is_anchor, positives=5, most=10, low=30, high=90):
    part = [(i, x, [math.floor(256 * c) for c in v]) for i, v, x in rows
            if i is not None and x is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {}
    for i, x, v in part:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (x, v)), (x, v))
    out = []
    for a, (x, v) in anchors.items():
        scored = sorted((-max(min(sum(p * q for p, q in zip(v, w)), 2**63 - 1), -2**63), i, y == x)
                        for i, y, w in part if i != a and len(w) == len(v))
        for s, p, _ in [r for r in scored if r[2]][:positives]:
            good = [(-t, n) for t, n, same in scored if not same and low * -s <= 100 * -t <= high * -s][:most]
            out += [(a, p, k + 1, n, -s, t) for k, (t, n) in enumerate(good)]
    return sorted(out)


def mined(spark, rows, is_anchor, **options):
    df = spark.createDataFrame([(i, v, x, 1, 0.5, "s") for i, v, x in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in negatives.mine(negatives.labelled_vectors(df), is_anchor, **options).collect())


def test_equals_all_pairs_with_odd_rows(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(0, 1, (6, 8))
    rows = [(i, (centres[i % 6] + draw.normal(0, 0.6, 8)).tolist(), i % 4) for i in range(500)]
    rows += [(1000, None, 1), (1001, [1.0] * 8, None), (None, [1.0] * 8, 1), (1002, [1.0, None] + [1.0] * 6, 1), (1003, [math.nan] * 8, 2),
             (1004, [math.inf] * 8, 2), (1005, [0.0] * 8, 1), (1010, [1.0, 2.0], 1), (1011, [1.0, 1.5], 1), (1012, [0.5, 0.5], 2), (1020, [], 1),
             (-7, rows[3][1], 3), (3, rows[3][1], 3), (10, rows[11][1], 2), (11, rows[11][1], 3), (77, rows[5][1], 0), (77, rows[5][1], 1)]
    found = mined(spark, rows, F.col("vec_id") % 5 == 0)
    assert found == brute_force(rows, lambda i: i % 5 == 0) and len(found) > 500
    assert mined(spark, rows, F.col("vec_id") == 1010, positives=1, negatives=2, low=0, high=100) == brute_force(rows, lambda i: i == 1010, 1, 2, 0, 100)


def test_products_beyond_64_bits_and_equal_rows(spark):
    big = [(i, [1e9 * (i % 7), 1e10, -3.0], i % 2) for i in range(40)] + [(100, [1e200, 1.0, 0.0], 0)]
    found = mined(spark, big, F.col("vec_id") % 4 == 0)
    assert found == brute_force([(i, [min(c, 1e150) for c in v], x) for i, v, x in big], lambda i: i % 4 == 0)
    equal = [(i, [0.5, 0.5], i % 2) for i in range(60)]
    assert mined(spark, equal, F.col("vec_id") < 3, low=0, high=100) == brute_force(equal, lambda i: i < 3, low=0, high=100)


def test_an_empty_table_and_no_other_label(spark):
    assert mined(spark, [], F.col("vec_id") == 1) == []
    assert mined(spark, [(i, [1.0, 2.0], 1) for i in range(9)], F.col("vec_id") == 1) == []


def test_the_tree_spans_each_group_and_bounds_hold():
    draw = np.random.default_rng(1)
    centres = draw.normal(0, 200, (5, 16))
    vectors = np.floor(centres[np.arange(200) % 5] + draw.normal(0, 4, (200, 16)))
    parents, edges = negatives.spanning_tree(vectors, np.arange(200) % 2)
    for group in (0, 1):
        own = np.flatnonzero(np.arange(200) % 2 == group)
        assert (parents[own] < 0).sum() == 1 and set(parents[own]) - {-1} <= set(own)
    order = np.concatenate(list(negatives.levels(parents)))
    assert sorted(order) == list(range(200))
    place = {int(k): n for n, k in enumerate(order)}
    assert all(p < 0 or place[int(p)] < place[i] for i, p in enumerate(parents))
    assert np.allclose(edges[parents >= 0], np.linalg.norm(vectors - vectors[parents], axis=1)[parents >= 0])


def test_most_pairs_are_spared_where_anchors_are_close():
    """Of tight groups of anchors the scores of nearly all candidates are known to lie outside the window."""
    draw = np.random.default_rng(2)
    centres = draw.normal(0, 200, (5, 16))
    anchors = np.floor(centres[np.arange(100) % 5] + draw.normal(0, 2, (100, 16)))
    candidates = np.floor(draw.normal(0, 100, (2000, 16)))
    parents, edges = negatives.spanning_tree(anchors, np.zeros(100))
    exact, least = anchors @ candidates.T, 60_000
    scored = 0
    for rows, scores, known in negatives.walk(anchors, parents, edges, candidates, lambda rows, low, high: high >= least):
        assert (scores[known] == exact[rows][known]).all()
        assert not (exact[rows] >= least)[~known].any()
        scored += known.sum()
    assert scored < 0.3 * exact.size
