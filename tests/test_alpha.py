"""Alpha coverage: which points it is made of, and how one of several alphas is chosen."""

import numpy as np
import pytest

from plumbline.operators import kernels, tiles


def inside(spark, boxes):
    rows = [(k, float(x), float(y), 0.0, 0.0, *map(float, to)) for k, (to, p) in boxes.items() for x, y in p]
    return spark.createDataFrame(rows, "box int, x double, y double, x0 double, y0 double, x1 double, y1 double")


def near(p):
    return np.array([np.partition(np.hypot(*(p - q).T), 1)[1] for q in p])


def test_small_boxes_are_not_thinned_and_sparse_ones_have_a_hull(spark):
    rng = np.random.default_rng(9)
    tight = rng.random((60, 2)) * 0.5 + 40  # of a box of 100 x 100: a single cell
    loose = rng.random((80, 2)) * 100
    four = np.array([[10, 10], [10.5, 10], [90, 90], [90.5, 90]])
    got = {r["box"]: r for r in tiles.alpha_coverage(inside(spark, {1: ((100, 100), np.concatenate([tight, tight[:5]])), 2: ((100, 100), loose), 3: ((100, 100), four), 4: ((0.6, 100), tight - 39.9)})).collect()}
    alpha = 1 / (2 * np.median(near(loose)))
    assert got[2]["alpha"] == pytest.approx(alpha) and got[2]["coverage"] == pytest.approx(kernels.alpha_area(loose, alpha) / 1e4)
    assert got[1]["n"] == 65 and got[1]["alpha"] == pytest.approx(1 / (2 * np.median(near(tight)))) and got[1]["coverage"] > 0
    assert got[3]["coverage"] > 0 and got[3]["alpha"] == pytest.approx(1)


def test_the_choice_of_alpha(spark):
    rng = np.random.default_rng(10)
    p = np.concatenate([rng.random((25, 2)) * 10, rng.random((25, 2)) * 10 + [80, 0], rng.random((12, 2)) * 30 + [30, 50]])
    shares = (0.55, 0.65, 0.75, 0.85, 0.92)
    (r,) = tiles.alpha_coverage(inside(spark, {1: ((100, 100), p)}), shares=shares).collect()
    tries = sorted({round(1 / (2 * d), 8) for d in np.quantile(near(p), shares)}, reverse=True)
    score = lambda a: sum(a) * (1 - 0.015 * (len(a) - 1)) + 0.05 * max(a)
    found = dict(zip(tries, kernels.alpha_polygons(p, tries)))
    best = max((t for t in tries if found[t]), key=lambda t: score(found[t]))
    assert r["alpha"] == pytest.approx(best) and r["coverage"] == pytest.approx(sum(found[best]) / 1e4)


def test_large_boxes_keep_their_distances(spark):
    p = np.random.default_rng(11).random((2100, 2)) * 100
    alike = tiles.MOST_ALPHA
    tiles.MOST_ALPHA = 100
    try:
        (r,) = tiles.alpha_coverage(inside(spark, {1: ((100, 100), p)})).collect()
    finally:
        tiles.MOST_ALPHA = alike
    assert r["n"] == 2100 and r["alpha"] == pytest.approx(1 / (2 * np.median(near(p))))


def test_kernels():
    square = np.array([[0, 0], [1, 0], [0, 1], [1.1, 1]])
    assert [len(a) for a in kernels.alpha_polygons(np.concatenate([square, square + 50]), [0.5])] == [2]
    assert kernels.buffered_in_box(np.array([[0.0, 0], [4, 0], [4, 4], [0, 4]]), 0, (1, 1, 9, 9)) == pytest.approx(9)
    assert kernels.buffered_in_box(np.array([[5.0, 5]]), 1, (0, 0, 9, 9)) == pytest.approx(np.pi, rel=0.01)
