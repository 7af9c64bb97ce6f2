import math

import numpy as np
import pytest

from plumbline.operators import kernels as k


def brute_disk(mask, r):
    h, w = mask.shape
    return np.array([[sum(mask[i + a, j + b] for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r and 0 <= i + a < h and 0 <= j + b < w) for j in range(w)] for i in range(h)])


@pytest.mark.parametrize("r", [1, 2, 4])
def test_morphology(r):
    mask = np.random.default_rng(r).random((17, 23)) < 0.25
    assert (k.disk_count(mask, r) == brute_disk(mask, r)).all()
    closed = k.close(mask, r, "global")
    assert (closed >= mask).all() and (k.close(closed, r, "global") == closed).all()
    grid = np.zeros((5, 5), bool)
    grid[2, [1, 3]] = True
    assert k.close_line(grid, 3, 1)[2].tolist() == [False, True, True, True, False]


def test_label_and_propagation():
    mask = np.random.default_rng(1).random((30, 40)) < 0.4
    names = k.label(mask)
    unions = k.Unions()
    for i, j in zip(*np.nonzero(mask)):
        for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)):
            if 0 <= i + a < 30 and 0 <= j + b < 40 and mask[i + a, j + b]:
                unions.join(int(i * 40 + j), int((i + a) * 40 + j + b))
    roots = sorted({unions.find(int(i * 40 + j)) for i, j in zip(*np.nonzero(mask))})
    want = np.zeros_like(names)
    for i, j in zip(*np.nonzero(mask)):
        want[i, j] = roots.index(unions.find(int(i * 40 + j))) + 1
    assert (names == want).all()
    core = np.zeros_like(mask)
    core[tuple(np.argwhere(mask)[0])] = True
    assert (k.propagate(core, mask) == (names == 1)).all()
    assert (k.label(np.ones((2, 2), bool)) == 1).all() and (k.label(np.zeros((2, 2), bool)) == 0).all()


def test_fill_nearest():
    rng = np.random.default_rng(2)
    values = np.where(rng.random((14, 11)) < 0.15, rng.random((14, 11)), np.nan)
    filled, known = k.fill_nearest(values), np.argwhere(np.isfinite(values))
    for i in range(14):
        for j in range(11):
            d = ((known - [i, j]) ** 2).sum(1)
            assert filled[i, j] in [values[tuple(p)] for p in known[d == d.min()]]
    assert np.isnan(k.fill_nearest(np.full((2, 2), np.nan))).all()


def test_seam_with_a_gap():
    left, right = np.zeros((9, 6), int), np.zeros((9, 6), int)
    left[3:6, 2:5], right[3:6, 0:3] = 7, 9
    pairs, bridge = k.seam_pairs(left, right, 2)
    assert pairs == {(7, 9)} and bridge[4, 5]


def test_lines():
    bins = np.array([10.0, 11, 12, 95, 96, 170])
    assert len(set(k.mean_shift_1d(bins, np.ones(6), 5.0))) == 3
    totals = np.zeros(180)
    totals[[10, 97, 100]] = 50, 20, 5
    assert k.snap_orthogonal([10, 97], totals) == [10, 97]
    lines = np.array([[0, 0, 10, 0], [0, 0.2, 9, 0.2], [0, 3, 5, 3]], float)
    assert k.suppress_parallel(lines, np.array([10.0, 9, 5]), 0.0, 0.5) == [0, 2]
    square = np.array([[-1, 0, 5, 0], [-1, 4, 5, 4], [0, -1, 0, 5], [4, -1, 4, 5]], float)
    assert [sorted(f) for f in k.polygonize(square)] == [[(0.0, 0.0), (0.0, 4.0), (4.0, 0.0), (4.0, 4.0)]]
    assert len(k.polygonize(np.vstack([square, [[2, -1, 2, 5]]]))) == 2


def test_polygons():
    rng = np.random.default_rng(3)
    p = rng.random((60, 2))
    hull = k.convex_hull(p)
    for a, b in zip(hull, np.roll(hull, -1, 0)):
        assert ((b[0] - a[0]) * (p[:, 1] - a[1]) - (b[1] - a[1]) * (p[:, 0] - a[0]) >= -1e-12).all()
    area = lambda r: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, list(r[1:]) + [r[0]])) / 2
    assert math.isclose(area([tuple(x) for x in k.expand(hull)]), 1.21 * area([tuple(x) for x in hull]))
    assert math.isclose(k.alpha_area(p, 1e-4), area([tuple(x) for x in hull]), rel_tol=1e-6)
    box = lambda x, y: [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)]
    merged = k.dissolve([box(0, 0), box(1, 0)[::-1], box(5, 5)])
    assert sorted(area(r) for r in merged) == [1, 2]
    assert k.prune_boxes([{1}, set(range(50)), set(range(40))], [0.9, 0.9, 0.2]) == [1]


def test_ground_filter_ignores_a_building():
    heights = np.zeros((30, 30)) + np.linspace(0, 2, 30)
    heights[10:16, 10:16] += 15
    ground = k.ground_filter(heights)
    assert np.abs(ground[0] - heights[0]).max() < 0.5 and ground[12, 12] < 8
