"""Coverage of boxes against brute force, merged lines before squares, and decoding in both orders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import coverage, detect, kernels

BOX = "box int, x0 double, y0 double, x1 double, y1 double"


def near(p):
    return np.array([np.sort(np.hypot(*(p - q).T))[1] for q in p])


def brute(p, w, h, cell):
    """(raw, coverage, edge) of points in a box from 0, 0 to w, h."""
    apart = p[np.unique(np.floor(p * 100 + 0.5), axis=0, return_index=True)[1]]
    if len(p) < 3:
        return 0.0, 0.0, 0.0
    spacing, minor = (np.median(near(apart)), np.sqrt(max(np.linalg.eigvalsh(np.cov(apart.T))[0], 0))) if len(apart) >= 3 else (0.0, 0.0)
    nx, ny = max(1, int(np.ceil(w / cell))), max(1, int(np.ceil(h / cell)))
    if nx * ny > 16000:
        cell *= np.sqrt(nx * ny / 16000)
        nx, ny = max(1, int(np.ceil(w / cell))), max(1, int(np.ceil(h / cell)))
    r = min(6, int(np.ceil(max(0.75, 0.6 * spacing, 1.25 * minor) / cell)))
    hit = {(min(nx - 1, int(x / cell)), min(ny - 1, int(y / cell))) for x, y in p}
    cells = [(i, j) for i in range(nx) for j in range(ny) if (i + 0.5) * cell <= w + 0.25 and (j + 0.5) * cell <= h + 0.25]
    grown = {(i + a, j + b) for i, j in hit for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r}
    edge = np.mean([min(x, w - x, y, h - y) <= max(2.0, 0.5 * cell) for x, y in p])
    return sum(k in hit for k in cells) / len(cells), sum(k in grown for k in cells) / len(cells), edge


def tables(spark, made):
    boxes = spark.createDataFrame([(k, 0.0, 0.0, float(w), float(h)) for k, (w, h, _) in made.items()], BOX)
    rows = [(k, float(x), float(y)) for k, (_, _, p) in made.items() for x, y in p]
    return boxes, spark.createDataFrame(rows, "box int, x double, y double").join(boxes, "box")


def test_grid_coverage(spark):
    rng = np.random.default_rng(4)
    made = {
        1: (100, 70, rng.random((25, 2)) * [100, 70]),
        2: (200, 200, rng.random((9, 2)) * [40, 3] + 60),
        3: (50, 30, rng.random((2, 2)) * 30),
        4: (50, 30, np.empty((0, 2))),
        5: (3000, 2500, rng.random((12, 2)) * [3000, 2500]),
        6: (40, 40, np.array([[5.0, 5.0]] * 4)),
        7: (60, 0, np.array([[5.0, 0.0]] * 4)),
    }
    got = {r["box"]: r for r in coverage.grid_coverage(*tables(spark, made)).collect()}
    assert sorted(got) == sorted(made)
    for k, (w, h, p) in made.items():
        want = (0.0, 0.0, 0.0) if k == 7 else brute(p, w, h, 12.0)
        assert got[k]["n"] == len(p) and (got[k]["raw"], got[k]["coverage"], got[k]["edge"]) == pytest.approx(want, abs=1e-9)
        assert got[k]["gain"] == pytest.approx(want[1] - want[0], abs=1e-9)


def test_only_boxes_near_the_threshold_are_refined(spark):
    rng = np.random.default_rng(5)
    made = {1: (100, 100, rng.random((300, 2)) * 100), 2: (100, 100, rng.random((12, 2)) * [100, 20]), 3: (100, 100, np.empty((0, 2)))}
    boxes, inside = tables(spark, made)
    grid = {r["box"]: r["coverage"] for r in coverage.grid_coverage(boxes, inside).collect()}
    got = {r["box"]: r for r in coverage.box_coverage(boxes, inside, threshold=grid[1]).collect()}
    assert got[1]["refined"] and got[1]["coverage"] >= grid[1]
    assert not got[2]["refined"] and got[2]["coverage"] == pytest.approx(grid[2])
    assert not got[3]["refined"] and got[3]["coverage"] == 0 and got[3]["n"] == 0
    p = made[1][2]
    shape = kernels.alpha_area(p, 1 / (2 * np.median(near(p)))) / 1e4
    assert got[1]["coverage"] == pytest.approx(min(1, max(grid[1], shape)))


def test_broken_sides_make_a_square_once_merged(spark):
    sides = [(1, 100.0, 100.0, 180.0, 100.0), (2, 175.0, 100.0, 300.0, 100.0), (3, 300.0, 100.0, 300.0, 300.0), (4, 100.0, 300.0, 300.0, 300.0), (5, 100.0, 100.0, 100.0, 190.0), (6, 100.0, 185.0, 100.0, 300.0)]
    lines = spark.createDataFrame([(1, *s) for s in sides], "building int, line int, x1 double, y1 double, x2 double, y2 double")
    (s,) = detect.predicted_squares(lines, "building").collect()
    assert sorted(zip(s["xs"], s["ys"])) == [(100, 100), (100, 300), (300, 100), (300, 300)]
    assert s["degree"] == pytest.approx(1) and s["length"] == pytest.approx(1)
    assert detect.scored_squares(detect.corners(lines, "building"), "building").count() == 0


def test_training_lines_come_in_both_orders(spark):
    heat = spark.createDataFrame([("a", 4, 6, 2.0, -2.0, 0.0, 2.0, 1.0), ("a", 9, 9, 2.0, -0.5, 0.0, 0.5, 0.0)], "img string, row int, col int, v double, dx0 double, dy0 double, dx1 double, dy1 double")
    (r,) = detect.training_lines(heat).collect()
    assert (r["x1"], r["y1"], r["x2"], r["y2"]) == (4, 4, 8, 5) == (r["sx2"], r["sy2"], r["sx1"], r["sy1"])
    assert (r["row"], r["col"]) == (4, 6)
    assert detect.training_lines(heat.where(F.lit(False))).count() == 0
