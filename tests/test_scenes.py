"""Graph, seam, square, alpha and file operators against brute force and planted cases."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import detect, graph, kernels, tiles
from plumbline.sources import files


def roots(pairs):
    u = kernels.Unions()
    for a, b in pairs:
        u.join(a, b)
    return {v: u.find(v) for v in list(u.up)}


@pytest.mark.parametrize("shape", ["path", "random", "star"])
def test_connected(spark, shape):
    rng = np.random.default_rng(5)
    pairs = {"path": [(i, i + 1) for i in range(60)], "random": [tuple(map(int, rng.integers(0, 120, 2))) for _ in range(70)], "star": [(99, i) for i in range(50)]}[shape]
    pairs = [(a, b) for a, b in pairs if a != b]
    got = graph.connected(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["vertex"]: r["component"] for r in got} == roots(pairs)


def test_connected_without_links(spark):
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_distance_clusters(spark):
    rng = np.random.default_rng(6)
    p = rng.random((150, 2)) * 20 - 10
    p[:3] = p[3]  # repeated points
    got = graph.distance_clusters(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double"), 1.0).collect()
    pairs = [(i, j) for i in range(150) for j in range(i, 150) if np.hypot(*(p[i] - p[j])) <= 1.0]
    assert {r["id"]: r["cluster"] for r in got} == roots(pairs)


def test_seams_join_parts_over_a_gap(spark):
    cells = [(r, col, 1) for r in range(3, 6) for col in range(4, 9)] + [(r, col, 2) for r in range(3, 6) for col in range(11, 16)] + [(15, 2, 3)]
    pairs, bridge = tiles.seams(spark.createDataFrame(cells, "row int, col int, component long"), 20, 10, 4, 2)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
    found = {(r["row"], r["col"]): r["a"] for r in bridge.collect()}
    assert found[(4, 9)] == 1 and found[(4, 10)] == 1 and all(5 < col < 14 for _, col in found)


def test_a_square_and_no_square(spark):
    square = [("s", 0, 10, 10, 60, 10), ("s", 1, 60, 10, 60, 60), ("s", 2, 10, 60, 60, 60), ("s", 3, 10, 10, 10, 60)]
    apart = [("t", 0, 0, 0, 10, 0), ("t", 1, 100, 100, 100, 120), ("t", 2, 300, 0, 310, 0)]
    lines = spark.createDataFrame([(k, i, float(a), float(b), float(c), float(d)) for k, i, a, b, c, d in square + apart], "building string, line int, x1 double, y1 double, x2 double, y2 double")
    corners = detect.corners(lines, "building")
    assert sorted((r["a"], r["b"], r["kind"]) for r in corners.collect()) == [(0, 1, 1), (0, 3, 0), (1, 2, 2), (2, 3, 3)]
    (s,) = detect.scored_squares(corners, "building").collect()
    assert (s["overlap"], s["degree"], s["length"]) == pytest.approx((1, 1, 1)) and s["area"] == pytest.approx(2500 / 256**2)
    assert s["center"] == pytest.approx(np.hypot(93, 93) / (256 / 2**0.5))


def test_lines_near_invalid_pixels(spark):
    lines = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0, 0.0), (1, 2, 0.0, 2.0, 5.0, 2.0), (1, 3, 7.9, 1.0, 90.0, 1.0)], "building int, line int, x1 double, y1 double, x2 double, y2 double")
    valid = spark.createDataFrame([(r, col) for r in range(4) for col in range(10) if not (r == 2 and col in (3, 4))], "row int, col int")
    assert sorted(r["line"] for r in detect.off_invalid(lines, valid, 4, 10).collect()) == [1, 3]


def test_alpha_areas_grow_with_the_radius():
    p = np.random.default_rng(7).random((80, 2))
    areas = kernels.alpha_areas(p, [20.0, 5.0, 1e-4])
    assert areas == sorted(areas) and areas[2] == pytest.approx(kernels.alpha_area(p, 1e-4))
    assert kernels.alpha_areas(np.zeros((3, 2)), [1.0]) == [0.0]


def test_files(spark, tmp_path):
    for n in (3, 12):
        (tmp_path / f"ground_part_{n}.npy").write_bytes(b"x")
    (tmp_path / "readme.npy").write_bytes(b"")
    found = files.discover(spark, str(tmp_path), "*.npy")
    assert sorted(r["part"] for r in files.parts(found).collect()) == [3, 12]
    assert sorted(r["part"] for r in files.parts(found.where("part is null")).collect()) == list(range(1, 10))
    (tmp_path / "ground_part_3.stats.json").write_text(json.dumps({"est_spacing": {"dx": 0.5, "dy": 0.75}}))
    (tmp_path / "ground_part_12.stats.json").write_text("{not json")
    items = spark.createDataFrame([("ground", 3), ("ground", 12), ("ground", 4)], "tag string, part int")
    got = files.with_spacing(items, files.read_stats(spark, str(tmp_path)), 1.0, 2.0).collect()
    assert {r["part"]: (r["dx"], r["dy"]) for r in got} == {3: (0.5, 0.75), 12: (1.0, 2.0), 4: (1.0, 2.0)}
    with pytest.raises(FileNotFoundError):
        files.load_config(str(tmp_path / "none.yaml"))
    (tmp_path / "c.yaml").write_text("tile_size: 1000\n")
    assert files.load_config(str(tmp_path / "c.yaml")) == {"tile_size": 1000}
    points = spark.createDataFrame([(1, 0.5, 1.5, 2.5), (2, 3.0, 4.0, 5.0)], "building int, x double, y double, z double")
    files.write_points_csv(points, str(tmp_path / "csv"), "building")
    assert sorted(os.listdir(tmp_path / "csv"))[-2:] == ["building=1", "building=2"]
    back = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "csv"))
    assert sorted((r["building"], r["X"], r["Y"], r["Z"]) for r in back.collect()) == [(1, 0.5, 1.5, 2.5), (2, 3.0, 4.0, 5.0)]
    regions = spark.createDataFrame([("a.png", [([1, 2], [3, 4])])], "filename string, regions array<struct<all_x: array<int>, all_y: array<int>>>")
    assert files.polygon_rings(regions).first()["ring"][1]["y"] == 4.0
    mask = spark.createDataFrame([(0,), (100,), (255,)], "v int").select(files.binary_mask(F.col("v")).alias("a"), files.binary_mask(F.col("v"), True).alias("b"))
    assert [tuple(r) for r in mask.collect()] == [(0, 0), (1, 0), (1, 1)]
