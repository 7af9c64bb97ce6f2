"""Box heights, filled heights above ground, rings, crops, catalogues and files against brute force or round trips."""

import io
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.functions import rings, scalar
from plumbline.operators import detect, heights, score, tiles
from plumbline.sources import files, geotiff, las


def brute_height(box, points):
    x0, y0, x1, y1 = box
    area, cx, cy = (x1 - x0) * (y1 - y0), (x0 + x1) / 2, (y0 + y1) / 2
    far, n, step = math.hypot(x1 - cx, y1 - cy), 10 if area > 4 else 3, 0.25 * math.sqrt(area)
    for k in range(4):
        more = k * step
        away = lambda x, y: math.hypot(max(x0 - x, 0, x - x1), max(y0 - y, 0, y - y1))  # noqa: B023, E731
        pts = [p for p in points if (x0 < p[0] < x1 and y0 < p[1] < y1) or (k and away(p[0], p[1]) < more)]
        sx, sy = (x1 - x0 + 2 * more) / n, (y1 - y0 + 2 * more) / n
        bins, first = {}, {}
        for i in range(n):
            for j in range(n):
                ax, ay = x0 - more + i * sx, y0 - more + j * sy
                zs = [z for x, y, z in pts if ax < x < x0 - more + (i + 1) * sx and ay < y < y0 - more + (j + 1) * sy]
                w = max(0.0, 1 - math.hypot(ax + sx / 2 - cx, ay + sy / 2 - cy) / far) ** 2
                if zs and w > 0:
                    b = math.floor(max(zs) / 0.02)
                    bins.setdefault(b, []).append((max(zs), w))
                    first.setdefault(b, (i, j))
        if bins:
            best = max(bins, key=lambda b: (round(sum(w for _, w in bins[b]), 9), [-v for v in first[b]]))
            return sum(z * w for z, w in bins[best]) / sum(w for _, w in bins[best]), k
    near = sorted((z, 1 / max(math.hypot(x - cx, y - cy), 1e-3)) for x, y, z in points if x0 - 1 <= x <= x1 + 1 and y0 - 1 <= y <= y1 + 1)
    if near:
        run, total = 0.0, sum(w for _, w in near)
        for z, w in near:
            run += w
            if run >= 0.9 * total:
                return z, 4
    return (float(np.percentile([p[2] for p in points], 90)), 5) if points else (None, None)


def test_box_heights_equal_brute_force(spark):
    rng = random.Random(2)
    boxes = [(b, i, (x, y, x + w, y + h)) for b in (1, 2, 3) for i, (x, y, w, h) in enumerate([(0, 0, 4, 5), (10, 0, 1.5, 1.2), (20, 20, 6, 6), (40, 40, 2, 2), (10, 30, 3, 1), (60, 0, 5, 4)])]
    cloud = {1: [(rng.uniform(-2, 30), rng.uniform(-2, 30), rng.choice([3.0, 3.01, 7.5, 9.0])) for _ in range(400)], 2: [(9.8, 0.5, 4.0), (25.0, 27.5, 8.0), (19.2, 19.2, 6.5), (59.2, 2.0, 2.0)], 3: []}
    cloud[1] += [(0.0, 1.0, 99.0), (4.0, 2.0, 99.0)]  # on an edge
    c = F.col
    ring = rings.make_ring((c("x0"), c("y0")), (c("x1"), c("y0")), (c("x1"), c("y1")), (c("x0"), c("y1")))
    frame = spark.createDataFrame([(b, i, *map(float, r)) for b, i, r in boxes], "building int, box int, x0 double, y0 double, x1 double, y1 double").withColumn("ring", ring)
    points = spark.createDataFrame([(b, *map(float, p)) for b, ps in cloud.items() for p in ps], "building int, x double, y double, z double")
    got = {(r["building"], r["box"]): (r["z"], r["level"]) for r in heights.box_heights(frame, points).collect()}
    levels = set()
    for b, i, r in boxes:
        z, level = brute_height(r, cloud[b])
        assert got[b, i][1] == level and (z is None or math.isclose(got[b, i][0], z, abs_tol=1e-9)), (b, i, got[b, i], z, level)
        levels.add(level)
    assert {0, 5, None} <= levels and levels & {1, 2, 3}


def test_height_above_filled_ground(spark):
    rng = random.Random(4)
    ground = {(rng.randrange(20), rng.randrange(15)): float(rng.randrange(1, 5)) for _ in range(30)} | {(3, 3): 0.0}
    upper = {(r, c): float(rng.randrange(0, 30)) for r in range(20) for c in range(15)}
    frame = lambda d: spark.createDataFrame([(r, c, z) for (r, c), z in d.items()], "row int, col int, z double")
    for zero in (False, True):
        got = {(r["row"], r["col"]): r["agl"] for r in tiles.height_above_filled(frame(upper), frame(ground), 10.0, (20, 15), zero).collect()}
        valid = {k: z for k, z in ground.items() if z or not zero}
        for (r, c), z in upper.items():
            near = min((r - a) ** 2 + (c - b) ** 2 for a, b in valid)
            options = {z - g for (a, b), g in valid.items() if (r - a) ** 2 + (c - b) ** 2 == near}
            if (r, c) in got:
                assert got[r, c] in options and got[r, c] >= 10
            else:
                assert min(options) < 10 or (zero and z == 0)


def test_rings_are_valid(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    cases = [(square, True), (square[::-1], True), ([(0, 0), (2, 2), (2, 0), (0, 2)], False), ([(0, 0), (1, 0), (2, 0)], False), ([(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], False), ([(0, 0), (4, 0), (2, 0), (2, 3)], False), (square[:2], False)]
    frame = spark.createDataFrame([(i, [(float(x), float(y)) for x, y in r]) for i, (r, _) in enumerate(cases)], "i int, ring array<struct<x:double,y:double>>")
    got = {r["i"]: r["v"] for r in frame.select("i", rings.is_valid(F.col("ring")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [v for _, v in cases]


def test_smooth_l1_and_merged_lines(spark):
    row = spark.range(1).select(scalar.smooth_l1(F.lit(0.5), F.lit(0.0)).alias("a"), scalar.smooth_l1(F.lit(3.0), F.lit(0.0)).alias("b")).first()
    assert (row["a"], row["b"]) == (0.125, 2.5)
    lines = [(1, 1, 0.0, 10.0, 20.0, 10.0), (1, 2, 30.0, 10.2, 50.0, 10.2), (1, 3, 5.0, 100.0, 5.0, 180.0)]
    out = detect.merged_lines(spark.createDataFrame(lines, "b int, line int, x1 double, y1 double, x2 double, y2 double"), "b").collect()
    assert {(r["x1"], r["x2"]) for r in out} == {(0.0, 50.0), (5.0, 5.0)}


def tiff(order, width, height, tags):
    fields = sorted([(256, "H", (width,)), (257, "H", (height,)), *tags])
    kinds = {"H": 3, "d": 12}
    body, rows, at = b"", b"", 8 + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        raw = struct.pack(f"{order}{len(values)}{kind}", *values)
        place = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", at + len(body))
        body += b"" if len(raw) <= 4 else raw
        rows += struct.pack(order + "HHI", tag, kinds[kind], len(values)) + place
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(fields)) + rows + b"\0" * 4 + body


def test_geotiff_catalogue(spark, tmp_path):
    told = [(33550, "d", (0.5, 0.25, 0.0)), (33922, "d", (0.0, 0.0, 0.0, 100.0, 900.0, 0.0)), (34735, "H", (1, 1, 0, 1, 3072, 0, 1, 32648))]
    (tmp_path / "a.tif").write_bytes(tiff("<", 40, 20, told))
    (tmp_path / "b.tiff").write_bytes(tiff(">", 7, 9, []))
    (tmp_path / "c.tif").write_bytes(b"no image")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in geotiff.read_catalogue(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.tif", "b.tiff"}
    a, b = rows["a.tif"], rows["b.tiff"]
    assert (a["width"], a["height"], a["a"], a["e"], a["x0"], a["y0"], a["x1"], a["y1"], a["epsg"]) == (40, 20, 0.5, -0.25, 100.0, 895.0, 120.0, 900.0, 32648)
    assert (b["width"], b["height"], b["a"], b["epsg"]) == (7, 9, 1.0, None)


def test_files_round_trips(spark, tmp_path):
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "a.json").write_text('[[{"x": 1, "y": 2}, {"x": 3, "y": 2.5}], []]')
    (folder / "b.json").write_text("[]")
    (folder / "c.json").write_text("not json")
    rows = sorted((r["file"], r["box"], len(r["ring"])) for r in files.read_boxes(spark, str(folder)).collect())
    assert rows == [("a.json", 0, 2), ("a.json", 1, 0)]
    points = spark.createDataFrame([(1, 0.0)] * 5 + [(2, 0.0)] * 2 + [(None, 0.0)] * 1, "building int, z double")
    kept, removed = files.quarantine(points, "building", 3)
    assert kept.count() == 5 and removed.count() == 3
    cells = spark.createDataFrame([(0, 1, 7), (2, 3, 7), (4, 5, 9)], "row int, col int, cluster long")
    files.write_clusters(cells, str(tmp_path / "clusters"))
    assert sorted(map(tuple, files.read_clusters(spark, str(tmp_path / "clusters")).select("row", "col", "cluster").collect())) == [(0, 1, 7), (2, 3, 7), (4, 5, 9)]
    out = las.npy_files(spark.createDataFrame([(1, 0, 1, 2.5)], "part int, row int, col int, z double"), "part", 2, 3).first()
    grid = np.load(io.BytesIO(out["content"]))
    assert grid.shape == (2, 3) and grid[0, 1] == 2.5 and np.isnan(grid).sum() == 5


def test_parts_are_validated(spark):
    good = [(p, 10 + (p - 1) // 3, 20 + (p - 1) % 3) for p in range(1, 10)]
    frame = lambda rows: spark.createDataFrame(rows, "part int, height int, width int")
    assert files.validated_parts(frame(good)).count() == 9
    for bad in (good[:8], good + good[:1], [*good[:8], (9, 99, 22)], [*good[:8], (9, 12, 99)]):
        with pytest.raises(ValueError):
            files.validated_parts(frame(bad))


def test_scorer_surface(spark):
    def load():
        return lambda batch: pa.RecordBatch.from_arrays([pa.array([2 * v for v in batch.column(0).to_pylist()], pa.int64())], ["v"])

    assert score.scored(spark.range(5), load, "v long").agg(F.sum("v")).first()[0] == 20
