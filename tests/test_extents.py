"""Rasters and boxes reach as far as the table: a table of 80 columns and 31 rows against brute force in DuckDB."""

import duckdb
import pytest

from plumbline.plans import QUERIES
from plumbline.plans.fixtures import BOXES_SQL, POINTS_SQL, boxes

SF = "/root/testdata/sf0.001"
GRID = "CAST(floor(y / 24) AS INT) AS row, CAST(floor(x / 5) AS INT) AS col"


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    folder = tmp_path_factory.mktemp("wide")
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (event_id * 7 % 400 AS user_id, ts + INTERVAL 1 DAY AS ts, value + 150 AS value) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    c.execute(f"COPY (FROM '{SF}/nation.parquet') TO '{folder}/nation.parquet'")
    c.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    c.execute(f"CREATE VIEW points AS WITH {POINTS_SQL} FROM points")
    return str(folder), c


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


def mask(db, where):
    return set(db.execute(f"SELECT DISTINCT {GRID} FROM points WHERE {where}").fetchall())


def closed(cells, disk, height, width):
    at = lambda r, c: 0 <= r < height and 0 <= c < width
    grown = {(r + i, c + j) for r, c in cells for i, j in disk}
    inside = {x for x in grown if at(*x)}
    return {x for x in inside if all((x[0] + i, x[1] + j) in inside for i, j in disk)}, {x for x in grown if at(*x) and all((x[0] + i, x[1] + j) in grown for i, j in disk)}


def test_rasters(spark, wide):
    d, db = wide
    total, error = db.execute("SELECT count(*) FROM points").fetchone()[0], mask(db, "cls = 'error'")
    assert db.execute("SELECT max(x), floor(max(y) / 24) FROM points").fetchone() == (399, 30)
    got = QUERIES["m01_tile_cut"](spark, d).collect()
    want = dict(db.execute("SELECT CAST(8 * floor(y / 240) + floor(x / 50) + 1 AS INT), count(*) FROM points GROUP BY 1").fetchall())
    assert {r["part"]: r["n"] for r in got} == want and sum(want.values()) == total
    assert QUERIES["a21_valid_ratio"](spark, d).first()["valid_ratio"] == pytest.approx(len(error) / (31 * 80), abs=1e-6)
    cross = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)]
    assert set(rows(QUERIES["m03_closing"](spark, d))) == closed(error, cross, 31, 80)[0]
    disk = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9]
    assert set(rows(QUERIES["m03_closing_tiles"](spark, d))) == closed(mask(db, "cls = 'error' AND z > 200"), disk, 31, 80)[1]
    near = db.execute(f"SELECT {GRID}, max(z) AS z FROM points WHERE cls = 'error' GROUP BY 1, 2").fetchall()
    source = {(r, c): z for r, c, z in near}
    want = [(i, j, source[key]) for i in range(60) for j in range(70) if (key := (int((i + 0.5) / 1.5), int((j + 0.5) * 1.5))) in source]
    assert rows(QUERIES["m11_reproject"](spark, d)) == want
    assert {r["flipped"] for r in QUERIES["p30_flip_normalize"](spark, d).collect()} <= set(range(80))


def test_cells_of_wide_rows_are_not_mixed_up(spark, wide):
    d, db = wide
    want = db.execute(f"WITH p AS (SELECT *, {GRID} FROM points) SELECT id FROM p WHERE cls <> 'purchase' AND EXISTS (SELECT 1 FROM p q WHERE q.cls = 'purchase' AND q.row = p.row AND q.col = p.col) ORDER BY id").fetchall()
    assert sorted(r["id"] for r in QUERIES["j04_semi_pixels"](spark, d).collect()) == [i for i, in want]
    want = db.execute(f"WITH p AS (SELECT *, {GRID} FROM points), c AS (SELECT DISTINCT cls, row, col FROM p WHERE z > 250) SELECT c.cls, count(*) FROM c JOIN p USING (row, col) GROUP BY 1").fetchall()
    assert {r["cluster"]: r["n"] for r in QUERIES["j05_points_per_cluster"](spark, d).collect()} == dict(want)
    left, want = mask(db, "cls = 'error' AND z > 200"), {}
    while left:
        todo, found = [left.pop()], set()
        while todo:
            found.add(at := todo.pop())
            for i in (-1, 0, 1):
                for j in (-1, 0, 1):
                    if (n := (at[0] + i, at[1] + j)) in left:
                        left.discard(n)
                        todo.append(n)
        want |= dict.fromkeys(found, min(r * 80 + c for r, c in found))
    assert {(r["row"], r["col"]): r["component"] for r in QUERIES["m06_components"](spark, d).collect()} == want


def test_boxes(spark, wide):
    d, db = wide
    b = boxes(spark, d).collect()
    assert len({r["box"] for r in b}) == len({(r["x0"], r["y0"]) for r in b}) == len(b) == 3 * 2 * 25
    assert (max(r["x1"] for r in b), max(r["y1"] for r in b)) == (450, 1440)
    want = db.execute("SELECT floor(x / 30) * 30, floor(y / 144) * 144, count(*) FROM points WHERE x % 30 <> 0 GROUP BY 1, 2").fetchall()
    at = {r["box"]: (r["x0"], r["y0"]) for r in b}
    assert {at[r["box"]]: r["n"] for r in QUERIES["j06_points_in_box"](spark, d).collect()} == {(x, y): n for x, y, n in want}
    small = duckdb.connect()
    small.execute(f"CREATE VIEW nation AS FROM '{SF}/nation.parquet'")
    assert rows(boxes(spark, SF)) == sorted(small.execute(f"WITH {BOXES_SQL} SELECT box, x0, y0, x1, y1 FROM boxes").fetchall())
