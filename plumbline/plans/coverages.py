"""Registered queries on how much of a box its points cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import coverage, spatial
from plumbline.plans.fixtures import BOXES_SQL, POINTS_SQL, boxes, points
from plumbline.plans.queries import query, r6

c = F.col
SIDE = 4.0


def held(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The boxes, and the points of the class error with the box that holds them."""
    b = boxes(spark, d)
    return b, spatial.points_in_boxes(points(spark, d).where("cls = 'error'"), b, 30.0, 144.0)


_GRID_COVERAGE = (
    f"WITH {POINTS_SQL}, {BOXES_SQL}, "
    "p AS (SELECT box, x, y, x0, y0, x1, y1 FROM points JOIN boxes ON x > x0 AND x < x1 AND y > y0 AND y < y1 WHERE cls = 'error'), "
    "u AS (SELECT box, x, min(y) AS y FROM p GROUP BY box, x, floor(y * 100 + 0.5)), "
    "nn AS (SELECT a.box, a.x, a.y, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM u a JOIN u b ON a.box = b.box AND (a.x <> b.x OR a.y <> b.y) GROUP BY 1, 2, 3), "
    "sp AS (SELECT box, quantile_cont(d, 0.5) AS spacing FROM nn GROUP BY box), "
    "va AS (SELECT box, count(*) AS many, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM u GROUP BY box), "
    "st AS (SELECT box, CASE WHEN many >= 3 THEN spacing ELSE 0 END AS spacing, CASE WHEN many >= 3 THEN sqrt(greatest((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + vxy ** 2), 0)) ELSE 0 END AS minor FROM va LEFT JOIN sp USING (box)), "
    "n AS (SELECT box, count(*) AS n, avg(CAST(least(x - x0, x1 - x, y - y0, y1 - y) <= 2 AS INT)) AS edge FROM p GROUP BY box), "
    "b AS (SELECT boxes.box, coalesce(n, 0) AS n, edge, coalesce(spacing, 0) AS spacing, coalesce(minor, 0) AS minor, CAST(least(6, ceil(greatest(0.75, 0.6 * coalesce(spacing, 0), 1.25 * coalesce(minor, 0)) / 4)) AS INT) AS r FROM boxes LEFT JOIN n USING (box) LEFT JOIN st USING (box)), "
    "o AS (SELECT DISTINCT box, CAST(floor((x - x0) / 4) AS INT) AS i, CAST(floor((y - y0) / 4) AS INT) AS j FROM p), "
    "g AS (SELECT DISTINCT box, o.i + di AS i, o.j + dj AS j FROM o JOIN b USING (box), range(-6, 7) s(di), range(-6, 7) t(dj) WHERE di * di + dj * dj <= r * r AND o.i + di BETWEEN 0 AND 7 AND o.j + dj BETWEEN 0 AND 35), "
    "raw AS (SELECT box, count(*) AS raw FROM o GROUP BY box), whole AS (SELECT box, count(*) AS whole FROM g GROUP BY box) "
    "SELECT box, n, round(CASE WHEN n >= 3 THEN coalesce(raw, 0) / 288.0::DOUBLE ELSE 0 END, 6) AS raw, round(CASE WHEN n >= 3 THEN whole / 288.0::DOUBLE ELSE 0 END, 6) AS coverage, round(CASE WHEN n >= 3 THEN (whole - coalesce(raw, 0)) / 288.0::DOUBLE ELSE 0 END, 6) AS gain, round(CASE WHEN n >= 3 THEN edge ELSE 0 END, 6)::DOUBLE AS edge, round(CASE WHEN n >= 3 THEN spacing ELSE 0 END, 6)::DOUBLE AS spacing, round(CASE WHEN n >= 3 THEN minor ELSE 0 END, 6)::DOUBLE AS minor FROM b LEFT JOIN raw USING (box) LEFT JOIN whole USING (box)"
)


@query(_GRID_COVERAGE)
def a10b_grid_coverage(spark, d):
    """A box is 30 x 144; of its 8 x 36 cells of 4 units the last column's middles lie on its edge."""
    out = coverage.grid_coverage(*held(spark, d), cell=SIDE)
    return out.select("box", "n", *[r6(v) for v in ("raw", "coverage", "gain", "edge", "spacing", "minor")])


@query()
def a11_box_coverage(spark, d):
    return coverage.box_coverage(*held(spark, d), cell=SIDE).select("box", "n", r6("coverage"), "refined")
