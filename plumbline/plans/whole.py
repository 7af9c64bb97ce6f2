"""Queries over all points, where those of the same name cut the input by a value so that their SQL stays cheap.

They have no SQL; tests/test_whole.py holds them against brute force. Cells are finer than elsewhere, so that those of one
class are a fifth of the raster and neither empty nor one patch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import cells, graph, ordered, spatial, tiles
from plumbline.plans.fixtures import boxes, last, points
from plumbline.plans.queries import ground, query, r6, upper

c = F.col


def errors(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).where("cls = 'error'")


def fine(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[int, int]]:
    """Cells of 2 x 6 units with a point of the class error, and the shape of their raster."""
    x, y = last(spark, d)
    return cells.rasterize(errors(spark, d), F.floor(c("y") / 6).cast("int"), F.floor(c("x") / 2).cast("int"), "max"), (int(y // 6) + 1, int(x // 2) + 1)


@query()
def a10_coverage_all(spark, d):
    b = boxes(spark, d)
    inside = spatial.points_in_boxes(errors(spark, d), b, 30.0, 144.0)
    occ = inside.select("box", F.least(F.lit(9), F.floor((c("x") - c("x0")) / 3)).cast("int").alias("row"), F.least(F.lit(11), F.floor((c("y") - c("y0")) / 12)).cast("int").alias("col")).distinct()
    grown = cells.splat(occ, 1).where("row between 0 and 9 and col between 0 and 11").distinct()
    count = lambda t, to: t.groupBy("box").agg((F.count("*") / 120.0).alias(to))
    out = b.join(count(occ, "raw"), "box", "left").join(count(grown, "coverage"), "box", "left").na.fill(0.0, ["raw", "coverage"])
    return out.select("box", r6("raw"), r6("coverage"))


@query()
def j14_rescue_all(spark, d):
    """Boxes hold about 77 points of the class; most have the 70 that are asked for."""
    b = boxes(spark, d)
    inside = spatial.points_in_boxes(errors(spark, d), b, 30.0, 144.0).groupBy("box").agg(F.count("*").alias("n"))
    told = b.join(inside, "box", "left").withColumn("kept", F.coalesce("n", F.lit(0)) >= 70)
    return spatial.rescue(told, spatial.adjacency(b)).select("box", "kept", "final")


@query()
def j08_nn_spacing_all(spark, d):
    near = spatial.nearest_neighbours(points(spark, d), 16.0, ("cls",))
    return spatial.spacing(near, ("cls",)).select("cls", r6("q50"), r6("q75"), r6("q90"), "n")


@query()
def m17_distance_clusters_all(spark, d):
    return graph.distance_clusters(points(spark, d), 1.5)


@query()
def m06_components_all(spark, d):
    g, shape = fine(spark, d)
    return tiles.components(g, shape[1], 16)


@query()
def m03_closing_all(spark, d):
    g, shape = fine(spark, d)
    return tiles.closed(g, 3, 16, shape)


@query()
def m05_dilate_all(spark, d):
    return cells.dilate(fine(spark, d)[0], 3)


@query()
def j20_greedy_match_all(spark, d):
    """Points above the ground are matched to ground points of the same user."""
    a, b = (side(spark, d).select(c("x").cast("long").alias("image"), c("id").alias(i), "y") for side, i in ((upper, "pred"), (ground, "gt")))
    pairs = ordered.nearest_truths(a, b)
    return ordered.greedy_match(pairs, 25.0).select("image", "pred", "gt", r6("d"), "tp")
