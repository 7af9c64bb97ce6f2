"""Box heights: a weighted mode on a grid, widened step by step until it finds points, then percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.rings import area2, centroid, contains_strictly, edge_distance
from plumbline.operators.ordered import weighted_mode, weighted_percentile
from plumbline.operators.spatial import points_in_boxes

# Cells along a side for large and for small boxes and the area between them, the bin of heights, how often
# and by which share of the area's root a box is widened, the margin of the last pass and its percentile.
LARGE, SMALL, LARGE_AREA = 10, 3, 4.0
Z_BIN, WIDENINGS, WIDENING, MARGIN, SHARE = 0.02, 3, 0.25, 1.0, 0.9


def box_heights(boxes: DataFrame, points: DataFrame, building: str = "building", key: str = "box", ring: str = "ring", bucket: float = 64.0) -> DataFrame:
    """(building, key, z, level): a height for every box (building, key, ring) of some area from its building's points.

    A box's grid of 10 x 10 cells (3 x 3 up to an area of 4) gives each cell's greatest z, weighted by how near its middle
    is to the box's; z is the weighted mean of the heaviest bin of 0.02. Points count if they lie strictly inside the
    box (level 0) or, while no weight is found, inside it widened once, twice or three times by a quarter of its area's
    root (1 to 3). Then comes the 90 % percentile of all points up to 1 beside its bounds, weighted by nearness (4), and at
    last that of the whole building (5); a building without points gives null. All passes are made of one join.
    """
    c = F.col
    low, high = (lambda v: F.array_min(c(ring)[v])), (lambda v: F.array_max(c(ring)[v]))
    b = boxes.select(building, key, c(ring).alias("ring"), (F.abs(area2(c(ring))) / 2).alias("area"), low("x").alias("lx"), low("y").alias("ly"), high("x").alias("hx"), high("y").alias("hy"), centroid(c(ring)).alias("mid"))
    b = b.where("area > 0").withColumn("step", F.sqrt("area") * WIDENING).withColumn("cells", F.when(c("area") > LARGE_AREA, LARGE).otherwise(SMALL))
    b = b.withColumn("far", F.greatest(F.hypot(c("hx") - c("mid.x"), c("hy") - c("mid.y")), F.lit(1e-6)))
    wide = F.greatest(c("step") * WIDENINGS, F.lit(MARGIN)) + 1e-6
    reach = b.select(c(building).alias("own"), key, "ring", "lx", "ly", "hx", "hy", "mid", "step", "cells", "far", (c("lx") - wide).alias("x0"), (c("ly") - wide).alias("y0"), (c("hx") + wide).alias("x1"), (c("hy") + wide).alias("y1"))
    met = points_in_boxes(points.select(building, "x", "y", "z"), reach, bucket, bucket).where(c(building) == c("own")).drop("own")
    gap = F.when(contains_strictly(c("ring"), c("x"), c("y")), F.lit(-1.0)).otherwise(edge_distance(c("ring"), c("x"), c("y")))
    met = met.withColumn("gap", gap).withColumn("level", F.when(c("gap") < 0, 0).otherwise(F.floor(c("gap") / c("step")).cast("int") + 1))

    seen = met.where(c("level") <= WIDENINGS).withColumn("level", F.explode(F.sequence("level", F.lit(WIDENINGS))))
    more = c("level") * c("step")
    side = lambda v: (c(f"h{v}") - c(f"l{v}") + 2 * more) / c("cells")
    at = lambda v: F.floor((c(v) - c(f"l{v}") + more) / side(v))
    seen = seen.withColumns({"i": at("x"), "j": at("y"), "sx": side("x"), "sy": side("y"), "ox": c("lx") - more, "oy": c("ly") - more})
    inside = lambda v, o, k, s: (c(v) > c(o) + c(k) * c(s)) & (c(v) < c(o) + (c(k) + 1) * c(s))
    middle = lambda o, k, s: c(o) + (c(k) + 0.5) * c(s)
    away = F.hypot(middle("ox", "i", "sx") - c("mid.x"), middle("oy", "j", "sy") - c("mid.y"))
    seen = seen.where(inside("x", "ox", "i", "sx") & inside("y", "oy", "j", "sy")).withColumn("w", F.pow(F.greatest(F.lit(0.0), 1 - away / c("far")), F.lit(2.0)))
    tops = seen.groupBy(building, key, "level", (c("i") * c("cells") + c("j")).alias("id")).agg(F.max("z").alias("z"), F.first("w").alias("w"))
    modes = weighted_mode(tops, Z_BIN, (building, key, "level")).groupBy(building, key).agg(F.min_by("z", "level").alias("mode"), F.min("level").alias("level"))

    close = met.where(c("x").between(c("lx") - MARGIN, c("hx") + MARGIN) & c("y").between(c("ly") - MARGIN, c("hy") + MARGIN))
    close = close.withColumn("w", 1 / F.greatest(F.hypot(c("x") - c("mid.x"), c("y") - c("mid.y")), F.lit(1e-3)))
    near = weighted_percentile(close, SHARE, (building, key)).withColumnRenamed("z", "near")
    whole = points.groupBy(building).agg(F.percentile("z", F.lit(SHARE)).alias("whole"))
    out = b.select(building, key).join(modes, [building, key], "left").join(near, [building, key], "left").join(whole, building, "left")
    level = F.coalesce("level", F.when(c("near").isNotNull(), 4), F.when(c("whole").isNotNull(), 5))
    return out.select(building, key, F.coalesce("mode", "near", "whole").alias("z"), level.alias("level"))


def keep_rule(n: Column, coverage: Column, least_points: int = 3, threshold: float = 0.99) -> Column:
    """Whether a box stays: enough points, and enough of it covered (thresholds in use are 0.99, 0.95 and 0.3)."""
    return (n >= least_points) & (coverage >= threshold)
