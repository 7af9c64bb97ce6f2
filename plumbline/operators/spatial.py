"""Spatial joins turned into equi-joins on grid buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rings import contains_strictly
from plumbline.operators.graph import cut


def _bucket(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _covered(low: Column, high: Column, size: float) -> Column:
    return F.explode(F.sequence(_bucket(low, size), _bucket(high, size)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, bucket_x: float, bucket_y: float, ring: str | None = None) -> DataFrame:
    """Each point with every box that strictly holds it; with ``ring`` the box is a polygon inside its bounds.

    Boxes are exploded over the buckets that they cover, so the join is on equal buckets with the test as residue.
    """
    b = boxes.withColumn("bx", _covered(F.col("x0"), F.col("x1"), bucket_x)).withColumn("by", _covered(F.col("y0"), F.col("y1"), bucket_y))
    p = points.withColumn("bx", _bucket(F.col("x"), bucket_x)).withColumn("by", _bucket(F.col("y"), bucket_y))
    inside = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))
    if ring:
        inside = inside & contains_strictly(F.col(ring), F.col("x"), F.col("y"))
    return p.join(b, ["bx", "by"]).where(inside).drop("bx", "by")


def nearest_neighbours(points: DataFrame, radius: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, d): each point's distance to the nearest other point with the same keys; null if it has none.

    Points meet those in the 3 x 3 buckets around theirs. A distance up to the bucket size is final; points without one go
    on with buckets four times as large, until a bucket is as large as the extent. Two points that go on lie more than a
    quarter of the next size apart, so a bucket holds at most 31 of them and every round's pairs grow with the points only.
    Null, infinite and NaN places meet nothing.
    """
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    points = points.select(*keys, "id", "x", "y")
    placed = cut(points.where(finite("x") & finite("y")))
    extent = placed.agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0] or 0.0
    pending, done, size = placed, None, radius
    while True:
        last = size >= extent
        other = placed.select(*keys, F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), _bucket(F.col("x"), size).alias("bx"), _bucket(F.col("y"), size).alias("by"))
        around = F.sequence(F.lit(-1), F.lit(1))
        left = pending.withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
        left = left.select(*keys, "id", "x", "y", (_bucket(F.col("x"), size) + F.col("i")).alias("bx"), (_bucket(F.col("y"), size) + F.col("j")).alias("by"))
        met = left.join(other, [*keys, "bx", "by"]).where("id <> oid").groupBy(*keys, "id").agg(F.min(F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))).alias("d"))
        final = cut(met if last else met.where(F.col("d") <= size))
        done = final if done is None else done.unionByName(final)
        pending = cut(pending.join(final, [*keys, "id"], "left_anti"))
        if last or pending.isEmpty():
            return points.select(*keys, "id").join(done, [*keys, "id"], "left")
        size *= 4


def spacing(neighbours: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Median, 75 % and 90 % quantile of the positive distances."""
    q = F.percentile("d", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    out = neighbours.where("d > 0").groupBy(*keys).agg(q.alias("q"), F.count("*").alias("n"))
    return out.select(*keys, F.get("q", F.lit(0)).alias("q50"), F.get("q", F.lit(1)).alias("q75"), F.get("q", F.lit(2)).alias("q90"), "n")


def line_support(lines: DataFrame, points: DataFrame, step: float, soft: float, hard: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per line: samples along it, how many have a point within the soft and the hard radius, and the soft share."""
    n = F.greatest(F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / step).cast("int"), F.lit(1))
    s = lines.select(*keys, "line", "x1", "y1", "x2", "y2", n.alias("n")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("k") / F.col("n")
    s = s.select(*keys, "line", "k", (F.col("x1") + (F.col("x2") - F.col("x1")) * t).alias("sx"), (F.col("y1") + (F.col("y2") - F.col("y1")) * t).alias("sy"))
    around = F.sequence(F.lit(-1), F.lit(1))
    near = s.withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    near = near.select(*keys, "line", "k", "sx", "sy", (_bucket(F.col("sx"), hard) + F.col("i")).alias("bx"), (_bucket(F.col("sy"), hard) + F.col("j")).alias("by"))
    p = points.select(*keys, "x", "y", _bucket(F.col("x"), hard).alias("bx"), _bucket(F.col("y"), hard).alias("by"))
    d = near.join(p, [*keys, "bx", "by"]).groupBy(*keys, "line", "k").agg(F.min(F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))).alias("d"))
    hits = d.groupBy(*keys, "line").agg(F.count(F.when(F.col("d") <= soft, 1)).alias("soft"), F.count(F.when(F.col("d") <= hard, 1)).alias("hard"))
    total = s.groupBy(*keys, "line").agg(F.count("*").alias("samples"))
    out = total.join(hits, [*keys, "line"], "left").na.fill(0, ["soft", "hard"])
    return out.withColumn("ratio", F.col("soft") / F.col("samples"))


def adjacency(boxes: DataFrame) -> DataFrame:
    """(box, other): rectangles that share a piece of an edge, not just a corner. Equi-join on the shared coordinate."""
    vertical = boxes.select("box", F.col("x1").alias("at"), F.col("y0").alias("a"), F.col("y1").alias("b")).join(boxes.select(F.col("box").alias("other"), F.col("x0").alias("at"), F.col("y0").alias("c"), F.col("y1").alias("d")), "at")
    flat = boxes.select("box", F.col("y1").alias("at"), F.col("x0").alias("a"), F.col("x1").alias("b")).join(boxes.select(F.col("box").alias("other"), F.col("y0").alias("at"), F.col("x0").alias("c"), F.col("x1").alias("d")), "at")
    both = vertical.unionByName(flat).where((F.least("b", "d") - F.greatest("a", "c")) > 1e-9).select("box", "other")
    return both.union(both.select("other", "box")).distinct()


def rescue(boxes: DataFrame, neighbours: DataFrame, kept: str = "kept") -> DataFrame:
    """``boxes`` with final: kept, or dropped with at least one neighbour and all neighbours kept (one round)."""
    told = neighbours.join(boxes.select(F.col("box").alias("other"), F.col(kept).alias("ok")), "other").groupBy("box").agg(F.bool_and("ok").alias("all_kept"))
    return boxes.join(told, "box", "left").withColumn("final", F.col(kept) | F.coalesce("all_kept", F.lit(False))).drop("all_kept")


def hash_sample(df: DataFrame, keys: list[str], cap: int, by: tuple[str, ...] = ()) -> DataFrame:
    """At most ``cap`` rows per group, those with the smallest md5 of their keys: the same rows wherever it runs."""
    order = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    if not by:
        return df.withColumn("h__", order).orderBy("h__", *keys).limit(cap).drop("h__")
    w = Window.partitionBy(*by).orderBy(order, *keys)
    return df.withColumn("h__", F.row_number().over(w)).where(F.col("h__") <= cap).drop("h__")


def polygon_cells(polygons: DataFrame, ring: str, size_x: float, size_y: float) -> DataFrame:
    """Each polygon once per grid cell whose center lies strictly inside; only cells within its bounds are made."""
    ends = {v: (F.array_min(F.col(ring)[v]), F.array_max(F.col(ring)[v])) for v in "xy"}
    out = polygons.withColumn("col", _covered(*ends["x"], size_x)).withColumn("row", _covered(*ends["y"], size_y))
    out = out.withColumns({v: F.col(v).cast("int") for v in ("row", "col")})
    return out.where(contains_strictly(F.col(ring), (F.col("col") + 0.5) * size_x, (F.col("row") + 0.5) * size_y))
