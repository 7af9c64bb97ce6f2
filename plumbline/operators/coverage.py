"""How much of a box its points cover: occupied cells grown by a disk, and an alpha shape near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators import spatial, tiles
from plumbline.operators.graph import cut

#: Cell size, most cells of a box, least radius, its share of the spacing and of the spread, most cells of it.
CELL, MOST_CELLS, LEAST_RADIUS, BY_SPACING, BY_SPREAD, MOST_RADIUS = 12.0, 16000, 0.75, 0.60, 1.25, 6
#: Points below which nothing counts, tolerance at an edge, decimals that tell points apart.
LEAST_POINTS, EDGE, DECIMALS = 3, 0.25, 2


def apart(inside: DataFrame, key: str = "box") -> DataFrame:
    """(key, x, y, x0, y0, x1, y1, n): points that differ at two decimals, the smallest of equal ones, and how many they are."""
    grain = [F.floor(F.col(v) * 10**DECIMALS + 0.5).alias(f"g{v}") for v in "xy"]
    box = ("x0", "y0", "x1", "y1")
    one = inside.groupBy(key, *grain).agg(F.min(F.struct("x", "y", *box)).alias("p"), F.count("*").alias("n"))
    return one.select(key, "p.*", "n")


def spread(alike: DataFrame, key: str = "box", radius: float = 2.0) -> DataFrame:
    """(key, n, spacing, minor): all points, the median distance to the nearest other one and the spread along the minor
    axis; both 0 for fewer than three different points. Expects the rows of ``apart``."""
    told = alike.withColumn("id", F.monotonically_increasing_id())
    told = cut(told)
    near = spatial.nearest_neighbours(told, radius, (key,)).groupBy(key).agg(F.percentile("d", F.lit(0.5)).alias("spacing"))
    facts = told.groupBy(key).agg(F.sum("n").alias("n"), F.count("*").alias("many"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"))
    half = (F.col("vx") - F.col("vy")) / 2
    minor = F.sqrt(F.greatest((F.col("vx") + F.col("vy")) / 2 - F.sqrt(half * half + F.col("vxy") * F.col("vxy")), F.lit(0.0)))
    enough = F.col("many") >= 3
    return facts.join(near, key, "left").select(key, "n", F.when(enough, F.col("spacing")).otherwise(0.0).alias("spacing"), F.when(enough, minor).otherwise(0.0).alias("minor"))


def grid_coverage(boxes: DataFrame, inside: DataFrame, key: str = "box", cell: float = CELL, radius: float = 2.0) -> DataFrame:
    """(key, n, raw, coverage, gain, edge, spacing, minor) of every box (key, x0, y0, x1, y1).

    raw is the share of cells whose middle is in the box that hold a point, coverage the same after the occupied cells grew
    by a disk as wide as spacing and spread ask for, gain the difference; edge is the share of points near the boundary.
    Boxes of more than MOST_CELLS cells have wider ones. Fewer than LEAST_POINTS points, or a box without area: all 0 but n.
    ``inside`` are points with the box that holds them, as ``spatial.points_in_boxes`` gives them.
    """
    c = F.col
    facts = spread(apart(inside, key), key, radius)
    wide, high = c("x1") - c("x0"), c("y1") - c("y0")
    count = lambda v, size: F.greatest(F.lit(1), F.ceil(v / size)).cast("long")
    b = boxes.select(key, "x0", "y0", "x1", "y1").join(facts, key, "left").na.fill({"n": 0, "spacing": 0.0, "minor": 0.0})
    many = count(wide, F.lit(cell)) * count(high, F.lit(cell))
    b = b.withColumn("cell", F.when(many > MOST_CELLS, cell * F.sqrt(many / MOST_CELLS)).otherwise(F.lit(cell)))
    grown = F.greatest(F.lit(LEAST_RADIUS), BY_SPACING * c("spacing"), BY_SPREAD * c("minor"))
    b = b.withColumns({"nx": count(wide, c("cell")), "ny": count(high, c("cell")), "r": F.least(F.lit(MOST_RADIUS), F.ceil(grown / c("cell"))).cast("int")})
    middles = lambda v, n: F.greatest(F.lit(0), F.least(c(n), F.floor((v + EDGE) / c("cell") - 0.5) + 1))
    b = b.withColumns({"kx": middles(wide, "nx"), "ky": middles(high, "ny")})
    sound = (c("n") >= LEAST_POINTS) & (wide > 0) & (high > 0) & (c("kx") > 0) & (c("ky") > 0)
    b = cut(b.withColumn("sound", sound))

    p = inside.select(key, "x", "y").join(b.where("sound"), key)
    at = lambda v, n: F.least(c(n) - 1, F.floor((c(v) - c(f"{v}0")) / c("cell"))).cast("int")
    off = F.least(c("x") - c("x0"), c("x1") - c("x"), c("y") - c("y0"), c("y1") - c("y"))
    occupied = p.groupBy(key, at("x", "nx").alias("i"), at("y", "ny").alias("j"), "r", "kx", "ky").agg(F.count("*").alias("points"), F.count(F.when(off <= F.greatest(F.lit(2.0), 0.5 * c("cell")), 1)).alias("edge"))
    occupied = cut(occupied)
    within = (c("i") < c("kx")) & (c("j") < c("ky"))
    raw = occupied.groupBy(key).agg(F.count(F.when(within, 1)).alias("raw"), (F.sum("edge") / F.sum("points")).alias("edge"))
    reach = F.sequence(-c("r"), c("r"))
    disk = occupied.withColumn("di", F.explode(reach)).withColumn("dj", F.explode(reach)).where("di * di + dj * dj <= r * r")
    disk = disk.select(key, (c("i") + c("di")).alias("i"), (c("j") + c("dj")).alias("j"), "kx", "ky").where("i >= 0 and j >= 0").where(within)
    full = disk.select(key, "i", "j").distinct().groupBy(key).agg(F.count("*").alias("full"))
    out = b.join(raw, key, "left").join(full, key, "left")
    share = lambda n: F.when(c("sound"), F.coalesce(n, F.lit(0)) / (c("kx") * c("ky"))).otherwise(0.0)
    nought = lambda v: F.when(c("sound"), c(v)).otherwise(0.0).alias(v)
    out = out.withColumns({"raw": share("raw"), "coverage": share("full")})
    return out.select(key, "n", "raw", "coverage", (c("coverage") - c("raw")).alias("gain"), F.coalesce("edge", F.lit(0.0)).alias("edge"), nought("spacing"), nought("minor"))


def box_coverage(boxes: DataFrame, inside: DataFrame, key: str = "box", threshold: float = 0.99, band: float = 0.10, cell: float = CELL, radius: float = 2.0) -> DataFrame:
    """(key, n, coverage, refined): grid coverage and, where it lies within ``band`` of the threshold, the larger of it and the
    share of the box that an alpha shape (or the widened hull) of its points has; from 0 to 1."""
    told = cut(grid_coverage(boxes, inside, key, cell, radius))
    refined = (F.col("n") >= LEAST_POINTS) & (F.abs(F.col("coverage") - threshold) < band)
    told = told.withColumn("refined", refined).select(key, "n", "coverage", "refined")
    asked = apart(inside.join(told.where("refined").select(key), key, "left_semi"), key).drop("n")
    shape = tiles.alpha_coverage(asked, key, radius=radius).select(key, F.col("coverage").alias("shape"))
    best = F.when(F.col("refined"), F.greatest("coverage", "shape")).otherwise(F.col("coverage"))
    return told.join(shape, key, "left").select(key, "n", F.least(F.lit(1.0), F.greatest(F.lit(0.0), best)).alias("coverage"), "refined")
