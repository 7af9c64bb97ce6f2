"""Point rasters and cell statistics: partial aggregation everywhere, no cell is gathered whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import cell


@dataclass(frozen=True)
class TreeFilter:
    """Knobs of the two-pass tree filter."""

    cell_x: float = 0.75
    cell_y: float = 0.75
    z_bin: float = 0.15
    dominance: float = 0.45
    thin: float = 0.30
    delta: float = 0.40
    min_points: int = 30
    left: float = 0.0
    bottom: float = 0.0


def cell_histogram(points: DataFrame, knobs: TreeFilter) -> DataFrame:
    """(ci, cj, zb): count, smallest and largest z of each vertical bin of each cell."""
    keyed = points.select(cell(F.col("x"), knobs.left, knobs.cell_x).alias("ci"), cell(F.col("y"), knobs.bottom, knobs.cell_y).alias("cj"), cell(F.col("z"), 0.0, knobs.z_bin).alias("zb"), "z")
    return keyed.groupBy("ci", "cj", "zb").agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))


def cell_decisions(histogram: DataFrame, knobs: TreeFilter) -> DataFrame:
    """(ci, cj): n, z_range, z_mode (center of the fullest bin, the lowest of equals) and dominance (its share)."""
    rank = F.struct(F.col("n"), -F.col("zb"))
    cells = histogram.groupBy("ci", "cj").agg(F.sum("n").alias("n"), (F.max("zmax") - F.min("zmin")).alias("z_range"), F.max_by("zb", rank).alias("zb"), F.max("n").alias("top"))
    return cells.select("ci", "cj", "n", "z_range", ((F.col("zb") + 0.5) * knobs.z_bin).alias("z_mode"), (F.col("top") / F.greatest("n", F.lit(1))).alias("dominance"))


def tree_filter(points: DataFrame, masked: Column, knobs: TreeFilter) -> DataFrame:
    """All points outside the mask, and those inside that are thin cells' or lie near their cell's mode.

    Statistics come from two grouped passes over the masked points; the decisions join back on the cell, as a
    broadcast only if the planner finds them small.
    """
    mark = points.withColumn("masked__", masked)
    decided = cell_decisions(cell_histogram(mark.where("masked__"), knobs), knobs)
    keyed = mark.withColumn("ci", cell(F.col("x"), knobs.left, knobs.cell_x)).withColumn("cj", cell(F.col("y"), knobs.bottom, knobs.cell_y))
    joined = keyed.join(decided, ["ci", "cj"], "left")
    thin = F.col("z_range") <= knobs.thin
    weak = (F.col("n") < knobs.min_points) | (F.col("dominance") < knobs.dominance)
    keep = ~F.col("masked__") | F.col("n").isNull() | thin | (~weak & (F.abs(F.col("z") - F.col("z_mode")) <= knobs.delta))
    return joined.where(keep).select(*points.columns)


def disk(radius: int, cross: bool = False) -> list[tuple[int, int]]:
    """Offsets of a disk (dr^2 + dc^2 <= r^2) or, with ``cross``, of a diamond (|dr| + |dc| <= r)."""
    span = range(-radius, radius + 1)
    return [(i, j) for i in span for j in span if (abs(i) + abs(j) <= radius if cross else i * i + j * j <= radius * radius)]


def splat(cells: DataFrame, radius: int, cross: bool = False) -> DataFrame:
    """Every row once per offset of the disk around its (row, col)."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in disk(radius, cross)])
    spread = cells.withColumn("o__", F.explode(offsets))
    return spread.withColumn("row", F.col("row") + F.col("o__.i")).withColumn("col", F.col("col") + F.col("o__.j")).drop("o__")


def rasterize(points: DataFrame, row: Column, col: Column, how: str, radius: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, row, col, z): min, max or mean z of each cell; min and max may splat over a disk. Missing row: no data."""
    cells = points.select(*keys, row.alias("row"), col.alias("col"), F.col("z").cast("double").alias("z")).where("z is not null and not isnan(z)")
    if radius and how != "mean":
        cells = splat(cells, radius)
    return cells.groupBy(*keys, "row", "col").agg({"min": F.min, "max": F.max, "mean": F.avg}[how]("z").alias("z"))


def height_above_ground(upper: DataFrame, ground: DataFrame, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """Cells of ``upper`` that stand at least ``threshold`` above the ground's cell; they keep their own z."""
    g = ground.withColumnRenamed("z", "ground")
    return upper.join(g, [*keys, "row", "col"]).withColumn("agl", F.col("z") - F.col("ground")).where(F.col("agl") >= threshold)


def downsample(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(row // height, col // width): min, mean, max and count of z."""
    return cells.groupBy(F.floor(F.col("row") / height).cast("int").alias("br"), F.floor(F.col("col") / width).cast("int").alias("bc")).agg(F.min("z").alias("zmin"), F.avg("z").alias("zmean"), F.max("z").alias("zmax"), F.count("*").alias("n"))


def dilate(cells: DataFrame, radius: int, cross: bool = True) -> DataFrame:
    return splat(cells.select("row", "col"), radius, cross).distinct()


def erode(cells: DataFrame, radius: int, cross: bool = False) -> DataFrame:
    """Cells all of whose offsets are occupied; outside counts as empty."""
    size = len(disk(radius, cross))
    return splat(cells.select("row", "col").distinct(), radius, cross).groupBy("row", "col").agg(F.count("*").alias("n")).where(F.col("n") == size).select("row", "col")


def closing(cells: DataFrame, radius: int, cross: bool = False, shape: tuple[int, int] | None = None) -> DataFrame:
    """Dilation, cut to ``shape`` (rows, columns), then erosion. For small disks; large ones go through the kernels."""
    grown = dilate(cells, radius, cross)
    if shape:
        grown = grown.where(F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1))
    return erode(grown, radius, cross)


def running_average(points: DataFrame, keys: list[str], order: str = "id", value: str = "z") -> DataFrame:
    """The first value, then (old + new) / 2 in order: one fold per group; a group is one cell's points."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(value).alias("v"))))
    fold = F.aggregate(F.slice("r__", F.lit(2), F.greatest(F.size("r__") - 1, F.lit(0))), F.get("r__", F.lit(0))["v"], lambda a, p: (a + p["v"]) / 2)
    return points.groupBy(*keys).agg(rows.alias("r__")).select(*keys, fold.alias(value))


def splat_radius(q75: float, pixel: float, tag: str, factor: float = 0.75, least: int = 2, most: int = 5) -> int:
    """Pixels to splat by for a spacing; only clouds tagged non_ground are splatted."""
    import math

    return min(most, max(least, math.ceil(q75 * factor / pixel))) if "non_ground" in tag else 0


def without_shared(upper: DataFrame, ground: DataFrame, reach: int) -> DataFrame:
    """Cells of ``upper`` that are not within ``reach`` steps of a cell which both tables hold (power lines over ground).

    Expects the ground as measured: one whose gaps are filled would take every cell away.
    """
    both = upper.select("row", "col").join(ground.select("row", "col"), ["row", "col"], "left_semi")
    return upper.join(dilate(both, reach) if reach else both, ["row", "col"], "left_anti")
