"""Kernels on DataFrames: one grouped Arrow batch per tile, building or scene."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalar import linear_index
from plumbline.operators import kernels, spatial
from plumbline.operators.cells import height_above_ground
from plumbline.operators.graph import connected, cut


def per_tile(cells: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], tile: int, halo: int = 0, shape: tuple[int, int] | None = None) -> DataFrame:
    """(row, col, z): ``kernel`` on every tile of ``tile`` x ``tile`` cells, NaN where no row is; NaN results are no rows.

    With a halo each tile also sees that many cells around it; only its own cells are returned. Tiles without any cell
    are not visited; ``shape`` cuts the result to (rows, columns).
    """
    reach = -(-halo // tile) if halo else 0
    spread = cells.select("row", "col", F.col("z").cast("double").alias("z"))
    near = F.sequence(F.lit(-reach), F.lit(reach))
    spread = spread.withColumn("i", F.explode(near)).withColumn("j", F.explode(near))
    spread = spread.withColumn("tr", (F.floor(F.col("row") / tile) + F.col("i")).cast("int")).withColumn("tc", (F.floor(F.col("col") / tile) + F.col("j")).cast("int"))
    inside = lambda c, t: (F.col(c) >= F.col(t) * tile - halo) & (F.col(c) < (F.col(t) + 1) * tile + halo)
    spread = spread.where(inside("row", "tr") & inside("col", "tc"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * tile - halo, key[1] * tile - halo
        grid = np.full((tile + 2 * halo, tile + 2 * halo), np.nan)
        grid[pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0] = pdf["z"].to_numpy()
        out = np.asarray(kernel(grid), float)[halo : halo + tile, halo : halo + tile]
        i, j = np.nonzero(np.isfinite(out))
        return pd.DataFrame({"row": (i + key[0] * tile).astype("int32"), "col": (j + key[1] * tile).astype("int32"), "z": out[i, j]})

    out = spread.groupBy("tr", "tc").applyInPandas(run, "row int, col int, z double")
    return out.where(F.col("row").between(0, shape[0] - 1) & F.col("col").between(0, shape[1] - 1)) if shape else out


def closed(cells: DataFrame, radius: int, tile: int, shape: tuple[int, int] | None = None) -> DataFrame:
    """Closing by a disk of any radius; the halo of twice the radius makes it the same however the tiles are cut."""
    kernel = lambda g: np.where(kernels.close(np.isfinite(g), radius), 1.0, np.nan)
    spread = per_tile(cells.select("row", "col", F.lit(1.0).alias("z")), kernel, tile, 2 * radius, shape)
    return spread.select("row", "col")


def filled(cells: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """(row, col, z): all cells of a raster of ``shape``, those without a value with that of the nearest valid cell.

    Exact for the whole raster (Euclidean): the nearest cell in each row, then over the rows of each column. A batch is
    one row or one column. No valid cell, no rows.
    """
    height, width = shape
    valid = cells.select("row", "col", F.col("z").cast("double").alias("z")).where("z is not null and not isnan(z) and abs(z) < double('inf')")
    valid = valid.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))

    def across(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("col")
        cols, z = pdf["col"].to_numpy(np.int64), pdf["z"].to_numpy()
        near = kernels.nearest_in_row(cols, width)
        return pd.DataFrame({"row": np.int32(key[0]), "col": np.arange(width, dtype="int32"), "away": np.abs(cols[near] - np.arange(width)), "z": z[near]})

    def down(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        d2, z, rows = np.full(height, np.inf), np.full(height, np.nan), pdf["row"].to_numpy()
        d2[rows], z[rows] = pdf["away"].to_numpy(float) ** 2, pdf["z"].to_numpy()
        return pd.DataFrame({"row": np.arange(height, dtype="int32"), "col": np.int32(key[0]), "z": z[kernels.nearest_over_rows(d2)]})

    rows = valid.groupBy("row").applyInPandas(across, "row int, col int, away long, z double")
    return rows.groupBy("col").applyInPandas(down, "row int, col int, z double")


def height_above_filled(upper: DataFrame, ground: DataFrame, threshold: float, shape: tuple[int, int], zero_is_nodata: bool = False) -> DataFrame:
    """Cells of ``upper`` that stand at least ``threshold`` above the ground, whose gaps are first filled with the nearest valid
    cell; with ``zero_is_nodata`` a z of 0 is a gap as well."""
    valid = (lambda df: df.where("z <> 0")) if zero_is_nodata else (lambda df: df)
    return height_above_ground(valid(upper), filled(valid(ground), shape), threshold)


def components(cells: DataFrame, width: int, tile: int) -> DataFrame:
    """(row, col, component): 8-connected components over all tiles, named by their smallest row * width + col.

    Tiles are labelled by themselves; only pairs of touching border cells make links between labels, whose components
    are found by joins.
    """
    tagged = cells.select("row", "col").distinct().withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        grid = np.zeros((tile, tile), bool)
        i, j = r - int(key[0]) * tile, c - int(key[1]) * tile
        grid[i, j] = True
        names, lin = kernels.label(grid)[i, j], r.astype(np.int64) * width + c
        low = pd.Series(lin).groupby(names).min()
        return pd.DataFrame({"row": r, "col": c, "local": low.loc[names].to_numpy()})

    named = cut(tagged.groupBy("tr", "tc").applyInPandas(run, "row int, col int, local long"))
    edge = lambda v: (F.col(v) % tile == 0) | (F.col(v) % tile == tile - 1)
    border = named.where(edge("row") | edge("col"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    around = border.withColumn("s", F.explode(steps)).select((F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), F.col("local").alias("a"))
    links = around.join(border, ["row", "col"]).where("a <> local").select("a", F.col("local").alias("b"))
    roots = connected(links).withColumnRenamed("vertex", "local")
    return named.join(roots, "local", "left").select("row", "col", F.coalesce("component", "local").alias("component"))


def hulls(points: DataFrame, key: str, factor: float = 1.1) -> DataFrame:
    """(key, ring): the convex hull of each group scaled about its middle. Points are first thinned to the extremes of
    each column and row, which hold the hull, so a group's batch is bounded by its extent."""
    grid = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    thin = grid.groupBy(key, "x").agg(F.min("y").alias("a"), F.max("y").alias("b"))
    thin = thin.select(key, "x", F.explode(F.array_distinct(F.array("a", "b"))).alias("y"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = kernels.expand(kernels.convex_hull(pdf[["x", "y"]].to_numpy()), factor)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "ring": [[{"x": float(x), "y": float(y)} for x, y in ring]]})

    kind = points.schema[key].dataType.simpleString()
    return thin.groupBy(key).applyInPandas(run, f"{key} {kind}, ring array<struct<x:double,y:double>>")


def oriented_lines(lines: DataFrame, key: str, pixel: float = 1.0, bandwidth: float = 5.0, peak_m: float = 0.3, near: float = 25.0, gap_m: float = 0.5) -> DataFrame:
    """(key, line, angle): lines left per building after clustering of angles, snapping, merging and suppression.

    Expects key, line, x1, y1, x2, y2 and weight. A building's lines come from a detector's top list and are few.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy, w = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["weight"].to_numpy(float)
        length = np.hypot(xy[:, 2] - xy[:, 0], xy[:, 3] - xy[:, 1])
        bins = np.floor(np.degrees(np.arctan2(xy[:, 3] - xy[:, 1], xy[:, 2] - xy[:, 0])) % 180).astype(int) % 180
        totals = np.bincount(bins, length * w, 180)
        some = np.flatnonzero(totals)
        names = np.full(180, -1)
        names[some] = kernels.mean_shift_1d(some.astype(float), totals[some], bandwidth)
        groups = [g for g in range(names.max() + 1) if totals[names == g].max() > peak_m / pixel]
        peaks = [int(np.argmax(np.where(names == g, totals, -1))) for g in groups]
        peaks = kernels.snap_orthogonal(peaks, totals)
        d = lambda a, b: min(abs(a - b) % 180, 180 - abs(a - b) % 180)
        gone = {j for i in range(len(peaks)) for j in range(len(peaks)) if i != j and d(peaks[i], peaks[j]) < near and (totals[peaks[i]], -i) > (totals[peaks[j]], -j)}
        out = []
        for g, peak in ((g, p) for k, (g, p) in enumerate(zip(groups, peaks)) if k not in gone):
            own = np.flatnonzero(names[bins] == g)
            out += [(own[i], float(peak)) for i in kernels.suppress_parallel(xy[own], length[own] * w[own], peak, gap_m / pixel)]
        return pd.DataFrame({key: pdf[key].iloc[0], "line": [pdf["line"].iloc[i] for i, _ in out], "angle": [a for _, a in out]}).astype({key: pdf[key].dtype, "angle": float})

    kind, line = lines.schema[key].dataType.simpleString(), lines.schema["line"].dataType.simpleString()
    return lines.groupBy(key).applyInPandas(run, f"{key} {kind}, line {line}, angle double")


def seeded_cells(points: DataFrame, row: Column, col: Column, width: int) -> DataFrame:
    """Distinct (row, col, lin) of points."""
    return points.select(row.alias("row"), col.alias("col")).distinct().withColumn("lin", linear_index(F.col("row"), F.col("col"), width))


def seams(cells: DataFrame, part_rows: int, part_cols: int, band: int = 32, radius: int = 16) -> tuple[DataFrame, DataFrame]:
    """Components of neighbouring parts that belong together: (a, b) pairs, and the (row, col, a) bridge cells.

    Expects (row, col, component). At each border of two parts the cells within ``band`` of it are closed by a disk;
    the components that one closed patch joins across the border are paired. Bridge cells are those that only the
    closing fills, in a patch that joins components, named by the smallest of these; other patches have none.
    """
    size, both = {"row": part_rows, "col": part_cols}, []
    for axis, cross in (("row", "col"), ("col", "row")):
        n = size[axis]
        at = F.floor((F.col(axis) + band) / n)
        near = cells.where((F.pmod(F.col(axis) + band, F.lit(n)) < 2 * band) & (at > 0))
        both.append(near.select(F.lit(axis).alias("axis"), at.cast("int").alias("border"), F.floor(F.col(cross) / size[cross]).cast("int").alias("lane"), "row", "col", F.col("component").cast("long").alias("component")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        axis, border, lane = key[0], int(key[1]), int(key[2])
        other = "col" if axis == "row" else "row"
        d0, c0 = border * size[axis] - band, lane * size[other]
        names, codes = np.unique(pdf["component"].to_numpy(), return_inverse=True)
        grid = np.zeros((size[other], 2 * band), np.int64)
        grid[pdf[other].to_numpy() - c0, pdf[axis].to_numpy() - d0] = codes + 1
        pairs, bridge = kernels.seam_pairs(grid[:, :band], grid[:, band:], radius)
        out = [(int(names[i - 1]), int(names[j - 1]), None, None) for i, j in sorted(pairs)]
        for i, j in zip(*np.nonzero(bridge)):
            d, c = int(j) + d0, int(i) + c0
            out.append((int(names[bridge[i, j] - 1]), None, d if axis == "row" else c, c if axis == "row" else d))
        return pd.DataFrame(out, columns=["a", "b", "row", "col"]).astype({"a": "int64", "b": "Int64", "row": "Int32", "col": "Int32"})

    found = cut(both[0].union(both[1]).groupBy("axis", "border", "lane").applyInPandas(run, "a long, b long, row int, col int"))
    return found.where("b is not null").select("a", "b").where("a <> b").distinct(), found.where("b is null").select("row", "col", "a").distinct()


def seam_clusters(cells: DataFrame, pairs: DataFrame, bridge: DataFrame) -> DataFrame:
    """(row, col, cluster): the cells (row, col, component) and bridge cells of all components that seams join.

    A cluster is named by its smallest component. Components without a pair are clusters by themselves.
    """
    roots = connected(pairs).select(F.col("vertex").alias("component"), F.col("component").alias("root"))
    both = cells.select("row", "col", F.col("component").cast("long").alias("component")).union(bridge.select("row", "col", F.col("a").alias("component")))
    return both.join(roots, "component", "left").select("row", "col", F.coalesce("root", "component").alias("cluster")).distinct()


def ground(cells: DataFrame, tile: int, shape: tuple[int, int], rounds: int = 500, rigidness: int = 3, **knobs: float) -> DataFrame:
    """(row, col, z): the cloth filter's ground surface on a raster of ``shape``, the same however the tiles are cut.

    Gaps are filled before over the whole raster; the halo is as wide as a pull gets in all rounds, the cloth starts at
    one height everywhere and no tile stops before it lies still.
    """
    whole = cut(filled(cells, shape))
    low = whole.agg(F.min("z")).first()[0]

    def kernel(grid: np.ndarray) -> np.ndarray:
        i, j = np.nonzero(np.isfinite(grid))
        part = slice(i.min(), i.max() + 1), slice(j.min(), j.max() + 1)
        grid[part] = kernels.ground_filter(grid[part], rigidness=rigidness, rounds=rounds, top=-low, settled=0.0, **knobs)
        return grid

    return per_tile(whole, kernel, tile, rounds * rigidness, shape)


def faces(lines: DataFrame, key: str) -> DataFrame:
    """(key, face, ring): bounded faces between the lines (x1, y1, x2, y2) of each building, which are few."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = kernels.polygonize(pdf[["x1", "y1", "x2", "y2"]].to_numpy(float))
        rings = sorted(rings, key=lambda r: min(r))
        return pd.DataFrame({key: pd.Series([pdf[key].iloc[0]] * len(rings), dtype=pdf[key].dtype), "face": np.arange(len(rings), dtype="int32"), "ring": [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]})

    return lines.groupBy(key).applyInPandas(run, f"{key} {lines.schema[key].dataType.simpleString()}, face int, ring array<struct<x:double,y:double>>")


def dissolved(boxes: DataFrame, key: str) -> DataFrame:
    """(key, ring): outlines of the union of each group's rectangles, which share whole edges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = kernels.dissolve([[(a, b), (c, b), (c, d), (a, d)] for a, b, c, d in pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False)])
        return pd.DataFrame({key: pd.Series([pdf[key].iloc[0]] * len(rings), dtype=pdf[key].dtype), "ring": [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]})

    return boxes.groupBy(key).applyInPandas(run, f"{key} {boxes.schema[key].dataType.simpleString()}, ring array<struct<x:double,y:double>>")


#: Points that an alpha shape is made of at most; more are thinned to one per cell of a grid of at most that many cells.
MOST_ALPHA = 2000


def alpha_coverage(inside: DataFrame, key: str = "box", shares: tuple[float, ...] = (), penalty: float = 0.015, largest: float = 0.05, radius: float = 2.0, alpha: float | None = None) -> DataFrame:
    """(key, n, coverage, alpha): area of the alpha shape of a box's points over the box's area.

    Expects x, y and x0, y0, x1, y1; n counts all points, the shape is made of the distinct ones. Alpha is
    1 / (2 * median distance to the nearest other point of the box); where the shape has less than 5 % of the box, the
    hull widened by at least 0.75 stands for it as far as it is in the box. With ``shares`` every quantile of those
    distances is tried: an area loses the share ``penalty`` for each further polygon and gains the share ``largest`` of
    its largest one, and the best wins; without any area the hull stands for it, with alpha 0. A given ``alpha`` is taken as
    it is, and nothing stands for its shape.

    Distances are found on all points (``radius`` is where their search begins). Only boxes of more than MOST_ALPHA points
    are thinned, to one per cell, so a group's batch is bounded.
    """
    side, c = int(MOST_ALPHA**0.5), F.col
    box = ("x0", "y0", "x1", "y1")
    alike = cut(inside.groupBy(key, "x", "y").agg(F.count("*").alias("n"), *[F.first(v).alias(v) for v in box]).withColumn("id", F.monotonically_increasing_id()))
    cell = [F.least(F.floor((c(v) - c(f"{v}0")) / (c(f"{v}1") - c(f"{v}0")) * side), F.lit(side - 1)).alias(f"c{v}") for v in "xy"]
    near = spatial.nearest_neighbours(alike, radius, (key,)).where("d > 0").groupBy(key).agg(F.percentile("d", F.array(*map(F.lit, shares or (0.5,)))).alias("near"))
    sizes = alike.groupBy(key).agg(F.count("*").alias("many"), F.sum("n").alias("n"), *[F.var_samp(v).alias(f"v{v}") for v in "xy"], F.covar_samp("x", "y").alias("vxy")).join(near, key, "left")
    told = alike.drop("n").join(sizes.select(key, "many"), key)
    few = told.where(c("many") <= MOST_ALPHA).select(key, "x", "y", *box)
    more = told.where(c("many") > MOST_ALPHA).select(key, "x", "y", *box, *cell).groupBy(key, "cx", "cy").agg(F.min(F.struct("x", "y", *box)).alias("p")).select(key, "p.*")
    points = few.union(more).join(sizes.drop("many"), key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, first = pdf[["x", "y"]].to_numpy(float), pdf.iloc[0]
        bounds = tuple(float(first[v]) for v in box)
        whole = (bounds[2] - bounds[0]) * (bounds[3] - bounds[1])
        area, used = 0.0, 0.0
        if alpha is not None:
            area, used = (kernels.alpha_areas(p, [alpha])[0] if len(p) > 2 else 0.0), alpha
        elif whole > 0 and len(p) > (2 if shares else 3) and first["near"] is not None:
            if shares:
                tries = sorted({round(1 / (2 * float(d)), 8) for d in first["near"]}, reverse=True)
                found = [(sum(a) - penalty * sum(a) * (len(a) - 1) + largest * max(a), -k, sum(a), tries[k]) for k, a in enumerate(kernels.alpha_polygons(p, tries)) if a]
                _, _, area, used = max(found) if found else (0.0, 0, kernels.buffered_in_box(kernels.convex_hull(p), 0.0, bounds), 0.0)
            else:
                middle = float(first["near"][0])
                used = 1 / (2 * middle)
                area = kernels.alpha_areas(p, [used])[0]
                if area / whole < 0.05:
                    half = (first["vx"] - first["vy"]) / 2
                    minor = max((first["vx"] + first["vy"]) / 2 - float(np.hypot(half, first["vxy"])), 0.0) ** 0.5
                    area = kernels.buffered_in_box(kernels.convex_hull(p), max(0.75, 3 * minor, 0.5 * middle), bounds)
        return pd.DataFrame({key: [first[key]], "n": [int(first["n"])], "coverage": [area / whole if whole > 0 else 0.0], "alpha": [used]}).astype({key: pdf[key].dtype})

    return points.groupBy(key).applyInPandas(run, f"{key} {inside.schema[key].dataType.simpleString()}, n long, coverage double, alpha double")


def pruned(boxes: DataFrame, scene: str, threshold: float = 0.0008, least: float = 0.5) -> DataFrame:
    """(scene, box): boxes left after greedy removal. Expects scene, box, n (its points) and coverage."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("box")
        kept = kernels.prune_boxes([range(n) for n in pdf["n"]], pdf["coverage"].tolist(), threshold=threshold, least=least)
        return pdf.iloc[kept][[scene, "box"]]

    return boxes.groupBy(scene).applyInPandas(run, f"{scene} {boxes.schema[scene].dataType.simpleString()}, box {boxes.schema['box'].dataType.simpleString()}")


def core(cells: DataFrame, radius: int, least: int, tile: int) -> DataFrame:
    """(row, col) of occupied cells with at least ``least`` occupied ones, themselves included, within a disk."""

    def kernel(grid: np.ndarray) -> np.ndarray:
        mask = np.isfinite(grid)
        return np.where(mask & (kernels.disk_count(mask, radius) >= least), 1.0, np.nan)

    return per_tile(cells, kernel, tile, radius).select("row", "col")
