"""Registered queries over the fixture views, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import rings, scalar
from plumbline.operators import cells, detect, heights, ordered, solids, spatial, tiles
from plumbline.sources import files
from plumbline.plans.fixtures import BOXES_SQL, DETECTIONS_SQL, LINES_SQL, POINTS_SQL, boxes, detections, last, lines, points, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The tree filter's knobs on the scale of the fixtures.
KNOBS = cells.TreeFilter(cell_x=25.0, cell_y=48.0, z_bin=15.0, dominance=0.45, thin=0.30, delta=40.0, min_points=30)
GROUND, MASK = ("signup", "click"), ("error", "view")
HIST_SQL = f"{POINTS_SQL}, hist AS (SELECT CAST(floor(x / 25.0) AS INT) AS ci, CAST(floor(y / 48.0) AS INT) AS cj, CAST(floor(z / 15.0) AS INT) AS zb, count(*) AS n, min(z) AS zmin, max(z) AS zmax FROM points WHERE cls IN ('error', 'view') GROUP BY 1, 2, 3)"
CELLS_SQL = f"{HIST_SQL}, cells AS (SELECT ci, cj, CAST(sum(n) AS BIGINT) AS n, max(zmax) - min(zmin) AS z_range, (arg_max(zb, n * 100000 - zb) + 0.5) * 15.0 AS z_mode, max(n) / sum(n) AS dominance FROM hist GROUP BY ci, cj)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


def ground(spark, d):
    return points(spark, d).where(F.col("cls").isin(*GROUND))


def upper(spark, d):
    return points(spark, d).where(~F.col("cls").isin(*GROUND))


def pixel():
    return F.floor(F.col("y") / 24).cast("int"), F.floor(F.col("x") / 5).cast("int")


def extent(spark, d) -> tuple[int, int]:
    """Rows and columns of the raster that holds the whole table; it has 30 x 30 cells at least. Both count from 0."""
    x, y = last(spark, d)
    return max(30, int(y // 24) + 1), max(30, int(x // 5) + 1)


# --- cells and rasters ------------------------------------------------------------------------------------------------


@query(f"WITH {CELLS_SQL} SELECT p.id, round(p.x, 6) AS x, round(p.y, 6) AS y, p.z, p.cls FROM points p LEFT JOIN cells c ON c.ci = CAST(floor(p.x / 25.0) AS INT) AND c.cj = CAST(floor(p.y / 48.0) AS INT) WHERE p.cls NOT IN ('error', 'view') OR c.n IS NULL OR z_range <= 0.30 OR (NOT (n < 30 OR dominance < 0.45) AND abs(p.z - z_mode) <= 40.0)")
def f04_tree_filter(spark: SparkSession, d: str) -> DataFrame:
    out = cells.tree_filter(points(spark, d), F.col("cls").isin(*MASK), KNOBS)
    return out.select("id", r6("x"), r6("y"), "z", "cls")


@query(f"WITH {HIST_SQL} SELECT * FROM hist")
def a03_cell_hist(spark, d):
    return cells.cell_histogram(points(spark, d).where(F.col("cls").isin(*MASK)), KNOBS)


@query(f"WITH {CELLS_SQL} SELECT ci, cj, n, round(z_range, 6) AS z_range, CAST(z_mode AS DOUBLE) AS z_mode, round(dominance, 6) AS dominance FROM cells")
def a04_cell_mode(spark, d):
    out = cells.cell_decisions(cells.cell_histogram(points(spark, d).where(F.col("cls").isin(*MASK)), KNOBS), KNOBS)
    return out.select("ci", "cj", "n", r6("z_range"), r6("z_mode"), r6("dominance"))


_GRID = "CAST(floor(y / 24) AS INT) AS row, CAST(floor(x / 5) AS INT) AS col"


@query(f"WITH {POINTS_SQL} SELECT {_GRID}, max(z) AS z FROM points WHERE cls NOT IN ('signup', 'click') GROUP BY 1, 2")
def a01_raster_max(spark, d):
    return cells.rasterize(upper(spark, d), *pixel(), "max")


@query(f"WITH {POINTS_SQL} SELECT {_GRID}, min(z) AS z FROM points WHERE cls IN ('signup', 'click') GROUP BY 1, 2")
def a01_raster_min(spark, d):
    return cells.rasterize(ground(spark, d), *pixel(), "min")


@query(f"WITH {POINTS_SQL} SELECT {_GRID}, round(avg(z), 6) AS z FROM points GROUP BY 1, 2")
def a01_raster_mean(spark, d):
    return cells.rasterize(points(spark, d), *pixel(), "mean").select("row", "col", r6("z"))


@query(f"WITH {POINTS_SQL}, o AS (SELECT i, j FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE i * i + j * j <= 4) SELECT CAST(floor(y / 24) + i AS INT) AS row, CAST(floor(x / 5) + j AS INT) AS col, max(z) AS z FROM points, o WHERE cls NOT IN ('signup', 'click') GROUP BY 1, 2")
def a01_raster_splat(spark, d):
    return cells.rasterize(upper(spark, d), *pixel(), "max", radius=2)


@query(f"WITH {POINTS_SQL}, g AS (SELECT {_GRID}, min(z) AS z FROM points WHERE cls IN ('signup', 'click') GROUP BY 1, 2), u AS (SELECT {_GRID}, max(z) AS z FROM points WHERE cls NOT IN ('signup', 'click') GROUP BY 1, 2) SELECT row, col, u.z AS z, round(u.z - g.z, 6) AS agl FROM u JOIN g USING (row, col) WHERE u.z - g.z >= 10.0")
def j01_agl(spark, d):
    out = cells.height_above_ground(cells.rasterize(upper(spark, d), *pixel(), "max"), cells.rasterize(ground(spark, d), *pixel(), "min"), 10.0)
    return out.select("row", "col", "z", r6("agl"))


@query(f"WITH {POINTS_SQL}, g AS (SELECT {_GRID}, list(z ORDER BY id) AS zs FROM points GROUP BY 1, 2) SELECT row, col, list_reduce(zs, lambda a, z: (a + z) / 2) AS z FROM g")
def a02_running_average(spark, d):
    row, col = pixel()
    return cells.running_average(points(spark, d).withColumn("row", row).withColumn("col", col), ["row", "col"])


@query(f"WITH {POINTS_SQL}, c AS (SELECT {_GRID}, max(z) AS z FROM points GROUP BY 1, 2) SELECT CAST(floor(row / 4) AS INT) AS br, CAST(floor(col / 4) AS INT) AS bc, min(z) AS zmin, round(avg(z), 6) AS zmean, max(z) AS zmax, count(*) AS n FROM c GROUP BY 1, 2")
def a22_downsample(spark, d):
    return cells.downsample(cells.rasterize(points(spark, d), *pixel(), "max"), 4, 4).select("br", "bc", "zmin", r6("zmean"), "zmax", "n")


@query(f"WITH {POINTS_SQL}, c AS (SELECT DISTINCT {_GRID} FROM points WHERE cls = 'error') SELECT round(count(*) / 900.0, 6) AS valid_ratio, count(DISTINCT row) AS n_rows, count(DISTINCT col) AS n_cols FROM c")
def a21_valid_ratio(spark, d):
    c = cells.rasterize(points(spark, d).where("cls = 'error'"), *pixel(), "max")
    rows, cols = extent(spark, d)
    return c.agg(F.round(F.count("*") / float(rows * cols), 6).alias("valid_ratio"), F.count_distinct("row").alias("n_rows"), F.count_distinct("col").alias("n_cols"))


@query(f"WITH {POINTS_SQL}, c AS (SELECT DISTINCT {_GRID} FROM points WHERE cls = 'error' AND z > 300) SELECT DISTINCT CAST(row + i AS INT) AS row, CAST(col + j AS INT) AS col FROM c, range(-3, 4) a(i), range(-3, 4) b(j) WHERE abs(i) + abs(j) <= 3")
def m05_dilate(spark, d):
    return cells.dilate(cells.rasterize(points(spark, d).where("cls = 'error' and z > 300"), *pixel(), "max"), 3)


@query(f"WITH {POINTS_SQL}, o AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j) WHERE i * i + j * j <= 1), c AS (SELECT DISTINCT {_GRID} FROM points WHERE cls = 'error'), g AS (SELECT DISTINCT row + i AS row, col + j AS col FROM c, o WHERE row + i BETWEEN 0 AND 29 AND col + j BETWEEN 0 AND 29) SELECT CAST(g.row - i AS INT) AS row, CAST(g.col - j AS INT) AS col FROM g, o GROUP BY 1, 2 HAVING count(*) = 5")
def m03_closing(spark, d):
    return cells.closing(cells.rasterize(points(spark, d).where("cls = 'error'"), *pixel(), "max"), 1, shape=extent(spark, d))


@query(f"WITH {POINTS_SQL} SELECT part, count(*) AS n, round(min(z), 6) AS zmin, round(max(z), 6) AS zmax FROM (SELECT *, CAST(3 * floor(y / 240) + floor(x / 50) + 1 AS INT) AS part FROM points WHERE x >= 0 AND x < 150 AND y >= 0 AND y < 720) GROUP BY part")
def m01_tile_cut(spark, d):
    across = -(-extent(spark, d)[1] // 10)
    part = (across * F.floor(F.col("y") / 240) + F.floor(F.col("x") / 50) + 1).cast("int").alias("part")
    return points(spark, d).where("x >= 0 and y >= 0").groupBy(part).agg(F.count("*").alias("n"), F.round(F.min("z"), 6).alias("zmin"), F.round(F.max("z"), 6).alias("zmax"))


@query("SELECT CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(least(512, 1700 - x) AS INT) AS w, CAST(least(512, 1300 - y) AS INT) AS h, 'tile_' || x || '_' || y || '.png' AS name FROM range(0, 1700, 512) a(x), range(0, 1300, 512) b(y)")
def s11_tiles(spark, d):
    x, y = F.col("x"), F.col("y")
    t = spark.range(1).select(F.explode(F.sequence(F.lit(0), F.lit(1699), F.lit(512))).alias("x")).select("x", F.explode(F.sequence(F.lit(0), F.lit(1299), F.lit(512))).alias("y"))
    return t.select("x", "y", F.least(F.lit(512), 1700 - x).alias("w"), F.least(F.lit(512), 1300 - y).alias("h"), F.concat(F.lit("tile_"), x.cast("string"), F.lit("_"), y.cast("string"), F.lit(".png")).alias("name"))


# --- joins ------------------------------------------------------------------------------------------------------------

_PIX = "CAST(floor(y / 24) AS BIGINT) * 30 + CAST(floor(x / 5) AS BIGINT)"


@query(f"WITH {POINTS_SQL}, b AS (SELECT DISTINCT {_PIX} AS lin FROM points WHERE cls = 'purchase') SELECT id, round(x, 6) AS x, round(y, 6) AS y, z FROM points WHERE cls <> 'purchase' AND {_PIX} IN (SELECT lin FROM b)")
def j04_semi_pixels(spark, d):
    row, col = pixel()
    p = points(spark, d).withColumn("row", row).withColumn("col", col)
    return p.where("cls <> 'purchase'").join(p.where("cls = 'purchase'").select("row", "col").distinct(), ["row", "col"], "left_semi").select("id", r6("x"), r6("y"), "z")


@query(f"WITH {POINTS_SQL}, c AS (SELECT DISTINCT cls AS cluster, {_PIX} AS lin FROM points WHERE z > 250) SELECT cluster, count(*) AS n, round(min(z), 6) AS zmin, round(sum(z), 4) AS zsum FROM c JOIN (SELECT *, {_PIX} AS lin FROM points) p USING (lin) GROUP BY cluster")
def j05_points_per_cluster(spark, d):
    row, col = pixel()
    p = points(spark, d).withColumn("row", row).withColumn("col", col)
    c = p.where("z > 250").select(F.col("cls").alias("cluster"), "row", "col").dropDuplicates()
    return c.join(p.select("row", "col", "z"), ["row", "col"]).groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.min("z"), 6).alias("zmin"), F.round(F.sum("z"), 4).alias("zsum"))


@query(f"WITH {POINTS_SQL}, {BOXES_SQL} SELECT box, count(*) AS n, round(avg(z), 6) AS zmean FROM points JOIN boxes ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY box")
def j06_points_in_box(spark, d):
    return spatial.points_in_boxes(points(spark, d), boxes(spark, d), 30.0, 144.0).groupBy("box").agg(F.count("*").alias("n"), F.round(F.avg("z"), 6).alias("zmean"))


@query(f"WITH {POINTS_SQL}, {BOXES_SQL} SELECT box, count(*) AS n FROM points JOIN boxes ON x > x0 AND x < x1 AND y > y0 AND y < y1 WHERE (x - x0) / 30.0 + (y - y0) / 144.0 < 1 GROUP BY box")
def j07_points_in_polygon(spark, d):
    """The lower left triangle of every box."""
    c = F.col
    b = boxes(spark, d).withColumn("ring", rings.make_ring((c("x0"), c("y0")), (c("x1"), c("y0")), (c("x0"), c("y1"))))
    return spatial.points_in_boxes(points(spark, d), b, 30.0, 144.0, ring="ring").groupBy("box").agg(F.count("*").alias("n"))


@query(f"WITH {POINTS_SQL}, p AS (SELECT * FROM points WHERE z > 150), n AS (SELECT a.cls, a.id, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS dist FROM p a JOIN p b ON a.cls = b.cls AND a.id <> b.id GROUP BY 1, 2) SELECT cls, round(quantile_cont(dist, 0.5), 6) AS q50, round(quantile_cont(dist, 0.75), 6) AS q75, round(quantile_cont(dist, 0.9), 6) AS q90, count(*) AS n FROM n WHERE dist > 0 GROUP BY cls")
def j08_nn_spacing(spark, d):
    near = spatial.nearest_neighbours(points(spark, d).where("z > 150"), 16.0, ("cls",))
    return spatial.spacing(near, ("cls",)).select("cls", r6("q50"), r6("q75"), r6("q90"), "n")


@query(
    f"WITH {LINES_SQL}, l AS (SELECT *, greatest(CAST(ceil(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / 40.0) AS INT), 1) AS n FROM lines), s AS (SELECT building, line, k, x1 + (x2 - x1) * (k / n) AS sx, y1 + (y2 - y1) * (k / n) AS sy FROM (SELECT *, unnest(range(0, n + 1)) AS k FROM l)), "
    "q AS (SELECT CAST(x AS BIGINT) AS building, y AS px, z AS py FROM points), m AS (SELECT s.building, line, k, min(sqrt((px - sx) * (px - sx) + (py - sy) * (py - sy))) AS dist FROM s JOIN q ON s.building = q.building GROUP BY 1, 2, 3) "
    "SELECT building, line, count(*) AS samples, count(*) FILTER (dist <= 15.0) AS soft, count(*) FILTER (dist <= 30.0) AS hard, round(count(*) FILTER (dist <= 15.0) / count(*), 6) AS ratio FROM m GROUP BY 1, 2"
)
def j09_line_support(spark, d):
    p = points(spark, d).select(F.col("x").cast("long").alias("building"), F.col("y").alias("x"), F.col("z").alias("y"))
    return spatial.line_support(lines(spark, d), p, 40.0, 15.0, 30.0, ("building",)).select("building", "line", "samples", "soft", "hard", r6("ratio"))


_ADJ = f"{POINTS_SQL}, {BOXES_SQL}, k AS (SELECT box, x0, y0, x1, y1, count(id) >= 15 AS kept FROM boxes LEFT JOIN (SELECT * FROM points WHERE cls = 'error' AND z > 300) p ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY ALL), adj AS (SELECT a.box, b.box AS other FROM boxes a JOIN boxes b ON (((a.x1 = b.x0 OR a.x0 = b.x1) AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 1e-9) OR ((a.y1 = b.y0 OR a.y0 = b.y1) AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 1e-9)))"


@query(f"WITH {_ADJ} SELECT * FROM adj")
def j13_adjacency(spark, d):
    return spatial.adjacency(boxes(spark, d))


@query(f"WITH {_ADJ} SELECT k.box, kept, kept OR coalesce(bool_and(o_kept), false) AS final FROM k LEFT JOIN (SELECT adj.box, k.kept AS o_kept FROM adj JOIN k ON adj.other = k.box) n USING (box) GROUP BY k.box, kept")
def j14_rescue(spark, d):
    b = boxes(spark, d)
    inside = spatial.points_in_boxes(points(spark, d).where("cls = 'error' and z > 300"), b, 30.0, 144.0).groupBy("box").agg(F.count("*").alias("n"))
    told = b.join(inside, "box", "left").withColumn("kept", F.coalesce("n", F.lit(0)) >= 15)
    return spatial.rescue(told, spatial.adjacency(b)).select("box", "kept", "final")


# --- boxes ------------------------------------------------------------------------------------------------------------


@query("SELECT label, round((vx + vy) / 2 - sqrt(((vx - vy) / 2) ** 2 + c * c), 9) AS minor FROM (SELECT label, var_samp(embedding[1]::DOUBLE) AS vx, var_samp(embedding[2]::DOUBLE) AS vy, covar_samp(embedding[1]::DOUBLE, embedding[2]::DOUBLE) AS c FROM embeddings GROUP BY label)")
def a09_pca_minor(spark, d):
    """The smaller eigenvalue of the covariance, in closed form."""
    e = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    s = e.groupBy("label").agg(F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c"))
    half = (F.col("vx") - F.col("vy")) / 2
    return s.select("label", F.round((F.col("vx") + F.col("vy")) / 2 - F.sqrt(half * half + F.col("c") * F.col("c")), 9).alias("minor"))


@query(
    f"WITH {POINTS_SQL}, {BOXES_SQL}, p AS (SELECT * FROM points WHERE cls = 'error' AND z > 350), occ AS (SELECT DISTINCT box, CAST(least(9, floor((x - x0) / 3)) AS INT) AS i, CAST(least(11, floor((y - y0) / 12)) AS INT) AS j FROM p JOIN boxes ON x > x0 AND x < x1 AND y > y0 AND y < y1), "
    "grown AS (SELECT DISTINCT box, i + a AS i, j + b AS j FROM occ, range(-1, 2) u(a), range(-1, 2) v(b) WHERE a * a + b * b <= 1) SELECT boxes.box, (SELECT count(*) FROM occ WHERE occ.box = boxes.box) / 120.0 AS raw, round(count(g.i) / 120.0, 6) AS coverage FROM boxes LEFT JOIN (SELECT * FROM grown WHERE i BETWEEN 0 AND 9 AND j BETWEEN 0 AND 11) g USING (box) GROUP BY boxes.box"
)
def a10_coverage(spark, d):
    b = boxes(spark, d)
    inside = spatial.points_in_boxes(points(spark, d).where("cls = 'error' and z > 350"), b, 30.0, 144.0)
    occ = inside.select("box", F.least(F.lit(9), F.floor((F.col("x") - F.col("x0")) / 3)).cast("int").alias("row"), F.least(F.lit(11), F.floor((F.col("y") - F.col("y0")) / 12)).cast("int").alias("col")).distinct()
    grown = cells.splat(occ, 1).where("row between 0 and 9 and col between 0 and 11").distinct()
    count = lambda c, to: c.groupBy("box").agg((F.count("*") / 120.0).alias(to))
    out = b.join(count(occ, "raw"), "box", "left").join(count(grown, "coverage"), "box", "left").na.fill(0.0, ["raw", "coverage"])
    return out.select("box", "raw", r6("coverage"))


@query(f"WITH {POINTS_SQL} SELECT count(*) AS n, round(sum(z), 4) AS zsum FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY md5(CAST(id AS VARCHAR)), id) AS r FROM points) WHERE r <= 100")
def t07_hash_sample(spark, d):
    return spatial.hash_sample(points(spark, d), ["id"], 100, ("cls",)).agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("zsum"))


# --- heights ----------------------------------------------------------------------------------------------------------


@query("WITH t AS (SELECT p_brand AS k, p_retailprice AS z, sum(1.0 / (1 + p_size)) AS w FROM part GROUP BY 1, 2), r AS (SELECT k, z, sum(w) OVER (PARTITION BY k ORDER BY z ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY k) AS tw FROM t) SELECT k AS brand, round(min(z), 6) AS z FROM r WHERE cw >= 0.9 * tw GROUP BY k")
def a16_weighted_p90(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("z"), (1.0 / (1 + F.col("p_size"))).alias("w"))
    return ordered.weighted_percentile(p, 0.9, ("brand",)).select("brand", r6("z"))


@query("WITH t AS (SELECT p_brand AS k, p_retailprice AS z, sum(1.0 / (1 + p_size)) AS w FROM part GROUP BY 1, 2), r AS (SELECT k, z, sum(w) OVER (PARTITION BY k ORDER BY z ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY k) AS tw FROM t) SELECT k AS brand, round(min(z), 6) AS z FROM r WHERE cw >= 0.5 * tw GROUP BY k")
def a14b_weighted_median(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("z"), (1.0 / (1 + F.col("p_size"))).alias("w"))
    return ordered.weighted_percentile(p, 0.5, ("brand",)).select("brand", r6("z"))


@query("WITH b AS (SELECT p_brand AS brand, floor(p_retailprice / 20.0) AS b, sum(p_size::DOUBLE) AS w, sum(p_retailprice * p_size) AS zw, min(p_partkey) AS o FROM part GROUP BY 1, 2) SELECT brand, round(zw / w, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY w DESC, o) AS r FROM b) WHERE r = 1")
def a14_weighted_mode(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("z"), F.col("p_size").cast("double").alias("w"), F.col("p_partkey").alias("id"))
    return ordered.weighted_mode(p, 20.0, ("brand",)).select("brand", r6("z"))


@query(f"WITH {POINTS_SQL}, g AS (SELECT id, cls, z, CASE WHEN z - lag(z) OVER w <= 0.05 THEN 0 ELSE 1 END AS b FROM points WINDOW w AS (PARTITION BY cls ORDER BY z, id)), r AS (SELECT *, sum(b) OVER (PARTITION BY cls ORDER BY z, id ROWS UNBOUNDED PRECEDING) AS r FROM g), s AS (SELECT *, count(*) OVER (PARTITION BY cls, r) AS n FROM r) SELECT id, cls, CAST(CASE WHEN n >= 2 THEN sum(CASE WHEN b = 1 AND n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY cls ORDER BY z, id ROWS UNBOUNDED PRECEDING) - 1 ELSE -1 END AS INT) AS label FROM s")
def w07_dbscan_1d(spark, d):
    return ordered.density_1d(points(spark, d), 0.05, 2, ("cls",)).select("id", "cls", "label")


@query(f"WITH {POINTS_SQL} SELECT cls, round(quantile_cont(z, 0.1), 6) AS p10, round(quantile_cont(z, 0.9), 6) AS p90, round(min(z), 6) AS zmin FROM points GROUP BY cls")
def a18_percentiles(spark, d):
    q = F.percentile("z", F.array(F.lit(0.1), F.lit(0.9)))
    out = points(spark, d).groupBy("cls").agg(q.alias("q"), F.round(F.min("z"), 6).alias("zmin"))
    return out.select("cls", F.round(F.get("q", F.lit(0)), 6).alias("p10"), F.round(F.get("q", F.lit(1)), 6).alias("p90"), "zmin")


@query("SELECT p_brand AS brand, arg_max(p_retailprice, p_size * 10000000 - p_partkey) AS z FROM part GROUP BY p_brand")
def a19_peak_of_largest(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.max_by("p_retailprice", F.struct("p_size", -F.col("p_partkey"))).alias("z"))


@query(
    f"WITH {POINTS_SQL}, {BOXES_SQL}, c AS (SELECT box, floor((x - x0) / 3) AS i, floor((y - y0) / 14.4) AS j, max(z) AS z FROM points JOIN boxes ON x > x0 AND x < x1 AND y > y0 AND y < y1 AND cls = 'error' WHERE x <> x0 + 3 * floor((x - x0) / 3) GROUP BY ALL), "
    "w AS (SELECT box, i, j, z, (greatest(0, 1 - sqrt(((i + 0.5) * 3 - 15) ** 2 + ((j + 0.5) * 14.4 - 72) ** 2) / sqrt(15.0 * 15 + 72 * 72))) ** 2 AS w FROM c), b AS (SELECT box, floor(z / 20) AS b, sum(w) AS sw, sum(z * w) AS zw, min(i * 10 + j) AS o FROM w WHERE w > 0 GROUP BY 1, 2) SELECT box, round(zw / sw, 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY box ORDER BY round(sw, 9) DESC, o) AS r FROM b) WHERE r = 1"
)
def a15_box_height(spark, d):
    """Per box: the largest z of each of 10 x 10 cells, weighted by nearness to the center, and their weighted mode."""
    c = F.col
    p = spatial.points_in_boxes(points(spark, d).where("cls = 'error'"), boxes(spark, d), 30.0, 144.0)
    p = p.withColumn("i", F.floor((c("x") - c("x0")) / 3)).withColumn("j", F.floor((c("y") - c("y0")) / 14.4)).where(c("x") != c("x0") + 3 * c("i"))
    top = p.groupBy("box", "i", "j").agg(F.max("z").alias("z"))
    away = F.sqrt(F.pow((c("i") + 0.5) * 3 - 15, 2) + F.pow((c("j") + 0.5) * 14.4 - 72, 2)) / (15.0 * 15 + 72 * 72) ** 0.5
    weighted = top.withColumn("w", F.pow(F.greatest(F.lit(0.0), 1 - away), 2)).withColumn("id", c("i") * 10 + c("j"))
    return ordered.weighted_mode(weighted, 20.0, ("box",)).select("box", r6("z"))


# --- lines ------------------------------------------------------------------------------------------------------------

_LINE = "sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))"
_ANGLE = "((degrees(atan2(y2 - y1, x2 - x1)) % 180) + 180) % 180"


@query(f"WITH {LINES_SQL} SELECT line, round({_LINE}, 6) AS length, round({_ANGLE}, 6) AS angle, CAST(floor({_ANGLE}) AS INT) % 180 AS bin, round(x1 - (x2 - x1) / nullif({_LINE}, 0) * 1000, 4) AS ex, round(y2 + (y2 - y1) / nullif({_LINE}, 0) * 1000, 4) AS ey FROM lines WHERE {_LINE} > 0")
def p08_line_geometry(spark, d):
    c = F.col
    xs = (c("x1"), c("y1"), c("x2"), c("y2"))
    grown = scalar.extend_line(*xs, length=1000.0)
    out = lines(spark, d).withColumn("length", scalar.line_length(*xs)).withColumn("angle", scalar.line_angle(*xs)).where("length > 0")
    return out.select("line", r6("length"), r6("angle"), scalar.angle_bin(c("angle")).alias("bin"), F.round(grown[0], 4).alias("ex"), F.round(grown[3], 4).alias("ey"))


_HIST = f"{LINES_SQL}, h AS (SELECT building, CAST(floor({_ANGLE}) AS INT) % 180 AS bin, sum({_LINE}) AS total FROM lines GROUP BY 1, 2)"


@query(f"WITH {_HIST} SELECT building, bin, round(total, 4) AS total FROM h")
def a12_angle_histogram(spark, d):
    c = F.col
    xs = (c("x1"), c("y1"), c("x2"), c("y2"))
    shaped = lines(spark, d).select("building", scalar.angle_bin(scalar.line_angle(*xs)).alias("bin"), scalar.line_length(*xs).alias("length"), F.lit(1.0).alias("weight"))
    return ordered.angle_histogram(shaped, ("building",)).select("building", "bin", F.round("total", 4).alias("total"))


@query(f"WITH {_HIST}, p AS (SELECT building, bin // 20 AS label, arg_max(bin, round(total, 4) * 1000 - bin / 1000.0) AS angle, max(round(total, 4)) AS total FROM h GROUP BY 1, 2) SELECT building, CAST(label AS INT) AS label, angle, total FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.building = b.building AND a.label <> b.label AND least(abs(a.angle - b.angle), 180 - abs(a.angle - b.angle)) < 25 AND (b.total > a.total OR (b.total = a.total AND b.label < a.label)))")
def m14_merge_near_angles(spark, d):
    h = a12_angle_histogram(spark, d).withColumn("label", F.floor(F.col("bin") / 20).cast("int"))
    peaks = h.groupBy("building", "label").agg(F.max_by("bin", F.struct("total", -F.col("bin"))).alias("angle"), F.max("total").alias("total"))
    return ordered.merge_near_angles(peaks, 25.0, ("building",)).select("building", "label", "angle", "total")


_HOUGH = f"{LINES_SQL}, n AS (SELECT *, abs((y1 - y2) * x1 - (x1 - x2) * y1) / sqrt((y1 - y2) * (y1 - y2) + (x1 - x2) * (x1 - x2) + 1e-10) AS dist, degrees(atan2(x1 - x2, y1 - y2)) AS deg FROM lines), h AS (SELECT *, CAST(floor(dist / 50) AS INT) AS d, CASE WHEN deg < 0 THEN deg + 180 ELSE deg END AS theta, CAST(floor(CASE WHEN deg < 0 THEN deg + 180 ELSE deg END / 10) AS INT) AS t FROM n)"


@query(f"WITH {_HOUGH} SELECT building, d, t, count(*) AS n, min(line) AS first FROM h GROUP BY 1, 2, 3")
def a30_hough(spark, d):
    return detect.hough_cells(detect.hough(lines(spark, d), 50.0, 10.0), "building")


@query(
    f"WITH {_HOUGH}, acc AS (SELECT building, d, t, count(*) AS n, min(line) AS first FROM h GROUP BY 1, 2, 3), best AS (SELECT a.* FROM acc a WHERE NOT EXISTS (SELECT 1 FROM acc b WHERE b.building = a.building AND abs(b.d - a.d) <= 2 AND abs(b.t - a.t) <= 2 AND b.n > a.n)), "
    "m AS (SELECT b.building, b.d, b.t, b.n, min(least(x1, x2)) AS xl, max(greatest(x1, x2)) AS xh, min(least(y1, y2)) AS yl, max(greatest(y1, y2)) AS yh, max(CASE WHEN line = first THEN theta END) AS theta FROM best b JOIN h ON h.building = b.building AND abs(h.d - b.d) <= 2 AND abs(h.t - b.t) <= 2 GROUP BY 1, 2, 3, 4) "
    "SELECT building, d, t, n, round(xl, 6) AS x1, round(CASE WHEN theta >= 90 THEN yh ELSE yl END, 6) AS y1, round(xh, 6) AS x2, round(CASE WHEN theta >= 90 THEN yl ELSE yh END, 6) AS y2 FROM m"
)
def m24_merged_lines(spark, d):
    return detect.merged_lines(lines(spark, d), "building", 50.0, 10.0).select("building", "d", "t", "n", r6("x1"), r6("y1"), r6("x2"), r6("y2"))


@query(f"WITH {LINES_SQL}, p AS (SELECT a.building, a.line AS pred, b.line AS gt, least((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2 + (a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2, (a.x1 - b.x2) ** 2 + (a.y1 - b.y2) ** 2 + (a.x2 - b.x1) ** 2 + (a.y2 - b.y1) ** 2) AS d FROM lines a JOIN lines b ON a.building = b.building WHERE a.line % 2 = 0 AND b.line % 2 = 1) SELECT building, pred, arg_min(gt, d) AS gt, round(min(d), 4) AS d FROM p GROUP BY 1, 2")
def j19_endpoint_distances(spark, d):
    seg = lines(spark, d)
    pairs = detect.endpoint_distances(seg.where("line % 2 = 0"), seg.where("line % 2 = 1"), "building")
    return pairs.groupBy("building", "pred").agg(F.min_by("gt", "d").alias("gt"), F.round(F.min("d"), 4).alias("d"))


# --- detection --------------------------------------------------------------------------------------------------------


@query(f"WITH {DETECTIONS_SQL}, d AS (SELECT *, row_number() OVER o AS rn, sum(tp) OVER (o ROWS UNBOUNDED PRECEDING) AS ctp, (SELECT sum(tp) FROM detections) AS n FROM detections WINDOW o AS (ORDER BY score DESC, id)), e AS (SELECT *, ctp / n AS recall, max(ctp / greatest(rn, 1e-9)) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING) AS env FROM d) SELECT round(sum((recall - coalesce(prev, 0)) * env) * 100, 6) AS ap, count(*) AS n FROM (SELECT *, lag(recall) OVER (ORDER BY rn) AS prev FROM e)")
def a26_average_precision(spark, d):
    det = detections(spark, d)
    return ordered.average_precision(det, det.agg(F.sum("tp").alias("n"))).select(r6("ap"), "n")


@query(f"WITH {DETECTIONS_SQL}, c AS (SELECT sum(tp * flagged) AS b, sum(flagged) AS p, sum(tp) AS t FROM detections) SELECT round(b / p, 6) AS precision, round(b / t, 6) AS recall, round(2.0 * b / (p + t), 6) AS f1, round((2.0 * b + 1) / (p + t + 1), 6) AS dice FROM c")
def a25_pixel_f1(spark, d):
    c = F.col
    s = detections(spark, d).agg(F.sum(c("tp") * c("flagged")).alias("b"), F.sum("flagged").alias("p"), F.sum("tp").alias("t"))
    return s.select(F.round(c("b") / c("p"), 6).alias("precision"), F.round(c("b") / c("t"), 6).alias("recall"), F.round(2.0 * c("b") / (c("p") + c("t")), 6).alias("f1"), F.round(scalar.dice(c("b"), c("p"), c("t")), 6).alias("dice"))


@query(f"WITH {POINTS_SQL}, p AS (SELECT cls AS image, id AS pred, y, z FROM points WHERE z > 200), g AS (SELECT cls AS image, id AS gt, y, z FROM points WHERE z < 2), m AS (SELECT image, pred, gt, (p.y - g.y) ** 2 AS dist, row_number() OVER (PARTITION BY image, pred ORDER BY (p.y - g.y) ** 2, gt) AS r FROM p JOIN g USING (image)), c AS (SELECT * FROM m WHERE r = 1) SELECT c.image, c.pred, c.gt, round(c.dist, 6) AS dist, CASE WHEN dist < 25 AND row_number() OVER (PARTITION BY image, gt, dist < 25 ORDER BY pred) = 1 THEN 1 ELSE 0 END AS tp FROM c")
def j20_greedy_match(spark, d):
    p = points(spark, d).withColumn("image", F.col("cls"))
    pairs = ordered.nearest_truths(p.where("z > 200").withColumnRenamed("id", "pred"), p.where("z < 2").withColumnRenamed("id", "gt"))
    return ordered.greedy_match(pairs, 25.0).select("image", "pred", "gt", F.round("d", 6).alias("dist"), "tp")


@query(f"WITH {POINTS_SQL}, h AS (SELECT {_GRID}, max(z) AS v FROM points GROUP BY 1, 2), m AS (SELECT a.row, a.col, a.v, max(b.v) AS near FROM h a JOIN h b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3) SELECT row, col, v FROM (SELECT *, row_number() OVER (ORDER BY v DESC, row, col) AS r FROM m WHERE v = near) WHERE r <= 200")
def w05_nms_topk(spark, d):
    heat = cells.rasterize(points(spark, d), *pixel(), "max").withColumnRenamed("z", "v")
    return ordered.local_maxima(heat).orderBy(F.desc("v"), "row", "col").limit(200)


@query(f"WITH {POINTS_SQL} SELECT id, cls, z FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY z DESC, id) AS r FROM points) WHERE r <= 40")
def t04_topk_per_scene(spark, d):
    return ordered.top_k(points(spark, d), 40, [F.desc("z"), F.col("id")], ("cls",)).select("id", "cls", "z")


@query(f"WITH {POINTS_SQL} SELECT id, x, round(y, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY round_even(x / 10, 0), round_even(y / 10, 0) ORDER BY id) AS r FROM points) WHERE r = 1")
def w09_round_dedup(spark, d):
    p = points(spark, d).select("id", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    return ordered.rounded_distinct(p, 0).select("id", F.col("ox").alias("x"), F.round("oy", 6).alias("y"))


# --- scalars, rings and solids ----------------------------------------------------------------------------------------


@query(f"WITH {POINTS_SQL} SELECT id, CAST(floor((720 - y) / 24) AS INT) AS row_floor, CAST(trunc((x - 75) / 5) AS INT) AS col_trunc, CAST(floor((x - 75) / 5) AS INT) AS col_floor, CAST(round((y - 360) / 24 * 86400) AS BIGINT) AS row_float FROM points")
def p02_pixel_coords(spark, d):
    c = F.col
    inverse = scalar.affine_inverse(5.0, 0.0, 75.0, 0.0, 24.0, 360.0)
    p = points(spark, d)
    return p.select("id", scalar.north_up_pixel(c("x"), c("y"), 0.0, 720.0, 5.0, 24.0)[0].alias("row_floor"), ((c("x") - 75) / 5).cast("int").alias("col_trunc"), F.floor((c("x") - 75) / 5).cast("int").alias("col_floor"), F.round(scalar.geo_to_pixel(c("x"), c("y"), inverse, "float")[0] * 86400).cast("long").alias("row_float"))


@query(f"WITH {BOXES_SQL} SELECT box, (x1 - x0) * (y1 - y0) * 2 AS area2 FROM boxes")
def p17_shoelace(spark, d):
    c = F.col
    ring = rings.make_ring((c("x0"), c("y0")), (c("x0"), c("y1")), (c("x1"), c("y1")), (c("x1"), c("y0")))
    return boxes(spark, d).select("box", rings.area2(rings.counter_clockwise(ring)).alias("area2"))


def prisms(spark: SparkSession, d: str) -> DataFrame:
    """One prism per box: its rectangle with one more vertex on an edge, zmin 0 and the largest z inside as roof."""
    c = F.col
    ring = rings.make_ring((c("x0"), c("y0")), (c("x0"), c("y1")), (c("x1"), c("y1")), (c("x1"), c("y0")), ((c("x0") + c("x1")) / 2, c("y0")))
    top = spatial.points_in_boxes(points(spark, d), boxes(spark, d), 30.0, 144.0).groupBy("box").agg(F.max("z").alias("z"))
    b = boxes(spark, d).join(top, "box").select(F.floor(c("box") / 5).cast("long").alias("building"), c("box").alias("part"), ring.alias("ring"), F.lit(0.0).alias("zmin"), "z")
    return solids.extrude(b)


_PRISM = f"{POINTS_SQL}, {BOXES_SQL}, pr AS (SELECT box, x0, y0, x1, y1, max(z) AS z FROM points JOIN boxes ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY ALL)"


@query(f"WITH {_PRISM}, t AS (SELECT box, rtrim(rtrim(printf('%.6f', z), '0'), '.') AS zt, CAST(CAST(x0 AS INT) AS VARCHAR) AS a, CAST(CAST(x1 AS INT) AS VARCHAR) AS b, CAST(CAST(y0 AS INT) AS VARCHAR) AS c, CAST(CAST(y1 AS INT) AS VARCHAR) AS d FROM pr) SELECT box AS part, concat_ws(' ', b, c, zt, b, d, zt, a, d, zt, a, c, zt, b, c, zt) AS pos_list FROM t")
def p20_position_list(spark, d):
    return prisms(spark, d).select("part", rings.position_list(F.col("ring"), F.col("z")).alias("pos_list"))


@query(f"WITH {_PRISM} SELECT CAST(box // 5 AS BIGINT) AS building, min(x0) AS x0, min(y0) AS y0, 0.0::DOUBLE AS z0, max(x1) AS x1, max(y1) AS y1, max(z) AS z1 FROM pr GROUP BY 1")
def s19_envelope(spark, d):
    return solids.envelope(prisms(spark, d), keys=("building",))


@query(f"WITH {_PRISM} SELECT box AS part, 4 AS n_walls, round((2 * (x1 - x0) + 2 * (y1 - y0)) * z, 4) AS wall_area, round((x1 - x0) * (y1 - y0) * z, 3) AS volume FROM pr")
def m19_solids(spark, d):
    c = F.col
    quads = solids.walls(c("ring"), c("zmin"), c("z"))
    area = F.aggregate(quads, F.lit(0.0), lambda a, q: a + F.hypot(q[1]["x"] - q[0]["x"], q[1]["y"] - q[0]["y"]) * (q[2]["z"] - q[1]["z"]))
    return prisms(spark, d).select("part", F.size(quads).alias("n_walls"), F.round(area, 4).alias("wall_area"), F.round(rings.area2(c("ring")) / 2 * (c("z") - c("zmin")), 3).alias("volume"))


@query(f"WITH {_PRISM} SELECT CAST(box // 5 AS BIGINT) AS building, CAST(sum(16) AS INT) AS n_v, CAST(sum(6) AS INT) AS n_f FROM pr GROUP BY 1")
def s16_obj(spark, d):
    o = solids.obj_text(prisms(spark, d))
    count = lambda tag: F.size(F.filter(F.split("obj", "\n"), lambda x: x.startswith(tag))).alias(f"n_{tag.strip()}")
    return o.select("building", count("v "), count("f "))


@query(f"WITH {_PRISM}, v AS (SELECT DISTINCT CAST(box // 5 AS BIGINT) AS building, unnest([[x0, y0, 0], [x1, y0, 0], [x1, y1, 0], [x0, y1, 0], [x0, y0, z], [x1, y0, z], [x1, y1, z], [x0, y1, z]]) AS p FROM pr) SELECT building, count(*) AS n, 'V' || lpad(CAST(count(*) AS VARCHAR), 8, '0') AS last FROM v GROUP BY 1")
def s17_named_mesh(spark, d):
    return solids.named_mesh(prisms(spark, d)).groupBy("building").agg(F.count("*").alias("n"), F.max("name").alias("last"))


@query(f"WITH {_PRISM} SELECT CAST(box // 5 AS BIGINT) AS building, count(*) AS grounds, count(*) AS roofs, CAST(sum(4) AS BIGINT) AS walls, CAST(sum(6) AS BIGINT) AS links FROM pr GROUP BY 1")
def s18_citygml(spark, d):
    count = lambda text, name: (F.size(F.split("xml", text)) - 1).cast("long").alias(name)
    return solids.citygml(prisms(spark, d)).select("building", count("<bldg:GroundSurface>", "grounds"), count("<bldg:RoofSurface>", "roofs"), count("<bldg:WallSurface>", "walls"), count("xlink:href", "links"))


_RING_JSON = "'[{\"x\":' || CAST(x0 AS VARCHAR) || ',\"y\":' || CAST(y0 AS VARCHAR) || '},{\"x\":' || CAST(x1 AS VARCHAR) || ',\"y\":' || CAST(y0 AS VARCHAR) || '},{\"x\":' || CAST(x1 AS VARCHAR) || ',\"y\":' || CAST(y1 AS VARCHAR) || '},{\"x\":' || CAST(x0 AS VARCHAR) || ',\"y\":' || CAST(y1 AS VARCHAR) || '}]'"


def ringed(spark, d):
    c = F.col
    ring = rings.make_ring((c("x0"), c("y0")), (c("x1"), c("y0")), (c("x1"), c("y1")), (c("x0"), c("y1")))
    return boxes(spark, d).withColumn("building", F.floor(c("x0") / 30).cast("long")).withColumn("ring", ring)


@query(f"WITH {BOXES_SQL} SELECT CAST(floor(x0 / 30) AS BIGINT) AS building, '[' || string_agg({_RING_JSON}, ',' ORDER BY box) || ']' AS json, count(*) AS n FROM boxes GROUP BY 1")
def s14_box_json(spark, d):
    """Written, read back, and told with the number of rings that came back."""
    texts = files.boxes_json(ringed(spark, d), "building")
    back = files.parse_boxes(texts, "building").groupBy("building").agg(F.count("*").alias("n"))
    return texts.join(back, "building").select("building", "json", "n")


@query(f"WITH {BOXES_SQL} SELECT box, box % 3 = 0 AS valid FROM boxes")
def f13_valid_rings(spark, d):
    """Rectangles, some with two corners swapped, some folded onto a line."""
    r = lambda i: F.get("ring", F.lit(i))
    odd = F.when(F.col("box") % 3 == 0, F.col("ring")).when(F.col("box") % 3 == 1, F.array(r(0), r(2), r(1), r(3))).otherwise(F.array(r(0), r(1), r(0)))
    return ringed(spark, d).select("box", rings.is_valid(odd).alias("valid"))


@query(f"WITH {BOXES_SQL}, w AS (SELECT box, greatest(0, floor(x0 / 4)) AS c0, greatest(0, floor((720 - y1) / 7)) AS r0, least(30, ceil(x1 / 4)) AS c1, least(100, ceil((720 - y0) / 7)) AS r1 FROM boxes) SELECT box, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, CAST(r1 - r0 AS INT) AS height, CAST(c1 - c0 AS INT) AS width, c0 * 4.0 AS c, 720 - r0 * 7.0 AS f FROM w WHERE c1 > c0 AND r1 > r0")
def s13_crop_windows(spark, d):
    c = F.col
    window = scalar.crop_window(c("x0"), c("y0"), c("x1"), c("y1"), (4.0, 0.0, 0.0, 0.0, -7.0, 720.0), 100, 30)
    return boxes(spark, d).select("box", window.alias("w")).where("w is not null").select("box", "w.*")


@query(f"WITH {POINTS_SQL}, {BOXES_SQL}, m AS (SELECT box, count(*) AS n, count(DISTINCT floor((x - x0) / 5) * 100 + floor((y - y0) / 24)) / 36.0 AS cov FROM points JOIN boxes ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY 1) SELECT box, n, n >= 3 AND cov >= 0.99 AS strict, n >= 3 AND cov >= 0.95 AS usual, n >= 3 AND cov >= 0.3 AS loose FROM m")
def f14_keep_rule(spark, d):
    met = spatial.points_in_boxes(points(spark, d), boxes(spark, d), 30.0, 144.0)
    cell = F.floor((F.col("x") - F.col("x0")) / 5) * 100 + F.floor((F.col("y") - F.col("y0")) / 24)
    m = met.groupBy("box").agg(F.count("*").alias("n"), (F.count_distinct(cell) / 36.0).alias("cov"))
    return m.select("box", "n", *[heights.keep_rule(F.col("n"), F.col("cov"), threshold=t).alias(name) for name, t in (("strict", 0.99), ("usual", 0.95), ("loose", 0.3))])


@query()
def a15_box_heights(spark, d):
    p = points(spark, d).withColumn("building", F.floor(F.col("x") / 30).cast("long"))
    return heights.box_heights(ringed(spark, d), p).select("building", "box", r6("z"), "level")


@query()
def j01_agl_filled(spark, d):
    upper_, ground_ = cells.rasterize(upper(spark, d), *pixel(), "max"), cells.rasterize(ground(spark, d), *pixel(), "min")
    return tiles.height_above_filled(upper_, ground_, 10.0, extent(spark, d)).select("row", "col", "z", r6("agl"))


@query("SELECT c_custkey, regexp_extract(c_name, '(\\d+)$', 1) AS digits, split_part(c_name, '#', 1) AS stem FROM customer")
def p21_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalar.trailing_number(F.col("c_name")).alias("digits"), F.get(F.split("c_name", "#"), F.lit(0)).alias("stem"))


@query(f"WITH {POINTS_SQL}, s AS (SELECT cls, quantile_cont(z, 0.02) AS lo, quantile_cont(z, 0.98) AS hi FROM points GROUP BY cls) SELECT id, round(greatest(0, least(255, (z - lo) / greatest(hi - lo, 1e-6) * 255)), 4) AS v FROM points JOIN s USING (cls)")
def p23_stretch(spark, d):
    p = points(spark, d)
    q = p.groupBy("cls").agg(F.percentile("z", F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    return p.join(q, "cls").select("id", F.round(scalar.stretch(F.col("z"), F.get("q", F.lit(0)), F.get("q", F.lit(1))), 4).alias("v"))


@query(f"WITH {POINTS_SQL}, u AS (SELECT DISTINCT round(x, 3) AS v FROM points UNION SELECT DISTINCT round(y, 3) FROM points), g AS (SELECT v - lag(v) OVER (ORDER BY v) AS gap FROM u) SELECT round(quantile_cont(gap, 0.5), 6) AS spacing FROM g WHERE gap > 1e-4")
def a29_spacing(spark, d):
    p = points(spark, d)
    u = p.select(F.round("x", 3).alias("v")).union(p.select(F.round("y", 3))).distinct()
    g = ordered.gaps(u, "v").where("gap > 1e-4")
    return g.agg(F.round(F.percentile("gap", F.lit(0.5)), 6).alias("spacing"))


@query(f"WITH {POINTS_SQL}, a AS (SELECT DISTINCT {_GRID} FROM points WHERE cls = 'error'), b AS (SELECT DISTINCT {_GRID} FROM points WHERE cls = 'view') SELECT 'both' AS op, count(*) AS n FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'either', count(*) FROM (FROM a UNION FROM b) UNION ALL SELECT 'first', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)")
def u01_set_operations(spark, d):
    row, col = pixel()
    p = points(spark, d).select("cls", row.alias("row"), col.alias("col"))
    a, b = (p.where(F.col("cls") == c).select("row", "col").dropDuplicates() for c in ("error", "view"))
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return count(a.join(b, ["row", "col"], "left_semi"), "both").union(count(a.union(b).distinct(), "either")).union(count(a.join(b, ["row", "col"], "left_anti"), "first")).union(count(a.unionByName(b), "all"))


@query(f"WITH {POINTS_SQL} SELECT CAST(x AS BIGINT) AS building, count(*) AS n, count(*) >= 70 AS kept FROM points GROUP BY 1")
def f12_quarantine(spark, d):
    g = points(spark, d).groupBy(F.col("x").cast("long").alias("building")).agg(F.count("*").alias("n"))
    return g.withColumn("kept", F.col("n") >= 70)


@query("SELECT CAST(floor(l_extendedprice / 1000) AS INT) AS ci, CAST(floor(l_quantity) AS INT) AS cj, count(*) AS n, min(l_discount * 100) AS zmin, max(l_discount * 100) AS zmax FROM lineitem GROUP BY 1, 2")
def a03_bulk_cells(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("y"), (F.col("l_discount") * 100).alias("z"))
    return li.groupBy(F.floor("x").cast("int").alias("ci"), F.floor("y").cast("int").alias("cj")).agg(F.count("*").alias("n"), F.min("z").alias("zmin"), F.max("z").alias("zmax"))


# --- kernels ----------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {POINTS_SQL}, c AS (SELECT DISTINCT CAST(floor(y / 24) AS INT) AS row, CAST(floor(x / 5) AS INT) AS col FROM points WHERE cls = 'error' AND z > 200), r AS (SELECT row, col, row * 30 + col AS root FROM c UNION SELECT n.row, n.col, r.root FROM r JOIN c n ON abs(n.row - r.row) <= 1 AND abs(n.col - r.col) <= 1) SELECT row, col, CAST(min(root) AS BIGINT) AS component FROM r GROUP BY row, col")
def m06_components(spark, d):
    return tiles.components(cells.rasterize(points(spark, d).where("cls = 'error' and z > 200"), *pixel(), "max"), extent(spark, d)[1], 8)


@query(f"WITH {POINTS_SQL}, o AS (SELECT i, j FROM range(-3, 4) a(i), range(-3, 4) b(j) WHERE i * i + j * j <= 9), c AS (SELECT DISTINCT {_GRID} FROM points WHERE cls = 'error' AND z > 200), g AS (SELECT DISTINCT row + i AS row, col + j AS col FROM c, o) SELECT * FROM (SELECT CAST(g.row - i AS INT) AS row, CAST(g.col - j AS INT) AS col FROM g, o GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM o)) WHERE row BETWEEN 0 AND 29 AND col BETWEEN 0 AND 29")
def m03_closing_tiles(spark, d):
    c = cells.rasterize(points(spark, d).where("cls = 'error' and z > 200"), *pixel(), "max")
    return tiles.closed(c, 3, 8, extent(spark, d))


@query()
def m10_fill_nearest(spark, d):
    return tiles.filled(cells.rasterize(ground(spark, d).where("z > 150"), *pixel(), "min"), extent(spark, d))


@query()
def a33_hulls(spark, d):
    h = tiles.hulls(points(spark, d).select("cls", F.floor("x").alias("x"), F.floor("y").alias("y")), "cls")
    return h.select("cls", F.size("ring").alias("n"), F.round(rings.area2(F.col("ring")) / 2, 3).alias("area"))


@query()
def m15_oriented_lines(spark, d):
    return tiles.oriented_lines(lines(spark, d).withColumn("weight", F.lit(1.0)), "building")


# --- line detection ---------------------------------------------------------------------------------------------------


@query(f"WITH {POINTS_SQL}, h AS (SELECT cls AS img, {_GRID}, 1 / (1 + exp(-max((z - 200) / 100.0))) AS v FROM points GROUP BY 1, 2, 3), m AS (SELECT a.img, a.row, a.col, a.v FROM h a JOIN h b ON a.img = b.img AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3, 4 HAVING a.v = max(b.v)), k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v DESC, row, col) AS r FROM m) SELECT img, round(v, 6) AS score, (col - row)::DOUBLE * 2 AS x1, row::DOUBLE * 2 AS y1, (col + row)::DOUBLE * 2 AS x2, (row + 3)::DOUBLE * 2 AS y2 FROM k WHERE r <= 50 AND v > 0.1 AND sqrt(4.0 * row * row + 9) > 20")
def l05_decode_lines(spark, d):
    p = points(spark, d).withColumn("img", F.col("cls")).withColumn("z", (F.col("z") - 200) / 100.0)
    heat = cells.rasterize(p, *pixel(), "max", keys=("img",)).select("img", "row", "col", F.col("z").alias("v"), (-F.col("row")).alias("dx0"), F.lit(0.0).alias("dy0"), F.col("row").cast("double").alias("dx1"), F.lit(3.0).alias("dy1"))
    return detect.decode_lines(heat, 0.1, 20.0, 50).select("img", r6("score"), "x1", "y1", "x2", "y2")


@query(f"WITH {POINTS_SQL}, h AS (SELECT cls AS img, {_GRID}, 1 / (1 + exp(-max((z - 200) / 100.0))) AS v FROM points GROUP BY 1, 2, 3), m AS (SELECT a.img, a.row, a.col, a.v FROM h a JOIN h b ON a.img = b.img AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3, 4 HAVING a.v = max(b.v)), k AS (SELECT *, row_number() OVER (PARTITION BY img ORDER BY v DESC, row, col) AS r FROM m) SELECT img, row, col, round(v, 6) AS score, (col - row)::DOUBLE AS x1, row::DOUBLE AS y1, (col + row)::DOUBLE AS x2, (row + 3)::DOUBLE AS y2, (col + row)::DOUBLE AS sx1, (row + 3)::DOUBLE AS sy1, (col - row)::DOUBLE AS sx2, row::DOUBLE AS sy2 FROM k WHERE r <= 1000 AND v > 0.1 AND sqrt(4.0 * row * row + 9) > 2")
def l06_training_lines(spark, d):
    p = points(spark, d).withColumn("img", F.col("cls")).withColumn("z", (F.col("z") - 200) / 100.0)
    heat = cells.rasterize(p, *pixel(), "max", keys=("img",)).select("img", "row", "col", F.col("z").alias("v"), (-F.col("row")).alias("dx0"), F.lit(0.0).alias("dy0"), F.col("row").cast("double").alias("dx1"), F.lit(3.0).alias("dy1"))
    return detect.training_lines(heat).select("img", "row", "col", r6("score"), "x1", "y1", "x2", "y2", "sx1", "sy1", "sx2", "sy2")


@query(f"WITH {LINES_SQL}, t AS (SELECT *, y2 - y1 AS a, x1 - x2 AS b, (y2 - y1) * x1 + (x1 - x2) * y1 AS c FROM lines), cross_ AS (SELECT p.building, p.line AS la, q.line AS lb, (q.b * p.c - p.b * q.c) / (p.a * q.b - q.a * p.b) AS x, (p.a * q.c - q.a * p.c) / (p.a * q.b - q.a * p.b) AS y FROM t p JOIN t q ON p.building = q.building AND p.line < q.line WHERE abs(p.a * q.b - q.a * p.b) > 1e-9) SELECT building, la AS a, lb AS b, CAST(round(x * 100) AS BIGINT) AS x, CAST(round(y * 100) AS BIGINT) AS y FROM cross_ WHERE abs(x) < 1000 AND abs(y) < 1000")
def j16_intersections(spark, d):
    out = detect.intersections(lines(spark, d), "building").where("abs(x) < 1000 and abs(y) < 1000")
    return out.select("building", "a", "b", F.round(F.col("x") * 100).cast("long").alias("x"), F.round(F.col("y") * 100).cast("long").alias("y"))


@query("WITH t AS (SELECT CASE WHEN page_id % 7 = 0 THEN 'tile_x_' || page_id ELSE 'tile_' || (page_id % 5) * 40 || '_' || (page_id % 3) * 40 || '.png' END AS name, CAST(page_id % 40 AS INT) AS r, CAST(page_id * 7 % 40 AS INT) AS c, page_id * 13 % 256 AS v FROM pages) SELECT DISTINCT CAST(regexp_extract(name, '^tile_(\\d+)_(\\d+)', 2) AS INT) + r AS row, CAST(regexp_extract(name, '^tile_(\\d+)_(\\d+)', 1) AS INT) + c AS col FROM t WHERE v > 127 AND name NOT LIKE 'tile_x%' AND CAST(regexp_extract(name, '^tile_(\\d+)_(\\d+)', 2) AS INT) + r < 110 AND CAST(regexp_extract(name, '^tile_(\\d+)_(\\d+)', 1) AS INT) + c < 180")
def s12_mosaic(spark, d):
    i = F.col("page_id")
    good = F.concat(F.lit("tile_"), (i % 5 * 40).cast("string"), F.lit("_"), (i % 3 * 40).cast("string"), F.lit(".png"))
    t = table(spark, d, "pages").select(F.when(i % 7 == 0, F.concat(F.lit("tile_x_"), i.cast("string"))).otherwise(good).alias("name"), (i % 40).cast("int").alias("r"), (i * 7 % 40).cast("int").alias("c"), (i * 13 % 256).alias("v"))
    return detect.mosaic(t, 180, 110)


@query(f"WITH {POINTS_SQL}, c AS (SELECT {_GRID}, max(z) AS z FROM points WHERE cls = 'error' GROUP BY 1, 2) SELECT CAST(a.i AS INT) AS row, CAST(b.j AS INT) AS col, z FROM range(0, 45) a(i), range(0, 20) b(j), c WHERE c.row = floor((a.i + 0.5) / 1.5) AND c.col = floor((b.j + 0.5) * 1.5)")
def m11_reproject(spark, d):
    c = cells.rasterize(points(spark, d).where("cls = 'error'"), *pixel(), "max")
    rows, cols = extent(spark, d)
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    return detect.resample(c, upto(-(-rows * 3 // 2)), upto(-(-cols * 2 // 3)), rows, cols, 1 / 1.5, 1.5)


@query(f"WITH {POINTS_SQL}, {BOXES_SQL} SELECT box, count(*) AS n, round(avg(CASE WHEN least(x - x0, x1 - x, y - y0, y1 - y) <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS edge, round(1.0 / (count(*) + 1), 9) AS complexity FROM points JOIN boxes ON x > x0 AND x < x1 AND y > y0 AND y < y1 GROUP BY box")
def a23_edge_share(spark, d):
    inside = spatial.points_in_boxes(points(spark, d), boxes(spark, d), 30.0, 144.0)
    return detect.edge_share(inside, 3.0).select("box", "n", r6("edge"), F.round(1.0 / (F.col("n") + 1), 9).alias("complexity"))


@query(f"WITH {POINTS_SQL}, c AS (SELECT DISTINCT CAST(floor(y * 7) AS INT) AS row, CAST(floor(x * 11) AS INT) AS col FROM points WHERE z > 150), g AS (SELECT (SELECT quantile_cont(g, 0.5) FROM (SELECT row - lag(row) OVER (ORDER BY row) AS g FROM (SELECT DISTINCT row FROM c))) AS dr, (SELECT quantile_cont(g, 0.5) FROM (SELECT col - lag(col) OVER (ORDER BY col) AS g FROM (SELECT DISTINCT col FROM c))) AS dc), s AS (SELECT dc >= dr AS horizontal, greatest(5, least(31, CAST(round(greatest(dr, dc)) AS INT))) AS k FROM g) SELECT horizontal, CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END AS size FROM s")
def a28_stripe(spark, d):
    c = points(spark, d).where("z > 150").select(F.floor(F.col("y") * 7).cast("int").alias("row"), F.floor(F.col("x") * 11).cast("int").alias("col"))
    return detect.stripe_size(c)
