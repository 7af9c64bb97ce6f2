"""More registered queries, beside their SQL: scalars, predicates, joins, components, line detection and scene files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import rings, scalar
from plumbline.operators import cells, detect, graph, ordered, spatial, tiles
from plumbline.plans.fixtures import BOXES_SQL, DETECTIONS_SQL, LINES_SQL, POINTS_SQL, boxes, detections, last, lines, points, table
from plumbline.plans.queries import _GRID, extent, ground, pixel, query, r6, upper
from plumbline.sources import files

c = F.col


def r4(value, name: str):
    return F.round(value, 4).alias(name)


# --- scalars ----------------------------------------------------------------------------------------------------------


@query(f"WITH {POINTS_SQL} SELECT id, CAST(trunc((z - 100.0) / 0.25) AS INT) AS stored, CAST(trunc((z - 100.0) / 0.25) AS INT) * 0.25::DOUBLE + 100.0 AS z FROM points")
def p01_quantize(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("id", scalar.requantize(c("z"), 0.25, 100.0).alias("stored")).withColumn("z", scalar.dequantize(c("stored"), 0.25, 100.0))


@query(f"WITH {POINTS_SQL} SELECT id, round(floor(x / 5) * 5.0 + 75, 6)::DOUBLE AS gx, round(floor(y / 24) * -24.0 + 720, 6)::DOUBLE AS gy FROM points")
def p03_pixel_to_geo(spark, d):
    row, col = pixel()
    x, y = scalar.pixel_to_geo(col, row, (5.0, 0.0, 75.0, 0.0, -24.0, 720.0))
    return points(spark, d).select("id", F.round(x, 6).alias("gx"), F.round(y, 6).alias("gy"))


_ANGLE = "((degrees(atan2(y2 - y1, x2 - x1)) % 180) + 180) % 180"


@query(f"WITH {LINES_SQL}, a AS (SELECT *, {_ANGLE} AS a FROM lines), n AS (SELECT a.line, a.a, k.i, least(abs(a.a - k.v) % 180, 180 - abs(a.a - k.v) % 180) AS g FROM a, (VALUES (0, 0.0::DOUBLE), (1, 45.0), (2, 90.0), (3, 135.0)) k(i, v)) SELECT line, CAST(arg_min(i, g) AS INT) AS label, round(min(g), 4) AS gap FROM n GROUP BY line")
def j23_nearest_center(spark, d):
    a = scalar.line_angle(c("x1"), c("y1"), c("x2"), c("y2"))
    centers = [0.0, 45.0, 90.0, 135.0]
    gap = F.least(*[scalar.angle_difference(a, F.lit(k)) for k in centers])
    return lines(spark, d).select("line", scalar.nearest_center(a, centers).alias("label"), r4(gap, "gap"))


_LABELLED = f"{LINES_SQL}, a AS (SELECT *, {_ANGLE} AS a, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM lines), b AS (SELECT *, CAST(floor(a) AS INT) % 180 AS bin, CAST(floor(a / 45) AS INT) AS label FROM a), t AS (SELECT building, label, bin, sum(len) AS total FROM b GROUP BY ALL), peak AS (SELECT building, label, bin, total FROM (SELECT *, row_number() OVER (PARTITION BY building, label ORDER BY total DESC, bin) AS r FROM t) WHERE r = 1)"


def _labelled(spark, d) -> tuple[DataFrame, DataFrame]:
    """Lines with angle bin and label, and the heaviest bin of each label."""
    a = scalar.line_angle(c("x1"), c("y1"), c("x2"), c("y2"))
    told = lines(spark, d).select("building", "line", scalar.angle_bin(a).alias("bin"), F.floor(a / 45).cast("int").alias("label"), scalar.line_length(c("x1"), c("y1"), c("x2"), c("y2")).alias("length"))
    totals = told.groupBy("building", "label", "bin").agg(F.sum("length").alias("total"))
    peaks = totals.groupBy("building", "label").agg(F.max_by("bin", F.struct("total", -c("bin"))).alias("bin"), F.max("total").alias("total"))
    return told, peaks


@query(f"WITH {_LABELLED} SELECT building, label, bin, round(total, 4) AS total FROM peak WHERE total > 300")
def a13_cluster_peaks(spark, d):
    return _labelled(spark, d)[1].where("total > 300").select("building", "label", "bin", r4(c("total"), "total"))


@query(f"WITH {_LABELLED} SELECT b.building, b.line, p.bin AS peak FROM b JOIN peak p USING (building, label) WHERE p.total > 300")
def j18_cluster_lookup(spark, d):
    told, peaks = _labelled(spark, d)
    return told.join(peaks.where("total > 300").select("building", "label", c("bin").alias("peak")), ["building", "label"]).select("building", "line", "peak")


@query(f"WITH {LINES_SQL} SELECT line, round((x1 + x2) / 2, 6) AS mx, CAST(floor((y1 + y2) / 2) AS BIGINT) AS my, CAST(trunc(x1 * (1024.0::DOUBLE / 512.0)) AS INT) AS sx, round(y1 * (256.0::DOUBLE / 512.0), 6) AS sy FROM lines")
def p13_midpoints(spark, d):
    return lines(spark, d).select("line", F.round(scalar.midpoint(c("x1"), c("x2")), 6).alias("mx"), scalar.midpoint(c("y1"), c("y2"), True).alias("my"), scalar.rescale(c("x1"), 512.0, 1024.0, True).alias("sx"), F.round(scalar.rescale(c("y1"), 512.0, 256.0), 6).alias("sy"))


@query(f"WITH {LINES_SQL}, u AS (SELECT line, x1, y1, x2, y2, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS n FROM lines) SELECT line, round(x1 - (x2 - x1) / n * 100, 4) AS ex1, round(y2 + (y2 - y1) / n * 100, 4) AS ey2, round((x1 + x2) / 2 + (x1 - (x1 + x2) / 2) * cos(radians(30.0)) - (y1 - (y1 + y2) / 2) * sin(radians(30.0)), 4) AS rx, round((y1 + y2) / 2 + (x1 - (x1 + x2) / 2) * sin(radians(30.0)) + (y1 - (y1 + y2) / 2) * cos(radians(30.0)), 4) AS ry FROM u WHERE n > 0")
def p12_extend_rotate(spark, d):
    e = scalar.extend_line(c("x1"), c("y1"), c("x2"), c("y2"), 100.0)
    rx, ry = scalar.rotate((c("x1") + c("x2")) / 2, (c("y1") + c("y2")) / 2, c("x1"), c("y1"), F.lit(30.0))
    return lines(spark, d).where("x1 <> x2 or y1 <> y2").select("line", r4(e[0], "ex1"), r4(e[3], "ey2"), r4(rx, "rx"), r4(ry, "ry"))


@query(f"WITH {POINTS_SQL}, s AS (SELECT id, least(greatest(z / 40 * 1.75, 5.0), 12.0) AS soft, z / 600 AS r FROM points) SELECT id, round(soft, 9) AS soft, round(least(24.0, soft * 2), 9) AS hard, round(greatest(2.0, soft * 0.75), 9) AS step, round((0.25 + 0.75 * r) ** 2, 9) AS weight FROM s")
def p16_support(spark, d):
    soft, hard, step = scalar.support_params(c("z") / 40)
    return points(spark, d).select("id", F.round(soft, 9).alias("soft"), F.round(hard, 9).alias("hard"), F.round(step, 9).alias("step"), F.round(scalar.support_weight(c("z") / 600), 9).alias("weight"))


@query(f"WITH {LINES_SQL}, v AS (SELECT building, line, x2 - x1 AS ux, y2 - y1 AS uy, lead(x2 - x1) OVER w AS vx, lead(y2 - y1) OVER w AS vy FROM lines WINDOW w AS (PARTITION BY building ORDER BY line)) SELECT line, round(CASE WHEN sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy) < 1e-12 THEN pi() ELSE acos(least(1.0, greatest(-1.0, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy))))) END, 4) AS turn FROM v WHERE vx IS NOT NULL")
def p18_vector_angle(spark, d):
    w = Window.partitionBy("building").orderBy("line")
    v = lines(spark, d).select("building", "line", (c("x2") - c("x1")).alias("ux"), (c("y2") - c("y1")).alias("uy"))
    v = v.withColumn("vx", F.lead("ux").over(w)).withColumn("vy", F.lead("uy").over(w)).where("vx is not null")
    return v.select("line", r4(scalar.vector_angle(c("ux"), c("uy"), c("vx"), c("vy")), "turn"))


@query(f"WITH {BOXES_SQL} SELECT box, 4 AS corners, 5 AS triangle FROM boxes")
def p19_collinear(spark, d):
    """A rectangle with one more vertex on an edge loses it; a bend of more than 5 degrees stays."""
    flat, bent = ((c("x0") + c("x1")) / 2, c("y0")), ((c("x0") + c("x1")) / 2, c("y0") - 10)
    ring = lambda p: rings.make_ring((c("x0"), c("y0")), p, (c("x1"), c("y0")), (c("x1"), c("y1")), (c("x0"), c("y1")))
    return boxes(spark, d).select("box", F.size(rings.without_collinear(ring(flat))).alias("corners"), F.size(rings.without_collinear(ring(bent))).alias("triangle"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey < 10 THEN 'urn:ogc:def:crs:EPSG::' || n_nationkey WHEN n_nationkey < 20 THEN n_name ELSE 'EPSG::0' END AS srs FROM nation")
def p22_srs_names(spark, d):
    k = c("n_nationkey")
    return table(spark, d, "nation").select(k.alias("k"), scalar.srs_name(F.when(k < 10, k), F.when(k < 20, c("n_name"))).alias("srs"))


@query(f"WITH {BOXES_SQL} SELECT a.box AS a, b.box AS b, greatest(a.x0 - b.x1, b.x0 - a.x1, a.y0 - b.y1, b.y0 - a.y1, 0.0::DOUBLE) AS gap, greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0) + 10) * greatest(0.0::DOUBLE, least(a.y1, b.y1) - greatest(a.y0, b.y0) + 10) AS overlap FROM boxes a JOIN boxes b ON a.box // 5 = b.box // 5 AND a.box < b.box")
def p25_box_gaps(spark, d):
    a = boxes(spark, d).withColumn("strip", F.floor(c("box") / 5))
    b = a.select("strip", *[c(n).alias(f"b{n}") for n in ("box", "x0", "y0", "x1", "y1")])
    box = [c(f"{s}{n}") for s in ("", "b") for n in ("x0", "y0", "x1", "y1")]
    return a.join(b, "strip").where("box < bbox").select(c("box").alias("a"), c("bbox").alias("b"), scalar.bbox_gap(*box).alias("gap"), scalar.bbox_overlap(*box, grow=5.0).alias("overlap"))


@query(f"WITH {POINTS_SQL}, q AS (SELECT CASE WHEN cls IN ('signup', 'click') THEN 'ground_' ELSE 'non_ground_' END || cls AS tag, quantile_cont(z, 0.75) AS q FROM points GROUP BY cls) SELECT tag, CAST(CASE WHEN tag LIKE '%non_ground%' THEN least(5, greatest(2, ceil(q * 0.75 / 20.0))) ELSE 0 END AS INT) AS radius FROM q")
def p27_splat_radius(spark, d):
    tag = F.concat(F.when(c("cls").isin("signup", "click"), "ground_").otherwise("non_ground_"), c("cls"))
    q = points(spark, d).groupBy(tag.alias("tag")).agg(F.percentile("z", F.lit(0.75)).alias("q"))
    return q.select("tag", scalar.splat_pixels(c("q"), 20.0, c("tag")).alias("radius"))


@query("SELECT n_nationkey AS k, round(0.01 * (CASE WHEN n_nationkey * 60 < 500 THEN (1 - n_nationkey * 60 / 500.0) / 3 + n_nationkey * 60 / 500.0 ELSE 1 END) * pow(0.1::DOUBLE, CAST(n_nationkey * 60 >= 600 AS INT) + CAST(n_nationkey * 60 >= 1200 AS INT)), 9)::DOUBLE AS rate FROM nation")
def p31_learning_rate(spark, d):
    k = c("n_nationkey")
    return table(spark, d, "nation").select(k.alias("k"), F.round(scalar.learning_rate(k * 60, 0.01, [600, 1200]), 9).alias("rate"))


@query(f"WITH {DETECTIONS_SQL}, d AS (SELECT flagged, tp, ln(score + 1) - 7 AS z FROM detections), p AS (SELECT *, 1 / (1 + exp(-z)) AS p, greatest(z, 0) - z * tp + ln(1 + exp(-abs(z))) AS bce FROM d) SELECT flagged, round(-sum(CASE WHEN tp = 1 THEN ln(p) * (1 - p) ** 2 ELSE ln(1 - p) * p ** 2 END) / greatest(1, sum(CAST(tp = 1 AS INT))), 4) AS focal, round(coalesce(sum(bce) FILTER (tp <> 0), 0) / (count(*) FILTER (tp <> 0) + 1e-5) + 30 * coalesce(sum(bce) FILTER (tp = 0), 0) / (count(*) FILTER (tp = 0) + 1e-5), 4) AS bce FROM p GROUP BY flagged")
def p31_losses(spark, d):
    z = detections(spark, d).select("flagged", "tp", (F.log(c("score") + 1) - 7).alias("z"))
    return z.groupBy("flagged").agg(r4(scalar.focal_loss("z", "tp"), "focal"), r4(scalar.weighted_bce("z", "tp"), "bce"))


@query(f"WITH {POINTS_SQL}, s AS (SELECT {_GRID}, avg(z) AS z FROM points GROUP BY 1, 2) SELECT row, 29 - col AS flipped, round(z / 255, 6) AS unit, round(z / 127.5 - 1, 6) AS centered FROM s")
def p30_flip_normalize(spark, d):
    g = cells.rasterize(points(spark, d), *pixel(), "mean")
    return g.select("row", (extent(spark, d)[1] - 1 - c("col")).alias("flipped"), F.round(c("z") / 255, 6).alias("unit"), F.round(c("z") / 127.5 - 1, 6).alias("centered"))


# --- predicates and cells ---------------------------------------------------------------------------------------------

_VALID = "SELECT CAST(floor(z / 40) AS INT) AS row, CAST(floor(y / 24) AS INT) AS col FROM points GROUP BY 1, 2 HAVING count(*) >= 4"


@query(f"WITH {LINES_SQL}, e AS (SELECT building, line, CAST(trunc(x1 / 24) AS INT) AS c1, CAST(trunc(y1 / 40) AS INT) AS r1, CAST(trunc(x2 / 24) AS INT) AS c2, CAST(trunc(y2 / 40) AS INT) AS r2 FROM lines), n AS (SELECT *, greatest(abs(c2 - c1), abs(r2 - r1)) AS n FROM e), k AS (SELECT *, unnest(range(0, n + 1)) AS k FROM n), px AS (SELECT building, line, CASE WHEN n = 0 THEN r1 ELSE r1 + CAST(floor((2 * k * (r2 - r1) + n) / (2.0 * n)) AS INT) END AS row, CASE WHEN n = 0 THEN c1 ELSE c1 + CAST(floor((2 * k * (c2 - c1) + n) / (2.0 * n)) AS INT) END AS col FROM k), bad AS (SELECT building, line FROM px ANTI JOIN ({_VALID}) v USING (row, col) WHERE row BETWEEN 0 AND 13 AND col BETWEEN 0 AND 29 GROUP BY ALL HAVING count(*) >= 2) SELECT building, line FROM lines ANTI JOIN bad USING (building, line)")
def f09_lines_off_invalid(spark, d):
    scaled = lines(spark, d).select("building", "line", *[(c(n) / (24 if n[0] == "x" else 40)).alias(n) for n in ("x1", "y1", "x2", "y2")])
    valid = points(spark, d).groupBy(F.floor(c("z") / 40).cast("int").alias("row"), F.floor(c("y") / 24).cast("int").alias("col")).agg(F.count("*").alias("n")).where("n >= 4")
    return detect.off_invalid(scaled, valid, 14, 30).select("building", "line")


@query(f"WITH {POINTS_SQL}, g AS (SELECT {_GRID}, min(z) AS z FROM points WHERE cls IN ('signup', 'click') GROUP BY 1, 2), u AS (SELECT {_GRID}, max(z) AS z FROM points WHERE cls NOT IN ('signup', 'click') GROUP BY 1, 2), k AS (SELECT row, col FROM u JOIN g USING (row, col) WHERE g.z > 100), m AS (SELECT DISTINCT CAST(row + i AS INT) AS row, CAST(col + j AS INT) AS col FROM k, range(-1, 2) a(i), range(-1, 2) b(j) WHERE abs(i) + abs(j) <= 1) SELECT row, col, z FROM u ANTI JOIN m USING (row, col)")
def f15_power_lines(spark, d):
    g, u = cells.rasterize(ground(spark, d), *pixel(), "min").where("z > 100"), cells.rasterize(upper(spark, d), *pixel(), "max")
    return cells.without_shared(u, g, 1)


@query(f"WITH {POINTS_SQL}, h AS (SELECT {_GRID}, count(*) AS n FROM points WHERE cls = 'error' GROUP BY 1, 2) SELECT a.row, a.col FROM h a JOIN h b ON (a.row - b.row) ** 2 + (a.col - b.col) ** 2 <= 9 GROUP BY 1, 2 HAVING count(*) >= 8")
def a05_core_cells(spark, d):
    g = cells.rasterize(points(spark, d).where("cls = 'error'"), *pixel(), "max")
    return tiles.core(g, 3, 8, 16)


_PARTS = f"{POINTS_SQL}, cell AS (SELECT {_GRID}, max(z) AS z FROM points WHERE cls = 'error' AND z > 100 GROUP BY 1, 2), r AS (SELECT row, col, row * 5000 + col AS root FROM cell UNION SELECT n.row, n.col, r.root FROM r JOIN cell n ON abs(n.row - r.row) <= 1 AND abs(n.col - r.col) <= 1), comp AS (SELECT row, col, CAST(min(root) AS BIGINT) AS component FROM r GROUP BY row, col)"


def _parts(spark, d) -> tuple[DataFrame, DataFrame]:
    cell = cells.rasterize(points(spark, d).where("cls = 'error' and z > 100"), *pixel(), "max")
    return cell, tiles.components(cell, max(5000, extent(spark, d)[1]), 16)


@query(f"WITH RECURSIVE {_PARTS} SELECT component, count(*) AS area, round(avg(row), 6) AS row_mid, round(avg(col), 6) AS col_mid, min(row) AS row0, min(col) AS col0, max(row) AS row1, max(col) AS col1 FROM comp GROUP BY 1 HAVING count(*) >= 2")
def a07_component_facts(spark, d):
    return graph.component_facts(_parts(spark, d)[1], 2).select("component", "area", r6("row_mid"), r6("col_mid"), "row0", "col0", "row1", "col1")


@query(f"WITH RECURSIVE {_PARTS} SELECT DISTINCT row, col FROM comp WHERE component IN (SELECT component FROM comp JOIN cell USING (row, col) WHERE z > 150)")
def m04_propagation(spark, d):
    cell, named = _parts(spark, d)
    return graph.seeded(named, cell.where("z > 150"))


@query(f"WITH RECURSIVE {POINTS_SQL}, p AS (SELECT id, x, y FROM points WHERE cls = 'error' AND z > 200), near AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON abs(a.x - b.x) <= 6 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 6), r AS (SELECT id, id AS root FROM p UNION SELECT near.b, r.root FROM r JOIN near ON r.id = near.a) SELECT id, min(root) AS cluster FROM r GROUP BY id")
def m17_distance_clusters(spark, d):
    return graph.distance_clusters(points(spark, d).where("cls = 'error' and z > 200"), 6.0)


@query(f"WITH {POINTS_SQL}, h AS (SELECT {_GRID}, max(z) AS v FROM points GROUP BY 1, 2) SELECT a.row, a.col, a.v FROM h a JOIN h b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2, 3 HAVING a.v = max(b.v)")
def w06_wide_maxima(spark, d):
    return ordered.local_maxima(cells.rasterize(points(spark, d), *pixel(), "max").withColumnRenamed("z", "v"), 2).select("row", "col", "v")


@query(f"WITH {BOXES_SQL}, g AS (SELECT box, unnest(range(0, 30)) * 5 + 2.5::DOUBLE AS cx, x0, y0, x1, y1 FROM boxes), h AS (SELECT *, unnest(range(0, 30)) * 24 + 12.0::DOUBLE AS cy FROM g) SELECT box, CAST(floor(cy / 24) AS INT) AS row, CAST(floor(cx / 5) AS INT) AS col FROM h WHERE cx > x0 AND cx < x1 AND cy > y0 AND cy < y1")
def m23_polygon_cells(spark, d):
    ring = rings.make_ring((c("x0"), c("y0")), (c("x1"), c("y0")), (c("x1"), c("y1")), (c("x0"), c("y1")))
    return spatial.polygon_cells(boxes(spark, d).withColumn("ring", ring), "ring", 5.0, 24.0).select("box", "row", "col")


# --- joins of scenes --------------------------------------------------------------------------------------------------


@query("WITH a AS (SELECT CAST(regexp_extract(c_name, '(\\d+)$', 1) AS BIGINT) AS building FROM customer), b AS (SELECT CAST(regexp_extract(s_name, '(\\d+)$', 1) AS BIGINT) AS building FROM supplier), e AS (SELECT user_id AS building, count(*) AS n FROM events GROUP BY 1) SELECT building, n FROM a JOIN b USING (building) JOIN e USING (building)")
def j15_artifacts(spark, d):
    ids = lambda t, n: table(spark, d, t).select(scalar.trailing_number(c(n)).cast("long").alias("building"))
    n = table(spark, d, "events").groupBy(c("user_id").cast("long").alias("building")).agg(F.count("*").alias("n"))
    return ids("customer", "c_name").join(ids("supplier", "s_name"), "building").join(n, "building").select("building", "n")


@query(f"WITH {LINES_SQL}, g AS (SELECT building AS image, line AS id, x1, y1, x2, y2 FROM lines WHERE y1 < 20), p AS (SELECT building AS image, line AS other, x1 AS a, y1 AS b, x2 AS e, y2 AS f FROM lines WHERE y1 >= 20), m AS (SELECT image, id, other, sqrt((x1 - a) ** 2 + (y1 - b) ** 2) AS d1, sqrt((x2 - e) ** 2 + (y2 - f) ** 2) AS d2 FROM g JOIN p USING (image)), k AS (SELECT *, row_number() OVER (PARTITION BY image, id ORDER BY d1 + d2, other) AS r FROM m) SELECT image, id, other, round(d1 + d2, 4) AS d, d1 < 60 AND d2 < 60 AS matched FROM k WHERE r = 1")
def j22_nearest_match(spark, d):
    rows = lines(spark, d).withColumnsRenamed({"building": "image", "line": "id"})
    return detect.nearest_match(rows.where("y1 < 20"), rows.where("y1 >= 20"), 60.0).select("image", "id", "other", r4(c("d"), "d"), "matched")


def box_sides(spark, d) -> DataFrame:
    """The four sides of every box, each moved outwards by a few units at its ends; a strip of boxes is a building."""
    b = boxes(spark, d)
    sides = [("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x0", "y1", "x1", "y1"), ("x0", "y0", "x0", "y1")]
    over = c("box") % 3
    rows = [
        b.select(F.floor(c("box") / 5).cast("long").alias("building"), (c("box").cast("long") * 4 + i).alias("line"), *[(c(v) + (over if v[0] == ("x" if i % 2 == 0 else "y") and n in ("x2", "y2") else F.lit(0))).cast("double").alias(n) for v, n in zip(s, ("x1", "y1", "x2", "y2"))])
        for i, s in enumerate(sides)
    ]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


_CORNERS = f"{BOXES_SQL}, s AS (SELECT CAST(box // 5 AS BIGINT) AS building, CAST(box * 4 + i AS BIGINT) AS line, CASE WHEN i = 1 THEN x1 ELSE x0 END AS x1, CASE WHEN i = 2 THEN y1 ELSE y0 END AS y1, CASE WHEN i = 3 THEN x0 ELSE x1 END + CASE WHEN i % 2 = 0 THEN box % 3 ELSE 0 END AS x2, CASE WHEN i = 0 THEN y0 ELSE y1 END + CASE WHEN i % 2 = 1 THEN box % 3 ELSE 0 END AS y2 FROM boxes, range(0, 4) k(i)), p AS (SELECT h.building, least(h.line, v.line) AS a, greatest(h.line, v.line) AS b, v.x1 AS x, h.y1 AS y, h.x1 AS hx1, h.x2 AS hx2, v.y1 AS vy1, v.y2 AS vy2 FROM s h JOIN s v ON h.building = v.building AND h.line % 2 = 0 AND v.line % 2 = 1), m AS (SELECT *, hx2 - hx1 AS lh, vy2 - vy1 AS lv, least(abs(x - hx1), abs(x - hx2)) AS nh, greatest(abs(x - hx1), abs(x - hx2)) AS fh, least(abs(y - vy1), abs(y - vy2)) AS nv, greatest(abs(y - vy1), abs(y - vy2)) AS fv, abs(x - hx1) <= abs(x - hx2) AS east, abs(y - vy1) <= abs(y - vy2) AS north FROM p), k AS (SELECT building, a, b, round(x, 4) AS x, round(y, 4) AS y, CASE WHEN east AND north THEN 0 WHEN NOT east AND north THEN 1 WHEN NOT east THEN 2 ELSE 3 END AS kind FROM m WHERE ((fh >= lh AND nh <= lh * 0.1) OR (fh <= lh AND nh <= lh * 0.3)) AND ((fv >= lv AND nv <= lv * 0.1) OR (fv <= lv AND nv <= lv * 0.3)))"


@query(f"WITH {_CORNERS} SELECT * FROM k")
def f16_corners(spark, d):
    return detect.corners(box_sides(spark, d), "building").select("building", "a", "b", r4(c("x"), "x"), r4(c("y"), "y"), "kind")


@query(f"WITH {_CORNERS}, u AS (SELECT building, a, b FROM k UNION ALL SELECT building, b, a FROM k) SELECT p.building, p.a AS l0, p.b AS l1, q.b AS l2, r.b AS l3 FROM u p JOIN u q ON p.building = q.building AND p.b = q.a JOIN u r ON r.building = q.building AND q.b = r.a JOIN u s ON s.building = r.building AND r.b = s.a AND s.b = p.a WHERE p.a < p.b AND q.b > p.a AND q.b <> p.b AND r.b > p.b AND r.b <> q.b")
def j17_squares(spark, d):
    return detect.squares(detect.corners(box_sides(spark, d), "building"), "building")


@query()
def m24_squares(spark, d):
    s = detect.scored_squares(detect.corners(box_sides(spark, d), "building"), "building")
    return s.select("building", "l01", "l12", "l23", "l30", *[r4(c(n), n) for n in ("overlap", "degree", "length", "area", "center", "score")])


@query()
def t05_best_squares(spark, d):
    s = detect.scored_squares(detect.corners(box_sides(spark, d), "building"), "building")
    order = [F.desc("score"), *[c(n) for n in ("l01", "l12", "l23", "l30")]]
    return ordered.top_k(s, 1, order, ("building",)).select("building", "l01", "l12", "l23", "l30", r4(c("score"), "score"))


@query()
def m24_predicted_squares(spark, d):
    """Squares of the sides of boxes after collinear ones were merged."""
    s = detect.predicted_squares(box_sides(spark, d), "building", 4.0, 4.0, 1)
    return s.select("building", "l01", "l12", "l23", "l30", *[r4(c(n), n) for n in ("overlap", "degree", "length", "area", "center", "score")])


# --- kernels ----------------------------------------------------------------------------------------------------------


@query()
def j12_seams(spark, d):
    pairs, _ = tiles.seams(_parts(spark, d)[1], 10, 10, 4, 2)
    return pairs


@query()
def m08_bridges(spark, d):
    return tiles.seams(_parts(spark, d)[1], 10, 10, 4, 2)[1]


@query()
def m09_clusters(spark, d):
    """Components joined over the seams, with their bridge cells."""
    named = graph.cut(_parts(spark, d)[1])
    return tiles.seam_clusters(named, *tiles.seams(named, 10, 10, 4, 2))


@query()
def m02_ground(spark, d):
    g = cells.rasterize(points(spark, d), *pixel(), "min")
    x, y = last(spark, d)
    return tiles.ground(g, 512, (int(y // 24) + 1, int(x // 5) + 1)).select("row", "col", r4(c("z"), "z"))


@query(f"WITH {BOXES_SQL} SELECT CAST(box // 5 AS BIGINT) AS building, count(*) AS faces, sum((x1 - x0) * (y1 - y0)) AS area FROM boxes GROUP BY 1")
def m16_faces(spark, d):
    """The sides of a strip of boxes bound its boxes again."""
    f = tiles.faces(box_sides(spark, d), "building")
    return f.groupBy("building").agg(F.count("*").alias("faces"), F.round(F.sum(rings.area2(c("ring")) / 2), 6).alias("area"))


@query(f"WITH {BOXES_SQL} SELECT CAST(box // 5 AS BIGINT) AS building, 1::BIGINT AS outlines, sum((x1 - x0) * (y1 - y0)) AS area FROM boxes GROUP BY 1")
def a32_dissolve(spark, d):
    b = boxes(spark, d).withColumn("building", F.floor(c("box") / 5).cast("long"))
    return tiles.dissolved(b, "building").groupBy("building").agg(F.count("*").alias("outlines"), F.sum(rings.area2(c("ring")) / 2).alias("area"))


@query()
def a11_alpha_coverage(spark, d):
    inside = spatial.points_in_boxes(points(spark, d), boxes(spark, d), 30.0, 144.0)
    return tiles.alpha_coverage(inside).select("box", "n", r6("coverage"))


@query()
def a11b_alpha_choice(spark, d):
    inside = spatial.points_in_boxes(points(spark, d), boxes(spark, d), 30.0, 144.0)
    return tiles.alpha_coverage(inside, shares=(0.55, 0.65, 0.75, 0.85, 0.92)).select("box", "n", r6("coverage"), r6("alpha"))


@query()
def m22_pruned_boxes(spark, d):
    """Coverage is that of the alpha shape for a fixed alpha. On the smallest tables points fill no more than half a box."""
    inside = spatial.points_in_boxes(points(spark, d), boxes(spark, d), 30.0, 144.0)
    b = tiles.alpha_coverage(inside, alpha=0.1).withColumn("building", F.floor(c("box") / 5).cast("long"))
    return tiles.pruned(b, "building", least=0.3)


# --- samples and scene files ------------------------------------------------------------------------------------------


@query(f"WITH {POINTS_SQL} SELECT cls, count(*) AS n, CAST(sum(CAST(r % 7 = 1 AS INT)) AS BIGINT) AS shown FROM (SELECT cls, row_number() OVER (PARTITION BY cls ORDER BY id) AS r FROM points) GROUP BY cls")
def t08_stride_sample(spark, d):
    shown = ordered.every_nth(points(spark, d), 7, ("cls",)).groupBy("cls").agg(F.count("*").alias("shown"))
    return points(spark, d).groupBy("cls").agg(F.count("*").alias("n")).join(shown, "cls").select("cls", "n", "shown")


@query("SELECT doc_id, CASE WHEN substr(md5(CAST(doc_id AS VARCHAR) || ':42'), 1, 4) < 'cccc' THEN 'train' ELSE 'test' END AS side FROM documents")
def t09_split(spark, d):
    return table(spark, d, "documents").select("doc_id", ordered.side_of(c("doc_id"), 42).alias("side"))


@query(f"WITH {BOXES_SQL} SELECT CAST(box // 5 AS BIGINT) AS scene, '[' || string_agg(printf('{{\"box\":%d,\"area\":%.1f}}', box, (x1 - x0) * (y1 - y0)), ',' ORDER BY box) || ']' AS json FROM boxes GROUP BY 1")
def s15_metrics_json(spark, d):
    m = boxes(spark, d).select(F.floor(c("box") / 5).cast("long").alias("scene"), "box", ((c("x1") - c("x0")) * (c("y1") - c("y0"))).alias("area"))
    return files.metrics_json(m, "scene", "box")


@query(f"WITH {BOXES_SQL}, t AS (SELECT box, printf('%.1f', x0) AS a, printf('%.1f', y0) AS b, printf('%.1f', x1) AS c, printf('%.1f', y1) AS d FROM boxes) SELECT box AS building, 'Building ' || box || ' Expanded Convex Hull: [[' || a || ', ' || b || '], [' || c || ', ' || b || '], [' || c || ', ' || d || '], [' || a || ', ' || d || '], [' || a || ', ' || b || ']]' AS value FROM t")
def s20_hull_text(spark, d):
    ring = rings.make_ring((c("x0"), c("y0")), (c("x1"), c("y0")), (c("x1"), c("y1")), (c("x0"), c("y1")))
    return files.hull_text(boxes(spark, d).select(c("box").alias("building"), ring.alias("ring")))


@query("SELECT n_nationkey AS part, CASE WHEN n_regionkey % 2 = 0 THEN n_regionkey + 1.5 ELSE 0.5 END::DOUBLE AS dx, CASE WHEN n_regionkey % 2 = 0 THEN 2.5 ELSE 0.25 END::DOUBLE AS dy FROM nation")
def s23_side_input(spark, d):
    items = table(spark, d, "nation").select(c("n_regionkey").alias("tag"), c("n_nationkey").alias("part"))
    stats = items.where("tag % 2 = 0").select("tag", "part", (c("tag") + 1.5).alias("dx"), F.lit(2.5).alias("dy"))
    return files.with_spacing(items, stats, 0.5, 0.25).select("part", "dx", "dy")


@query(f"WITH {BOXES_SQL} SELECT CAST(box AS VARCHAR) AS filename, CAST(k AS INT) AS line, CASE WHEN k = 0 THEN x0 ELSE x1 END AS x1, y0 AS y1, x1 AS x2, CASE WHEN k = 0 THEN y0 ELSE y1 END AS y2 FROM boxes, range(0, 2) r(k)")
def s24_annotations(spark, d):
    told = boxes(spark, d).select(c("box").cast("string").alias("filename"), F.to_json(F.array(F.array("x0", "y0", "x1", "y0"), F.array("x1", "y0", "x1", "y1"))).alias("raw"))
    return files.wireframe_lines(told.select("filename", F.from_json("raw", "array<array<double>>").alias("lines")))


@query("SELECT regexp_extract(c_name, '(\\d+)$', 1) AS stem, 'img/' || regexp_extract(c_name, '(\\d+)$', 1) || '.png' AS image, 'mask/' || regexp_extract(c_name, '(\\d+)$', 1) || '.tif' AS mask FROM customer WHERE regexp_extract(c_name, '(\\d+)$', 1) IN (SELECT regexp_extract(s_name, '(\\d+)$', 1) FROM supplier)")
def s25_image_pairs(spark, d):
    path = lambda t, n, a, b: table(spark, d, t).select(F.concat(F.lit(a), scalar.trailing_number(c(n)), F.lit(b)).alias("path"))
    return files.image_pairs(path("customer", "c_name", "img/", ".png"), path("supplier", "s_name", "mask/", ".tif"))
