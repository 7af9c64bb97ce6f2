"""Line detection as tables: decoding of heat maps, intersections and squares, mosaics and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.graph import cut
from plumbline.operators.ordered import local_maxima, top_k


def decode_lines(heat: DataFrame, score: float = 0.10, length: float = 20.0, k: int = 200, scale: float = 2.0, keys: tuple[str, ...] = ("img",)) -> DataFrame:
    """Segments of a heat map (keys, row, col, v, dx0, dy0, dx1, dy1): the k best local maxima of the sigmoid whose
    score and length are large enough, in image coordinates; row and col are its cell."""
    s = heat.withColumn("v", 1 / (1 + F.exp(-F.col("v"))))
    best = top_k(local_maxima(s, 1, keys), k, [F.desc("v"), F.col("row"), F.col("col")], keys)
    at = lambda c, d: (F.col(c) + F.col(d)) * scale
    span = F.hypot(F.col("dx1") - F.col("dx0"), F.col("dy1") - F.col("dy0"))
    ends = [at("col", "dx0").alias("x1"), at("row", "dy0").alias("y1"), at("col", "dx1").alias("x2"), at("row", "dy1").alias("y2")]
    return best.where((F.col("v") > score) & (span > length)).select(*keys, F.col("v").alias("score"), *ends, "row", "col")


def training_lines(heat: DataFrame, score: float = 0.10, length: float = 2.0, k: int = 1000, keys: tuple[str, ...] = ("img",)) -> DataFrame:
    """``decode_lines`` as training does it: at the scale of the map, more and shorter lines, and beside each line the same one
    from its other end (sx1, sy1, sx2, sy2). row and col are the cell of its center."""
    c = F.col
    return decode_lines(heat, score, length, k, 1.0, keys).withColumns({"sx1": c("x2"), "sy1": c("y2"), "sx2": c("x1"), "sy2": c("y1")})


def intersections(lines: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, a, b, x, y): crossing points of all pairs of lines of a building, a < b; parallels have none.

    A building's lines come from a detector's top list, so the pairs of one building are few.
    """
    right = lines.select(key, F.col(line).alias("b"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")])
    p = lines.withColumnRenamed(line, "a").join(right, key).where("a < b")
    c = F.col
    a1, b1, a2, b2 = c("y2") - c("y1"), c("x1") - c("x2"), c("by2") - c("by1"), c("bx1") - c("bx2")
    c1, c2 = a1 * c("x1") + b1 * c("y1"), a2 * c("bx1") + b2 * c("by1")
    det = a1 * b2 - a2 * b1
    return p.where(F.abs(det) > 1e-9).select(key, "a", "b", ((b2 * c1 - b1 * c2) / det).alias("x"), ((a1 * c2 - a2 * c1) / det).alias("y"))


def normal_form(lines: DataFrame) -> DataFrame:
    """``lines`` with distance (of the line from the origin) and theta (degrees of its direction, from 0 to 180)."""
    c = F.col
    dx, dy = c("x1") - c("x2"), c("y1") - c("y2")
    theta = F.degrees(F.atan2(dx, dy))
    out = lines.withColumn("distance", F.abs(dy * c("x1") - dx * c("y1")) / F.sqrt(dy * dy + dx * dx + 1e-10))
    return out.withColumn("theta", F.when(theta < 0, theta + 180).otherwise(theta))


def hough(lines: DataFrame, d_step: float = 1.0, t_step: float = 2.0) -> DataFrame:
    """``lines`` with their cell (d, t) of the map of distances and directions."""
    out = normal_form(lines)
    return out.withColumn("d", F.floor(F.col("distance") / d_step).cast("int")).withColumn("t", F.floor(F.col("theta") / t_step).cast("int"))


def hough_cells(binned: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, d, t): how many lines a cell holds, and the first of them."""
    return binned.groupBy(key, "d", "t").agg(F.count("*").alias("n"), F.min(line).alias("first"))


def merged_lines(lines: DataFrame, key: str, d_step: float = 1.0, t_step: float = 2.0, reach: int = 2, k: int = 200) -> DataFrame:
    """(key, d, t, n, x1, y1, x2, y2): one line for each of the ``k`` fullest local maxima of the Hough map.

    It spans the ends of all lines in the cells within ``reach`` of the maximum, falling or rising as the maximum's first
    line does (falling from 90 degrees). Lines meet cells by equal cell numbers.
    """
    binned = cut(hough(lines, d_step, t_step))
    found = local_maxima(hough_cells(binned, key).withColumnsRenamed({"d": "row", "t": "col", "n": "v"}), reach, (key,))
    best = top_k(found, k, [F.desc("v"), F.col("row"), F.col("col")], (key,))
    span = F.sequence(F.lit(-reach), F.lit(reach))
    around = best.withColumn("i", F.explode(span)).withColumn("j", F.explode(span))
    around = around.select(key, "row", "col", "v", "first", (F.col("row") + F.col("i")).alias("d"), (F.col("col") + F.col("j")).alias("t"))
    low, high = (lambda v: F.min(F.least(f"{v}1", f"{v}2")).alias(f"{v}_low")), (lambda v: F.max(F.greatest(f"{v}1", f"{v}2")).alias(f"{v}_high"))
    theta = F.max(F.when(F.col("line") == F.col("first"), F.col("theta"))).alias("theta")
    out = around.join(binned, [key, "d", "t"]).groupBy(key, "row", "col", "v").agg(low("x"), high("x"), low("y"), high("y"), theta)
    falls = F.col("theta") >= 90
    ends = [F.when(falls, F.col("y_high")).otherwise(F.col("y_low")).alias("y1"), F.col("x_high").alias("x2"), F.when(falls, F.col("y_low")).otherwise(F.col("y_high")).alias("y2")]
    return out.select(key, F.col("row").alias("d"), F.col("col").alias("t"), F.col("v").alias("n"), F.col("x_low").alias("x1"), *ends)


def endpoint_distances(predicted: DataFrame, truth: DataFrame, key: str, line: str = "line") -> DataFrame:
    """(key, pred, gt, d): squared distances of the ends of every predicted and true line of an image, by the better of
    both orders of the ends. An image's lines come from a top list and are few."""
    other = truth.select(key, F.col(line).alias("gt"), *[F.col(v).alias(f"t{v}") for v in ("x1", "y1", "x2", "y2")])
    gap = lambda a, b: F.pow(F.col(f"x{a}") - F.col(f"tx{b}"), 2) + F.pow(F.col(f"y{a}") - F.col(f"ty{b}"), 2)
    both = predicted.withColumnRenamed(line, "pred").join(other, key)
    return both.select(key, "pred", "gt", F.least(gap(1, 1) + gap(2, 2), gap(1, 2) + gap(2, 1)).alias("d"))


def squares(corners: DataFrame, key: str) -> DataFrame:
    """(key, l0, l1, l2, l3): cycles of four corners, each of which shares one line with the next.

    A corner (key, a, b) is a meeting of two lines. Every cycle is told once: l0 is its smallest line, l1 < l3.
    """
    corners = cut(corners.select(key, "a", "b"))
    both = corners.union(corners.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
    step = lambda i: both.select(key, F.col("a").alias(f"l{i}"), F.col("b").alias(f"l{i + 1}"))
    chain = step(0).where("l0 < l1").join(step(1), [key, "l1"]).where("l2 > l0 and l2 <> l1").join(step(2), [key, "l2"]).where("l3 > l1 and l3 <> l2")
    last = both.select(key, F.col("a").alias("l3"), F.col("b").alias("l0"))
    return chain.join(last, [key, "l3", "l0"]).select(key, "l0", "l1", "l2", "l3")


def mosaic(tiles: DataFrame, width: int, height: int, threshold: int = 127, name: str = "name") -> DataFrame:
    """(row, col) of mask pixels above the threshold, from tiles named ``tile_<x>_<y>`` with (r, c, v) pixels.

    Names of another form are skipped, pixels outside the raster are cut.
    """
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    x, y = (F.regexp_extract(stem, r"^tile_(\d+)_(\d+)$", i) for i in (1, 2))
    told = tiles.where(stem.rlike(r"^tile_\d+_\d+$") & (F.col("v") > threshold))
    out = told.select((y.cast("int") + F.col("r")).alias("row"), (x.cast("int") + F.col("c")).alias("col"))
    return out.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).distinct()


def resample(cells: DataFrame, rows: Column, cols: Column, height: int, width: int, factor_row: float, factor_col: float) -> DataFrame:
    """Nearest resampling: every target cell (``rows`` and ``cols`` are arrays) takes its source cell's z, if there is one."""
    spark = cells.sparkSession
    target = spark.range(1).select(F.explode(rows).alias("row")).select("row", F.explode(cols).alias("col"))
    target = target.select("row", "col", F.floor((F.col("row") + 0.5) * factor_row).cast("int").alias("sr"), F.floor((F.col("col") + 0.5) * factor_col).cast("int").alias("sc"))
    source = cells.select(F.col("row").alias("sr"), F.col("col").alias("sc"), "z")
    return target.where(F.col("sr").between(0, height - 1) & F.col("sc").between(0, width - 1)).join(source, ["sr", "sc"]).select("row", "col", "z")


def edge_share(inside: DataFrame, band: float, key: str = "box") -> DataFrame:
    """Share of each box's points within ``band`` of its boundary; expects x, y, x0, y0, x1, y1."""
    c = F.col
    near = F.least(c("x") - c("x0"), c("x1") - c("x"), c("y") - c("y0"), c("y1") - c("y")) <= band
    return inside.groupBy(key).agg(F.count("*").alias("n"), F.avg(near.cast("double")).alias("edge"))


def stripe_size(cells: DataFrame, most: int = 31) -> DataFrame:
    """(horizontal, size): the median gap of occupied columns and rows, which way is wider, clamped to odd 5..most."""
    from pyspark.sql import Window

    def gap(column: str) -> DataFrame:
        v = cells.select(F.col(column).alias("v")).distinct()
        g = v.select((F.col("v") - F.lag("v").over(Window.orderBy("v"))).alias("g")).where("g is not null")
        return g.agg(F.coalesce(F.percentile("g", F.lit(0.5)), F.lit(1.0)).alias(f"d{column}"))

    both = gap("row").join(gap("col"), F.lit(True))
    size = F.greatest(F.lit(5), F.least(F.lit(most), F.round(F.greatest("drow", "dcol")).cast("int")))
    return both.select((F.col("dcol") >= F.col("drow")).alias("horizontal"), F.when(size % 2 == 0, size + 1).otherwise(size).alias("size"))


def off_invalid(lines: DataFrame, valid: DataFrame, height: int, width: int, most: int = 2, keys: tuple[str, ...] = ("building",)) -> DataFrame:
    """``lines`` that cross fewer than ``most`` pixels without a row in ``valid`` (row, col); pixels outside do not count.

    Ends are truncated to pixels, and a line's pixels are those of its longer axis, one a step.
    """
    c = F.col
    ends = lines.select(*keys, "line", *[c(v).cast("int").alias(v) for v in ("x1", "y1", "x2", "y2")])
    n = F.greatest(F.abs(c("x2") - c("x1")), F.abs(c("y2") - c("y1")))
    steps = ends.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), c("n"))))
    at = lambda a, b: F.when(c("n") == 0, c(a)).otherwise(c(a) + F.floor((2 * c("k") * (c(b) - c(a)) + c("n")) / (2 * c("n")))).cast("int")
    pixels = steps.select(*keys, "line", at("y1", "y2").alias("row"), at("x1", "x2").alias("col"))
    pixels = pixels.where(c("row").between(0, height - 1) & c("col").between(0, width - 1))
    bad = pixels.join(valid.select("row", "col").distinct(), ["row", "col"], "left_anti").groupBy(*keys, "line").agg(F.count("*").alias("bad"))
    return lines.join(bad.where(c("bad") >= most).select(*keys, "line"), [*keys, "line"], "left_anti")


def _reach(side: str, x: Column, y: Column) -> tuple[Column, ...]:
    """(length, nearer, farther, degrees) of a segment seen from a point; degrees lead to the farther end."""
    c = lambda n: F.col(f"{side}{n}")
    gap = lambda ax, ay, bx, by: F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    one, two = gap(c("x1"), c("y1"), x, y), gap(c("x2"), c("y2"), x, y)
    dx, dy = F.when(one > two, c("x1")).otherwise(c("x2")) - x, F.when(one > two, c("y1")).otherwise(c("y2")) - y
    return gap(c("x1"), c("y1"), c("x2"), c("y2")), F.least(one, two), F.greatest(one, two), F.pmod(F.degrees(F.atan2(dy, dx)) + 360, F.lit(360.0))


def corners(lines: DataFrame, key: str, outside: float = 0.1, inside: float = 0.3, line: str = "line") -> DataFrame:
    """Meetings of two lines of a building that look like a corner of a square: key, a, b, x, y, kind 0 to 3 and, for
    both lines, the length (la, lb), the distance to the nearer end (na, nb) and whether the corner lies beyond it.

    The directions must differ by 60 to 120 degrees. The corner may lie beyond a line's end by ``outside`` of its
    length or short of it by ``inside``. kind is the quadrant of the two directions; other corners are left out.
    """
    c = F.col
    met = intersections(lines, key, line)
    ends = ("x1", "y1", "x2", "y2")
    for side in "ab":
        met = met.join(lines.select(key, F.col(line).alias(side), *[c(e).alias(f"{side}{e}") for e in ends]), [key, side])
    along = lambda v, side: c(f"{side}{v}2") - c(f"{side}{v}1")
    span = lambda side: F.sqrt(along("x", side) * along("x", side) + along("y", side) * along("y", side))
    # 60 to 120 degrees whichever ends are seen. Filters on the measures below would be pushed into them and repeat them, so they are written first.
    met = met.where(F.abs(along("x", "a") * along("x", "b") + along("y", "a") * along("y", "b")) < (0.5 + 1e-6) * span("a") * span("b"))
    measures = {}
    for side in "ab":
        for n, v in zip("lnfd", _reach(side, c("x"), c("y"))):
            measures[f"{n}{side}"] = v
    met = cut(met.select(key, "a", "b", "x", "y", *[v.alias(n) for n, v in measures.items()]))
    turn = F.abs(c("da") - c("db"))
    turn = F.when(turn > 180, 360 - turn).otherwise(turn)
    fits = lambda s: ((c(f"f{s}") >= c(f"l{s}")) & (c(f"n{s}") <= c(f"l{s}") * outside)) | ((c(f"f{s}") <= c(f"l{s}")) & (c(f"n{s}") <= c(f"l{s}") * inside))
    low, high = F.least("da", "db"), F.greatest("da", "db")
    kind = (
        F.when((low.between(0, 45) & high.between(45, 120)) | ((high >= 315) & low.between(45, 120)), 0)
        .when(low.between(45, 125) & high.between(125, 225), 1)
        .when(low.between(125, 225) & high.between(225, 315), 2)
        .when((low.between(0, 45) & high.between(225, 315)) | ((high >= 315) & low.between(225, 315)), 3)
    )
    told = met.where((turn > 60) & (turn < 120) & fits("a") & fits("b")).withColumn("kind", kind).where("kind is not null")
    return told.select(key, "a", "b", "x", "y", "kind", "la", "na", (c("fa") > c("la")).alias("oa"), "lb", "nb", (c("fb") > c("lb")).alias("ob"))


#: The weights of a square's scores.
SQUARE_WEIGHTS = {"overlap": 0.0, "degree": 1.0, "area": 10.0, "center": 0.5, "length": 1.0}


def scored_squares(corners: DataFrame, key: str, size: float = 512.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(key, l01, l12, l23, l30, xs, ys, overlap, degree, length, area, center, score) of cycles of corners of kind
    0, 1, 2, 3, each of which shares one line with the next.

    overlap: share of the perimeter that lines cover, over the building's best; degree and length: likeness of opposite
    angles and sides; area over a quarter of size squared; center: distance of the square's own middle from the map's.
    """
    c, w = F.col, SQUARE_WEIGHTS | (weights or {})
    corners = cut(corners)
    turned = [("a", "b"), ("b", "a")]
    flat = None
    for p, q in turned:
        one = corners.select(key, "kind", c(p).alias("p"), c(q).alias("q"), "x", "y", *[c(f"{n}{s}").alias(f"{n}{t}") for s, t in ((p, "p"), (q, "q")) for n in "lno"])
        flat = one if flat is None else flat.union(one)
    part = lambda i: flat.where(c("kind") == i).select(key, *[c(n).alias(f"{n}{i}") for n in ("p", "q", "x", "y", "lp", "np", "op", "lq", "nq", "oq")])
    s = part(0)
    for i in (1, 2):
        nxt = part(i).withColumnRenamed(key, "key__")
        s = s.join(nxt, (c(key) == c("key__")) & (c(f"q{i - 1}") == c(f"p{i}"))).drop("key__")
    last = part(3).withColumnRenamed(key, "key__")
    s = s.join(last, (c(key) == c("key__")) & (c("q2") == c("p3")) & (c("q3") == c("p0"))).drop("key__")
    s = s.where(F.size(F.array_distinct(F.array("q0", "q1", "q2", "q3"))) == 4)
    # In steps, so that generated code stays small: first the sides, then what is made of them.
    steps: dict[str, Column] = {}
    for i in range(4):  # the side from corner i to the next lies on line q_i
        j = (i + 1) % 4
        own = [(c(f"oq{i}"), c(f"nq{i}")), (c(f"op{j}"), c(f"np{j}"))]
        steps[f"cover{i}"] = c(f"lq{i}") + sum((F.when(out, 0.0).otherwise(-near) for out, near in own), F.lit(0.0))
        steps[f"side{i}"] = c(f"lq{i}") + sum((F.when(out, near).otherwise(-near) for out, near in own), F.lit(0.0))
        steps[f"vx{i}"], steps[f"vy{i}"] = c(f"x{j}") - c(f"x{i}"), c(f"y{j}") - c(f"y{i}")
    s = s.withColumns(steps)
    s = s.withColumns({f"v{i}": F.sqrt(c(f"vx{i}") * c(f"vx{i}") + c(f"vy{i}") * c(f"vy{i}")) for i in range(4)})

    def angle(i: int) -> Column:
        h = (i - 1) % 4
        cos = -(c(f"vx{h}") * c(f"vx{i}") + c(f"vy{h}") * c(f"vy{i}")) / (c(f"v{h}") * c(f"v{i}") + 1e-10)
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos))))

    s = s.withColumns({f"angle{i}": angle(i) for i in range(4)})
    alike = lambda v, i: F.least(c(f"{v}{i}"), c(f"{v}{i + 2}")) / F.greatest(c(f"{v}{i}"), c(f"{v}{i + 2}"))
    total = lambda v: sum((c(f"{v}{i}") for i in range(4)), F.lit(0.0))
    area = sum((c(f"x{i}") * c(f"y{(i + 1) % 4}") - c(f"y{i}") * c(f"x{(i + 1) % 4}") for i in range(4)), F.lit(0.0))
    half = size / 2
    off = lambda v: total(v) / 4 - 128
    s = s.select(
        key, c("q0").alias("l01"), c("q1").alias("l12"), c("q2").alias("l23"), c("q3").alias("l30"), F.array(*[f"x{i}" for i in range(4)]).alias("xs"), F.array(*[f"y{i}" for i in range(4)]).alias("ys"),
        (total("cover") / total("side")).alias("overlap"), ((alike("angle", 0) + alike("angle", 1)) / 2).alias("degree"), ((alike("side", 0) + alike("side", 1)) / 2).alias("length"),
        (F.abs(area) * 0.5 / (half * half)).alias("area"), (F.sqrt(off("x") * off("x") + off("y") * off("y")) / (half / 2**0.5)).alias("center"),
    )
    s = cut(s)
    best = s.groupBy(key).agg(F.max("overlap").alias("best__"))
    s = s.join(best, key).withColumn("overlap", c("overlap") / c("best__")).drop("best__")
    score = c("overlap") * w["overlap"] + c("degree") * w["degree"] + c("area") * w["area"] - c("center") * w["center"] + c("length") * w["length"]
    return s.withColumn("score", score)


def predicted_squares(lines: DataFrame, key: str, d_step: float = 1.0, t_step: float = 2.0, reach: int = 2, k: int = 200, outside: float = 0.1, inside: float = 0.3, size: float = 512.0, weights: dict[str, float] | None = None) -> DataFrame:
    """The columns of ``scored_squares`` for lines that are merged on the Hough map before. A merged line is named by its cell:
    d * 1,000 + t. No more than ``k`` lines of a key reach the corners, which bounds their pairs."""
    merged = merged_lines(lines, key, d_step, t_step, reach, k)
    named = cut(merged.select(key, (F.col("d").cast("long") * 1000 + F.col("t")).alias("line"), "x1", "y1", "x2", "y2"))
    return scored_squares(corners(named, key, outside, inside), key, size, weights)


def nearest_match(left: DataFrame, right: DataFrame, threshold: float, key: str = "image") -> DataFrame:
    """Every left line (key, id, x1..y2) with the right line whose two ends lie nearest in sum, the smallest id of
    equals, and matched: both of those ends are nearer than the threshold. An image's lines are few."""
    ends = ("x1", "y1", "x2", "y2")
    r = right.select(key, F.col("id").alias("other"), *[F.col(e).alias(f"r{e}") for e in ends])
    gap = lambda i: F.sqrt((F.col(f"x{i}") - F.col(f"rx{i}")) * (F.col(f"x{i}") - F.col(f"rx{i}")) + (F.col(f"y{i}") - F.col(f"ry{i}")) * (F.col(f"y{i}") - F.col(f"ry{i}")))
    pairs = left.join(r, key).select(key, "id", "other", gap(1).alias("d1"), gap(2).alias("d2"))
    best = pairs.groupBy(key, "id").agg(F.min(F.struct((F.col("d1") + F.col("d2")).alias("d"), "other", "d1", "d2")).alias("m"))
    return best.select(key, "id", F.col("m.other").alias("other"), F.col("m.d").alias("d"), ((F.col("m.d1") < threshold) & (F.col("m.d2") < threshold)).alias("matched"))
