"""Expressions on rings: array<struct<x: double, y: double>> without a closing vertex."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.scalar import short_number


def make_ring(*points: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def _next(ring: Column) -> Column:
    return F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _previous(ring: Column) -> Column:
    return F.concat(F.slice(ring, -1, 1), F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))))


def area2(ring: Column) -> Column:
    """Twice the signed area; positive counter-clockwise; 0 for fewer than three vertices."""
    terms = F.zip_with(ring, _next(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(ring) >= 3, F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)).otherwise(0.0)


def counter_clockwise(ring: Column) -> Column:
    return F.when(area2(ring) <= 0, F.reverse(ring)).otherwise(ring)


def without_collinear(ring: Column, degrees: float = 5.0) -> Column:
    """Vertices whose turn against their first neighbours is at least ``degrees``; the ring itself if under 3 are left."""
    import math

    least = math.radians(degrees)
    zipped = F.arrays_zip(_previous(ring).alias("a"), ring.alias("b"), _next(ring).alias("c"))

    def turn(t: Column) -> Column:
        ux, uy = t["b"]["x"] - t["a"]["x"], t["b"]["y"] - t["a"]["y"]
        vx, vy = t["c"]["x"] - t["b"]["x"], t["c"]["y"] - t["b"]["y"]
        n = F.hypot(ux, uy) * F.hypot(vx, vy)
        return F.when(n < 1e-12, F.lit(math.pi)).otherwise(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ux * vx + uy * vy) / n))))

    kept = F.transform(F.filter(zipped, lambda t: turn(t) >= least), lambda t: t["b"])
    return F.when((F.size(ring) > 3) & (F.size(kept) >= 3), kept).otherwise(ring)


def contains_strictly(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside; points on an edge do not. Even-odd rule on half-open edges."""
    edges = F.arrays_zip(ring.alias("p"), _next(ring).alias("q"))

    def cross(e: Column) -> Column:
        return (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) - (e["q"]["y"] - e["p"]["y"]) * (x - e["p"]["x"])

    def on(e: Column) -> Column:
        within = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))
        return (cross(e) == 0) & within(x, e["p"]["x"], e["q"]["x"]) & within(y, e["p"]["y"], e["q"]["y"])

    def crossed(e: Column) -> Column:
        up = e["p"]["y"] <= y
        return (up != (e["q"]["y"] <= y)) & F.when(up, cross(e) > 0).otherwise(cross(e) < 0)

    return ~F.exists(edges, on) & (F.size(F.filter(edges, crossed)) % 2 == 1)


def centroid(ring: Column) -> Column:
    """struct<x, y>: the center of a ring's area; null without an area."""
    term = lambda v: F.aggregate(F.zip_with(ring, _next(ring), lambda p, q: (p[v] + q[v]) * (p["x"] * q["y"] - q["x"] * p["y"])), F.lit(0.0), lambda a, t: a + t)
    return F.when(area2(ring) != 0, F.struct((term("x") / (3 * area2(ring))).alias("x"), (term("y") / (3 * area2(ring))).alias("y")))


def edge_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance of a point from the nearest edge of a ring."""

    def away(p: Column, q: Column) -> Column:
        ux, uy = q["x"] - p["x"], q["y"] - p["y"]
        t = ((x - p["x"]) * ux + (y - p["y"]) * uy) / F.greatest(ux * ux + uy * uy, F.lit(1e-300))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
        return F.hypot(x - p["x"] - t * ux, y - p["y"] - t * uy)

    return F.array_min(F.zip_with(ring, _next(ring), away))


def is_valid(ring: Column) -> Column:
    """Whether a ring has an area and no two of its edges meet but neighbours at their common vertex."""
    edges = F.transform(F.arrays_zip(ring.alias("p"), _next(ring).alias("q")), lambda e, i: F.struct(e["p"].alias("p"), e["q"].alias("q"), i.alias("i")))
    turn = lambda a, b, c: F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))
    within = lambda a, b, c: c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
    on = lambda a, b, c: (turn(a, b, c) == 0) & within(a, b, c)

    def meet(e: Column, f: Column) -> Column:
        across = (turn(e["p"], e["q"], f["p"]) * turn(e["p"], e["q"], f["q"]) < 0) & (turn(f["p"], f["q"], e["p"]) * turn(f["p"], f["q"], e["q"]) < 0)
        return across | on(e["p"], e["q"], f["p"]) | on(e["p"], e["q"], f["q"]) | on(f["p"], f["q"], e["p"]) | on(f["p"], f["q"], e["q"])

    apart = lambda e, f: (f["i"] > e["i"] + 1) & ~((e["i"] == 0) & (f["i"] == F.size(ring) - 1))
    back = lambda e, f: (f["i"] == (e["i"] + 1) % F.size(ring)) & on(e["p"], e["q"], f["q"])
    crossed = F.exists(edges, lambda e: F.exists(edges, lambda f: (apart(e, f) & meet(e, f)) | back(e, f)))
    return (F.size(ring) >= 3) & (area2(ring) != 0) & ~crossed


def position_list(ring: Column, z: Column) -> Column:
    """``x y z`` of every vertex and, at the end, of the first one again."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.array_join(F.transform(closed, lambda p: F.concat_ws(" ", short_number(p["x"]), short_number(p["y"]), short_number(z))), " ")
