"""Scalar expressions: pixel coordinates, angles, lines, ids and numbers as text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dequantize(stored: Column, scale: float, offset: float) -> Column:
    return stored * F.lit(scale) + F.lit(offset)


def requantize(value: Column, scale: float, offset: float) -> Column:
    return ((value - F.lit(offset)) / F.lit(scale)).cast("int")


def affine_inverse(a: float, b: float, c: float, d: float, e: float, f: float) -> tuple[float, ...]:
    """The inverse of x' = a x + b y + c, y' = d x + e y + f."""
    det = a * e - b * d
    if det == 0:
        raise ValueError("the affine has no inverse")
    return e / det, -b / det, (b * f - c * e) / det, -d / det, a / det, (c * d - a * f) / det


def geo_to_pixel(x: Column, y: Column, inverse: tuple[float, ...], how: str = "floor") -> tuple[Column, Column]:
    """(row, col) by the inverse affine; how: floor, trunc (towards zero) or float (no rounding)."""
    a, b, c, d, e, f = inverse
    col, row = x * a + y * b + c, x * d + y * e + f
    if how == "float":
        return row, col
    make = (lambda v: F.floor(v).cast("int")) if how == "floor" else (lambda v: v.cast("int"))
    return make(row), make(col)


def pixel_to_geo(col: Column, row: Column, affine: tuple[float, ...]) -> tuple[Column, Column]:
    a, b, c, d, e, f = affine
    return col * a + row * b + c, col * d + row * e + f


def north_up_pixel(x: Column, y: Column, left: float, top: float, dx: float, dy: float) -> tuple[Column, Column]:
    return F.floor((F.lit(top) - y) / dy).cast("int"), F.floor((x - F.lit(left)) / dx).cast("int")


def linear_index(row: Column, col: Column, width: int) -> Column:
    return row.cast("long") * F.lit(width) + col


def cell(value: Column, origin: float, size: float) -> Column:
    return F.floor((value - F.lit(origin)) / F.lit(size)).cast("int")


def pixel_size(a: float, b: float, d: float, e: float) -> float:
    """Mean of the two axes' lengths; the longer one if the other is 0."""
    x, y = (a * a + b * b) ** 0.5, (d * d + e * e) ** 0.5
    return max(x, y) if x == 0 or y == 0 else (x + y) / 2


def line_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def line_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))


def angle_bin(angle: Column) -> Column:
    return F.pmod(F.floor(angle).cast("int"), F.lit(180))


def angle_difference(a: Column, b: Column) -> Column:
    d = F.abs(a - b) % 180
    return F.least(d, F.lit(180) - d)


def rotate(cx: Column, cy: Column, x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    s, c = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    return cx + (x - cx) * c - (y - cy) * s, cy + (x - cx) * s + (y - cy) * c


def extend_line(x1: Column, y1: Column, x2: Column, y2: Column, length: float = 20_000.0) -> tuple[Column, ...]:
    """Both ends moved outwards along the line; a line of no length stays."""
    n = F.hypot(x2 - x1, y2 - y1)
    ux, uy = F.when(n > 0, (x2 - x1) / n).otherwise(0.0), F.when(n > 0, (y2 - y1) / n).otherwise(0.0)
    return x1 - ux * length, y1 - uy * length, x2 + ux * length, y2 + uy * length


def support_weight(ratio: Column) -> Column:
    return F.pow(F.lit(0.25) + F.lit(0.75) * ratio, F.lit(2.0))


def support_params(spacing: Column) -> tuple[Column, Column, Column]:
    """(soft radius, hard radius, step along the line) for a median point spacing."""
    soft = F.least(F.greatest(spacing * 1.75, F.lit(5.0)), F.lit(12.0))
    return soft, F.least(F.lit(24.0), soft * 2), F.greatest(F.lit(2.0), soft * 0.75)


def trailing_number(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d+)$", 1)


def srs_name(epsg: Column, text: Column) -> Column:
    return F.coalesce(F.concat(F.lit("urn:ogc:def:crs:EPSG::"), epsg.cast("string")), text, F.lit("EPSG::0"))


def short_number(value: Column) -> Column:
    """Six decimals without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", value), "0+$", ""), r"\.$", "")


def stretch(value: Column, low: Column, high: Column) -> Column:
    """Contrast between two percentiles, clipped to 0..255."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), (value - low) / F.greatest(high - low, F.lit(1e-6)) * 255.0))


def dice(both: Column, a: Column, b: Column, smooth: float = 1.0) -> Column:
    return (both * 2.0 + smooth) / (a + b + smooth)


def bbox_gap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Chebyshev distance of two boxes; 0 if they meet."""
    zero = F.lit(0.0)
    return F.greatest(F.greatest(bx0 - ax1, ax0 - bx1, zero), F.greatest(by0 - ay1, ay0 - by1, zero))


def bbox_overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1, grow: float = 0.0) -> Column:
    """Area shared by two boxes, each grown by ``grow`` on every side."""
    w = F.least(ax1, bx1) - F.greatest(ax0, bx0) + 2 * grow
    h = F.least(ay1, by1) - F.greatest(ay0, by0) + 2 * grow
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def suspicion(gain: Column, raw: Column, edge: Column, threshold: float) -> Column:
    return gain * 2 + F.greatest(F.lit(0.0), F.lit(threshold) - raw) + edge * 0.5


def vector_angle(ux: Column, uy: Column, vx: Column, vy: Column) -> Column:
    """Radians between two vectors; pi if one has no length."""
    n = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    return F.when(n < 1e-12, F.lit(math.pi)).otherwise(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (ux * vx + uy * vy) / n))))


def midpoint(a: Column, b: Column, whole: bool = False) -> Column:
    return F.floor((a + b) / 2) if whole else (a + b) / 2


def rescale(value: Column, source: float, target: float, whole: bool = False) -> Column:
    """A coordinate on a map of another size; ``whole`` truncates."""
    out = value * (target / source)
    return out.cast("int") if whole else out


def nearest_center(angle: Column, centers: list[float]) -> Column:
    """Index of the center that is nearest modulo 180, the lowest of equals."""
    gaps = F.array(*[angle_difference(angle, F.lit(float(c))) for c in centers])
    return (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")


def splat_pixels(q75: Column, pixel: float, tag: Column, factor: float = 0.75, least: int = 2, most: int = 5) -> Column:
    """Pixels to splat by; only clouds tagged non_ground are splatted."""
    wide = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(q75 * factor / pixel).cast("int")))
    return F.when(F.contains(tag, F.lit("non_ground")), wide).otherwise(0)


def learning_rate(step: Column, base: float, milestones: list[int], gamma: float = 0.1, warmup_factor: float = 1 / 3, warmup_steps: int = 500) -> Column:
    """Linear warm-up, then a factor ``gamma`` at every milestone that is reached."""
    part = step / F.lit(warmup_steps)
    warm = F.when(step < warmup_steps, (1 - part) * warmup_factor + part).otherwise(1.0)
    reached = sum(((step >= m).cast("int") for m in milestones), F.lit(0))
    return warm * base * F.pow(F.lit(gamma), reached)


def focal_loss(logit: str, truth: str, alpha: float = 2.0, beta: float = 4.0) -> Column:
    """Aggregate: focal loss of logits against truths in [0, 1], over the number of truths that are 1 if there are any."""
    p, t = 1 / (1 + F.exp(-F.col(logit))), F.col(truth)
    pos, neg = F.when(t == 1, F.log(p) * F.pow(1 - p, F.lit(alpha))), F.when(t < 1, F.log(1 - p) * F.pow(p, F.lit(alpha)) * F.pow(1 - t, F.lit(beta)))
    zero, ones = F.lit(0.0), F.count(F.when(t == 1, 1))
    return -(F.coalesce(F.sum(pos), zero) + F.coalesce(F.sum(neg), zero)) / F.greatest(ones, F.lit(1))


def weighted_bce(logit: str, truth: str, positive: float = 1.0, negative: float = 30.0) -> Column:
    """Aggregate: binary cross-entropy of logits, averaged apart over truths that are not 0 and those that are."""
    z, t = F.col(logit), F.col(truth)
    loss = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
    mean = lambda c: F.coalesce(F.sum(F.when(c, loss)), F.lit(0.0)) / (F.count(F.when(c, 1)) + 1e-5)
    return mean(t != 0) * positive + mean(t == 0) * negative


def smooth_l1(predicted: Column, truth: Column, beta: float = 1.0) -> Column:
    """Squared below ``beta``, linear beyond."""
    d = F.abs(predicted - truth)
    return F.when(d < beta, 0.5 * d * d / beta).otherwise(d - 0.5 * beta)


def crop_window(x0: Column, y0: Column, x1: Column, y1: Column, affine: tuple[float, ...], height: int, width: int) -> Column:
    """struct<row, col, height, width, c, f> of the part of a raster that holds a rectangle; c and f are the new origin.

    The affine is x' = a col + b row + c, y' = d col + e row + f; the window is cut to the raster and null outside it.
    """
    inverse = affine_inverse(*affine)
    corners = [geo_to_pixel(x, y, inverse, "float") for x in (x0, x1) for y in (y0, y1)]
    low = lambda k, most: F.greatest(F.lit(0), F.least(F.lit(most), F.floor(F.least(*[p[k] for p in corners])))).cast("int")
    high = lambda k, most: F.greatest(F.lit(0), F.least(F.lit(most), F.ceil(F.greatest(*[p[k] for p in corners])))).cast("int")
    row, col, last_row, last_col = low(0, height), low(1, width), high(0, height), high(1, width)
    left, top = pixel_to_geo(col, row, affine)
    return F.when((last_row > row) & (last_col > col), F.struct(row.alias("row"), col.alias("col"), (last_row - row).alias("height"), (last_col - col).alias("width"), left.alias("c"), top.alias("f")))
