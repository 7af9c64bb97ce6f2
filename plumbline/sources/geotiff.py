"""What a GeoTIFF says of itself: size, affine, bounds and coordinate system. Pixels are not decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the public format: tag numbers, bytes of each field type, and the keys of coordinate systems.
WIDTH, HEIGHT, SCALE, TIE, MATRIX, KEYS = 256, 257, 33550, 33922, 34264, 34735
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 12: "d", 16: "Q"}
_PROJECTED, _GEOGRAPHIC = 3072, 2048
SCHEMA = "path string, width int, height int, a double, b double, c double, d double, e double, f double, x0 double, y0 double, x1 double, y1 double, epsg int"


def describe(content: bytes) -> dict | None:
    """The first image's facts; None if the bytes are no TIFF. Without georeference the affine counts pixels."""
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or len(content) < 8 or struct.unpack_from(order + "H", content, 2)[0] != 42:
        return None
    at = struct.unpack_from(order + "I", content, 4)[0]
    tags: dict[int, tuple] = {}
    for i in range(struct.unpack_from(order + "H", content, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * i)
        if tag in (WIDTH, HEIGHT, SCALE, TIE, MATRIX, KEYS) and kind in _KINDS:
            form = f"{order}{n}{_KINDS[kind]}"
            place = at + 10 + 12 * i
            place = place if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", content, place)[0]
            tags[tag] = struct.unpack_from(form, content, place)
    if WIDTH not in tags or HEIGHT not in tags:
        return None
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    a, b, c, d, e, f = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0
    if MATRIX in tags:
        a, b, _, c, d, e, _, f = tags[MATRIX][:8]
    elif SCALE in tags and TIE in tags:
        (sx, sy), (col, row, _, x, y) = tags[SCALE][:2], tags[TIE][:5]
        a, e, c, f = sx, -sy, x - col * sx, y + row * sy
    keys = tags.get(KEYS, ())
    named = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    corners = [(a * i + b * j + c, d * i + e * j + f) for i in (0, width) for j in (0, height)]
    xs, ys = zip(*corners, strict=True)
    return {"width": width, "height": height, "a": a, "b": b, "c": c, "d": d, "e": e, "f": f, "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "epsg": named.get(_PROJECTED) or named.get(_GEOGRAPHIC)}


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``*.tif`` or ``*.tiff`` file of a folder of any store; files that are no TIFF are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff}").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            found = [{"path": p} | facts for p, content in zip(batch["path"], batch["content"], strict=True) if (facts := describe(content))]
            yield pd.DataFrame(found, columns=names).astype({"epsg": "Int32"})

    return files.mapInPandas(run, SCHEMA)
