"""Point clouds in the public LAS layout, point formats 0 to 3, and arrays in NPY files."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points that leave a file's decoder at a time.
CHUNK = 2_000_000
_CORE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2"), ("bits", "u1"), ("classification", "u1"), ("angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
SCHEMA = "file string, point_id long, x double, y double, z double, intensity int, return_number int, num_returns int, scan_direction_flag boolean, edge_of_flight_line boolean, classification int, synthetic boolean, key_point boolean, withheld boolean, user_data int, point_source_id int"


def decode(content: bytes, chunk: int = CHUNK) -> Iterator[pd.DataFrame]:
    """Points of one file, ``chunk`` at a time; point_id is the place in the file."""
    if content[:4] != b"LASF":
        raise ValueError("not a LAS file")
    begin = struct.unpack_from("<I", content, 96)[0]
    size, n = struct.unpack_from("<HI", content, 105)
    scale, offset = struct.unpack_from("<3d", content, 131), struct.unpack_from("<3d", content, 155)
    kind = np.dtype({"names": [n for n, _ in _CORE], "formats": [f for _, f in _CORE], "offsets": [0, 4, 8, 12, 14, 15, 16, 17, 18], "itemsize": size})
    for a in range(0, n, chunk):
        p = np.frombuffer(content, kind, min(chunk, n - a), begin + a * size)
        xyz = {k: p[k.upper()] * scale[i] + offset[i] for i, k in enumerate("xyz")}
        bits, cls = p["bits"], p["classification"]
        yield pd.DataFrame(
            {"point_id": np.arange(a, a + len(p)), **xyz, "intensity": p["intensity"].astype("int32"), "return_number": (bits & 7).astype("int32"), "num_returns": (bits >> 3 & 7).astype("int32"),
             "scan_direction_flag": (bits >> 6 & 1).astype(bool), "edge_of_flight_line": (bits >> 7).astype(bool), "classification": (cls & 31).astype("int32"), "synthetic": (cls >> 5 & 1).astype(bool),
             "key_point": (cls >> 6 & 1).astype(bool), "withheld": (cls >> 7).astype(bool), "user_data": p["user_data"].astype("int32"), "point_source_id": p["point_source_id"].astype("int32")}
        )


def encode(points: pd.DataFrame, scale: tuple[float, float, float] = (0.001, 0.001, 0.001)) -> bytes:
    """A file of format 0 from x, y, z and whatever other attributes the frame has."""
    xyz = points[["x", "y", "z"]].to_numpy(float)
    offset = np.floor(xyz.min(0)) if len(xyz) else np.zeros(3)
    out = np.zeros(len(points), np.dtype(_CORE))
    for i, k in enumerate("XYZ"):
        out[k] = np.round((xyz[:, i] - offset[i]) / scale[i])
    get = lambda name: points[name].to_numpy().astype(np.int64) if name in points else np.zeros(len(points), np.int64)
    for name in ("intensity", "user_data", "point_source_id"):
        out[name] = get(name)
    out["bits"] = get("return_number") | get("num_returns") << 3 | get("scan_direction_flag") << 6 | get("edge_of_flight_line") << 7
    out["classification"] = get("classification") | get("synthetic") << 5 | get("key_point") << 6 | get("withheld") << 7
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes((1, 2))
    struct.pack_into("<HI", head, 94, 227, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, len(points))
    struct.pack_into("<3d3d", head, 131, *scale, *offset)
    low, high = (xyz.min(0), xyz.max(0)) if len(xyz) else (np.zeros(3), np.zeros(3))
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    return bytes(head) + out.tobytes()


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """All points of the files under ``path``, in any store that Spark reads. A file is read whole, so under 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for part in decode(content):
                    part.insert(0, "file", name)
                    yield part

    return files.mapInPandas(run, SCHEMA)


def las_files(points: DataFrame, key: str) -> DataFrame:
    """(key, n, content): one encoded file per building, to be written by any binary sink."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [len(pdf)], "content": [encode(pdf)]})

    return points.groupBy(key).applyInPandas(run, f"{key} {points.schema[key].dataType.simpleString()}, n long, content binary")


def npy_files(cells: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """(key, content): each group's cells (row, col, z) as a float32 array file, NaN where there is no cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((height, width), np.nan, np.float32)
        grid[pdf["row"], pdf["col"]] = pdf["z"]
        buffer = io.BytesIO()
        np.save(buffer, grid)
        return pd.DataFrame({key: pd.Series([pdf[key].iloc[0]], dtype=pdf[key].dtype), "content": [buffer.getvalue()]})

    return cells.select(key, "row", "col", "z").groupBy(key).applyInPandas(run, f"{key} {cells.schema[key].dataType.simpleString()}, content binary")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, row, col, z) of the finite cells of 2-D arrays; part is the number in ``part_<n>`` or null."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                grid = np.load(io.BytesIO(content), allow_pickle=False)
                i, j = np.nonzero(np.isfinite(grid))
                yield pd.DataFrame({"file": name, "row": i.astype("int32"), "col": j.astype("int32"), "z": grid[i, j].astype(float)})

    cells = files.mapInPandas(run, "file string, row int, col int, z double")
    part = F.regexp_extract("file", r"part_(\d+)", 1)
    return cells.select("file", F.when(part != "", part.cast("int")).alias("part"), "row", "col", "z")
