"""Files around a scene: discovery, settings, side inputs, annotations, image pairs, and text, CSV and JSON sinks."""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_config(path: str | None = None) -> dict[str, Any]:
    """Settings from a YAML file, by default ``config.yaml`` in the working folder; a missing file raises."""
    import yaml

    path = path or os.path.join(os.getcwd(), "config.yaml")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def discover(spark: SparkSession, path: str, glob: str = "*", pattern: str = r"part_(\d+)") -> DataFrame:
    """(path, name, part, length) of the files under a folder of any store; part is null where the name has none.

    Names come from a listing; contents are not read.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    part = F.regexp_extract(name, pattern, 1)
    return found.select("path", name.alias("name"), F.when(part != "", part.cast("int")).alias("part"), "length")


def parts(files: DataFrame, default: int = 9) -> DataFrame:
    """The distinct part numbers, or 1..default if no file has one."""
    told = files.where("part is not null").select("part").distinct()
    return told if not told.isEmpty() else files.sparkSession.range(1, default + 1).select(F.col("id").cast("int").alias("part"))


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(tag, part, dx, dy) of files ``<tag>_part_<n>.stats.json``; files that cannot be read give null, as missing ones do
    in a left join."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.stats.json").text(path).select("value", F.col("_metadata.file_name").alias("name"))
    told = F.from_json("value", "est_spacing struct<dx: double, dy: double>")["est_spacing"]
    ok = told["dx"].isNotNull() & told["dy"].isNotNull()
    return files.select(F.regexp_extract("name", r"^(.*)_part_\d+", 1).alias("tag"), F.regexp_extract("name", r"part_(\d+)", 1).cast("int").alias("part"), F.when(ok, told["dx"]).alias("dx"), F.when(ok, told["dy"]).alias("dy"))


def with_spacing(items: DataFrame, stats: DataFrame, dx: float, dy: float, keys: tuple[str, ...] = ("tag", "part")) -> DataFrame:
    """``items`` with the spacing that their side input tells, else the given one."""
    return items.join(stats, list(keys), "left").withColumn("dx", F.coalesce("dx", F.lit(dx))).withColumn("dy", F.coalesce("dy", F.lit(dy)))


def wireframe_lines(annotations: DataFrame) -> DataFrame:
    """(filename, line, x1, y1, x2, y2) of annotations (filename, lines: array<array<double>>)."""
    told = annotations.select("filename", F.posexplode("lines").alias("line", "l"))
    return told.select("filename", "line", *[F.get("l", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


def polygon_rings(annotations: DataFrame) -> DataFrame:
    """(filename, region, ring) of annotations (filename, regions: array<struct<all_x, all_y>>)."""
    told = annotations.select("filename", F.posexplode("regions").alias("region", "r"))
    return told.select("filename", "region", F.zip_with("r.all_x", "r.all_y", lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))).alias("ring"))


def image_pairs(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(stem, image, mask): images and masks (path) whose names without folder and extension are the same."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return images.select(stem.alias("stem"), F.col("path").alias("image")).join(masks.select(stem.alias("stem"), F.col("path").alias("mask")), "stem")


def binary_mask(value: Column, white: bool = False) -> Column:
    """1 for a white pixel (``white``) or for any that is above 0."""
    return ((value == 255) if white else (value > 0)).cast("int")


def hull_text(hulls: DataFrame, key: str = "building") -> DataFrame:
    """(value): one line of text per building with the corners of its hull, the first one again at the end."""
    ring = F.concat("ring", F.slice("ring", 1, 1))
    points = F.array_join(F.transform(ring, lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(", "), p["y"].cast("string"), F.lit("]"))), ", ")
    return hulls.select(key, F.concat(F.lit("Building "), F.col(key).cast("string"), F.lit(" Expanded Convex Hull: ["), points, F.lit("]")).alias("value"))


def metrics_json(metrics: DataFrame, scene: str, order: str) -> DataFrame:
    """(scene, json): an array of each scene's metrics, in order."""
    rest = [c for c in metrics.columns if c != scene]
    rows = F.sort_array(F.collect_list(F.struct(order, *[c for c in rest if c != order])))
    return metrics.groupBy(scene).agg(F.to_json(rows).alias("json"))


def write_points_csv(points: DataFrame, path: str, building: str | None = None) -> None:
    """X, Y and Z with a header, one folder per building if its column is named."""
    out = points.select(*([building] if building else []), F.col("x").alias("X"), F.col("y").alias("Y"), F.col("z").alias("Z"))
    writer = out.write.option("header", True)
    (writer.partitionBy(building) if building else writer).csv(path)


_BOXES = "array<array<struct<x: double, y: double>>>"


def boxes_json(boxes: DataFrame, key: str, order: str = "box", ring: str = "ring") -> DataFrame:
    """(key, json): each group's rings as one JSON list of lists of {x, y}, in order."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ring).alias("r"))))
    return boxes.groupBy(key).agg(F.to_json(F.transform(rows, lambda r: r["r"])).alias("json"))


def parse_boxes(texts: DataFrame, key: str, json: str = "json") -> DataFrame:
    """(key, box, ring): the rings of JSON texts, numbered from 0. An empty list, or a text that is none, gives no rows."""
    return texts.select(key, F.posexplode(F.from_json(json, _BOXES)).alias("box", "ring"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(file, box, ring) of the ``*.json`` files of a folder; files without boxes give no rows."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("json"))
    return parse_boxes(files, "file")


def quarantine(points: DataFrame, key: str, least: int = 30_000) -> tuple[DataFrame, DataFrame]:
    """The points of groups with at least ``least`` points, and those of the others; nothing is moved or dropped."""
    few = points.groupBy(key).agg(F.count("*").alias("n__")).where(F.col("n__") < least).select(F.col(key).alias("few__"))
    return points.join(few, points[key].eqNullSafe(few["few__"]), "left_anti"), points.join(few, points[key].eqNullSafe(few["few__"]), "left_semi")


def validated_parts(parts: DataFrame, rows: int = 3, columns: int = 3) -> DataFrame:
    """``parts`` (part from 1 by rows, height, width) if all are there once, those of a row equally high and those of a column
    equally wide; else ValueError. It looks at no more than a few rows."""
    wanted = rows * columns
    told = parts.select("part", "height", "width").limit(wanted + 1).collect()
    numbers = sorted(r["part"] for r in told)
    if numbers != list(range(1, wanted + 1)):
        raise ValueError(f"parts 1 to {wanted} are needed once each, found {numbers}")
    for name, of in (("height", lambda p: (p - 1) // columns), ("width", lambda p: (p - 1) % columns)):
        sizes: dict[int, set[int]] = {}
        for r in told:
            sizes.setdefault(of(r["part"]), set()).add(r[name])
        if any(len(s) > 1 for s in sizes.values()):
            raise ValueError(f"parts beside each other differ in {name}")
    return parts


def write_clusters(cells: DataFrame, path: str) -> None:
    """Cluster cells (row, col, cluster) as Parquet, so that later steps read one cluster without the others."""
    cells.select("row", "col", "cluster").repartition("cluster").write.mode("overwrite").partitionBy("cluster").parquet(path)


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("row int, col int, cluster long").parquet(path)
