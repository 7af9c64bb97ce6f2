import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.operators import cells, solids
from plumbline.plans.queries import KNOBS
from plumbline.sources import las
from plumbline.streaming.cells import stream_cell_histogram


def cloud(n=500):
    rng = np.random.default_rng(0)
    return pd.DataFrame({"x": rng.random(n) * 100, "y": rng.random(n) * 50 + 1e5, "z": rng.random(n) * 9, "classification": rng.integers(0, 32, n), "return_number": rng.integers(0, 8, n), "withheld": rng.random(n) < 0.5})


def test_las_round_trip(spark, tmp_path):
    points = cloud()
    (tmp_path / "a.las").write_bytes(las.encode(points))
    got = las.read_las(spark, str(tmp_path)).orderBy("point_id").toPandas()
    assert np.allclose(got[["x", "y", "z"]], points[["x", "y", "z"]], atol=6e-4) and (got["classification"] == points["classification"]).all() and (got["withheld"] == points["withheld"]).all()
    assert [len(p) for p in las.decode(las.encode(points), 200)] == [200, 200, 100] and not list(las.decode(las.encode(points[:0])))
    files = las.las_files(spark.createDataFrame(points).withColumn("b", (F.col("x") > 50).cast("int")), "b").collect()
    assert sum(r["n"] for r in files) == len(points) and sum(len(p) for r in files for p in las.decode(bytes(r["content"]))) == len(points)


def test_npy(spark, tmp_path):
    grid = np.array([[1.0, np.nan], [np.nan, 4.0]], "f4")
    np.save(tmp_path / "ground_part_3.npy", grid)
    assert sorted(map(tuple, las.read_npy(spark, str(tmp_path)).drop("file").collect())) == [(3, 0, 0, 1.0), (3, 1, 1, 4.0)]


def test_stream_equals_batch(spark, tmp_path):
    points = spark.createDataFrame(cloud()).select("x", F.col("y") - 1e5, "z").toDF("x", "y", "z")
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_cell_histogram(stream, KNOBS, "cells_seen").awaitTermination(60)
    assert sorted(map(tuple, spark.table("cells_seen").collect())) == sorted(map(tuple, cells.cell_histogram(points, KNOBS).collect()))


def test_unit_prism_texts(spark, tmp_path):
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    df = spark.createDataFrame([(7, 0, [{"x": x, "y": y} for x, y in ring], 0.0, 2.5)], "building long, part int, ring array<struct<x:double,y:double>>, zmin double, z double")
    lines = solids.obj_text(solids.extrude(df)).first()["obj"].split("\n")
    assert lines[:2] == ["v 0.000000 0.000000 0.000000", "v 1.000000 0.000000 0.000000"] and lines[8:16] == lines[:8]
    assert lines[16:] == ["f 1 2 3 4", "f 5 6 7 8", "f 1 2 6 5", "f 2 3 7 6", "f 3 4 8 7", "f 4 1 5 8"]
    solids.write_city_model(solids.extrude(df), str(tmp_path / "gml"))
    text = "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "gml")).collect())
    assert text.startswith("<?xml") and text.endswith("</core:CityModel>") and "<gml:upperCorner>1.000000 1.000000 2.500000<" in text
    assert ">0 1 0 1 1 0 1 0 0 0 0 0 0 1 0<" in text and text.count("xlink:href") == 6
    import xml.etree.ElementTree as tree

    assert tree.fromstring(text.replace('<?xml version="1.0" encoding="UTF-8"?>', "")).tag.endswith("CityModel")
