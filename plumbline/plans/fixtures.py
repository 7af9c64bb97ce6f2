"""Spatial views over the relational tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, x (user), y (hours), z (value), cls (event type)."""
    hours = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 3600.0
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("double").alias("x"), hours.alias("y"), F.col("value").alias("z"), F.col("event_type").alias("cls"))


def last(spark: SparkSession, sf_dir: str) -> tuple[float, float]:
    """The largest x and y of the points; -1 without any."""
    r = points(spark, sf_dir).agg(F.max("x"), F.max("y")).first()
    return tuple(-1.0 if v is None else float(v) for v in r)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles that share edges: box, x0, y0, x1, y1. Blocks of 5 x 5 stand side by side until they hold all points."""
    k, i = F.col("n_nationkey"), F.col("block__")
    across, up = (max(1, int(v // side) + 1) for v, side in zip(last(spark, sf_dir), (150, 720), strict=True))
    blocks = table(spark, sf_dir, "nation").withColumn("block__", F.explode(F.sequence(F.lit(0), F.lit(across * up - 1))))
    out = blocks.select((k + 25 * i).cast("int").alias("box"), (F.floor(k / 5) * 30.0 + i % across * 150).alias("x0"), ((k % 5) * 144.0 + F.floor(i / across) * 720).alias("y0"))
    return out.select("box", "x0", "y0", (F.col("x0") + 30).alias("x1"), (F.col("y0") + 144).alias("y1"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of a user as segments: building, line, x1, y1, x2, y2."""
    from pyspark.sql import Window

    w = Window.partitionBy("x").orderBy("y", "id")
    p = points(spark, sf_dir).select("id", "x", "y", "z", F.lead("y").over(w).alias("y2"), F.lead("z").over(w).alias("z2"))
    return p.where("y2 is not null").select(F.col("x").cast("long").alias("building"), F.col("id").alias("line"), F.col("y").alias("x1"), F.col("z").alias("y1"), F.col("y2").alias("x2"), F.col("z2").alias("y2"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, score, tp, flagged."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lab.join(d.select("doc_id", "n_chars"), "doc_id").select(F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("tp"), F.col("toxic").alias("flagged"))


POINTS_SQL = "points AS (SELECT event_id AS id, CAST(user_id AS DOUBLE) AS x, date_sub('second', TIMESTAMP '2024-01-01', ts) / 3600.0 AS y, value AS z, event_type AS cls FROM events)"
BOXES_SQL = "boxes AS (SELECT n_nationkey AS box, (n_nationkey // 5) * 30.0::DOUBLE AS x0, (n_nationkey % 5) * 144.0::DOUBLE AS y0, (n_nationkey // 5) * 30.0::DOUBLE + 30 AS x1, (n_nationkey % 5) * 144.0::DOUBLE + 144 AS y1 FROM nation)"
LINES_SQL = f"{POINTS_SQL}, lines AS (SELECT * FROM (SELECT CAST(x AS BIGINT) AS building, id AS line, y AS x1, z AS y1, lead(y) OVER w AS x2, lead(z) OVER w AS y2 FROM points WINDOW w AS (PARTITION BY x ORDER BY y, id)) WHERE x2 IS NOT NULL)"
DETECTIONS_SQL = "detections AS (SELECT doc_id AS id, CAST(n_chars AS DOUBLE) AS score, quality AS tp, toxic AS flagged FROM labels JOIN documents USING (doc_id))"
