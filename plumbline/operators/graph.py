"""Connected components and distance clusters, as joins on tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the folder of ``spark.checkpoint.dir``; a folder is made only in local sessions that name none."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        there = context.getConf().get("spark.checkpoint.dir")
        if there is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(there or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def connected(links: DataFrame) -> DataFrame:
    """(vertex, component) of undirected links (a, b): every vertex gets the smallest one that it reaches.

    Each round takes the neighbours' smallest name and then that name's own name, so that names travel twice as far
    every round. All of it stays in tables; the driver sees one count a round.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    named = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("vertex"), F.least("a", "b").alias("component")))
    while True:
        around = both.join(named, both["b"] == named["vertex"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = named.join(around, named["vertex"] == around["a"]).select("vertex", F.col("component").alias("before"), F.least("component", "near").alias("component"))
        far = named.select(F.col("vertex").alias("component"), F.col("component").alias("far"))
        new = cut(lower.join(far, "component").select("vertex", "before", F.least("component", "far").alias("component")))
        named = new.select("vertex", "component")
        if new.where("component <> before").isEmpty():
            return named


def distance_clusters(points: DataFrame, eps: float) -> DataFrame:
    """(id, cluster): points linked by steps of at most ``eps``; a cluster is named by its smallest id.

    Cells are so small that all points of one are linked, so only pairs of points in different cells are compared,
    and only cells enter the graph.
    """
    side = eps / 2**0.5 * (1 - 1e-9)
    at = points.select("id", "x", "y", F.floor(F.col("x") / side).cast("long").alias("i"), F.floor(F.col("y") / side).cast("long").alias("j"))
    cells = at.groupBy("i", "j").agg(F.min("id").alias("cell"))
    at = cut(at.join(cells, ["i", "j"]))
    # Half of the 24 neighbours: the other half is met from the other side.
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(0, 3) for b in range(-2, 3) if (a, b) > (0, 0)])
    left = at.withColumn("s", F.explode(steps)).select("cell", "x", "y", (F.col("i") + F.col("s.a")).alias("i"), (F.col("j") + F.col("s.b")).alias("j"))
    right = at.select("i", "j", F.col("cell").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)) <= eps
    links = left.join(right, ["i", "j"]).where(near).select(F.col("cell").alias("a"), F.col("other").alias("b")).distinct()
    named = connected(links).withColumnRenamed("vertex", "cell")
    return at.join(named, "cell", "left").select("id", F.coalesce("component", "cell").alias("cluster"))


def seeded(components: DataFrame, core: DataFrame) -> DataFrame:
    """Cells of the components (row, col, component) that hold a core cell, with the core cells themselves."""
    live = components.join(core.select("row", "col"), ["row", "col"], "left_semi").select("component").distinct()
    return components.join(live, "component", "left_semi").select("row", "col").union(core.select("row", "col")).distinct()


def component_facts(components: DataFrame, least: int = 1) -> DataFrame:
    """(component): area, centroid and bounds of the components of at least ``least`` cells."""
    c = F.col
    out = components.groupBy("component").agg(F.count("*").alias("area"), F.avg("row").alias("row_mid"), F.avg("col").alias("col_mid"), F.min("row").alias("row0"), F.min("col").alias("col0"), F.max("row").alias("row1"), F.max("col").alias("col1"))
    return out.where(c("area") >= least)
