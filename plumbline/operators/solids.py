"""Prisms from rings and heights, and their text formats, as expressions on arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rings import counter_clockwise, position_list, without_collinear


def extrude(df: DataFrame, ring: str = "ring", bottom: str = "zmin", roof: str = "z", degrees: float = 5.0) -> DataFrame:
    """``df`` with the cleaned ring (collinear vertices gone, counter-clockwise)."""
    return df.withColumn(ring, counter_clockwise(without_collinear(F.col(ring), degrees))).withColumn("n_vertices", F.size(ring)).where(F.col("n_vertices") >= 3)


def _pair(ring: Column, i: Column) -> tuple[Column, Column]:
    return F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))


def walls(ring: Column, bottom: Column, roof: Column, order: str = "gml") -> Column:
    """One quad per edge as array<struct<x, y, z>>: gml goes bottom, bottom, roof, roof; json goes roof, bottom, bottom, roof."""
    point = lambda p, z: F.struct(p["x"].alias("x"), p["y"].alias("y"), z.alias("z"))

    def quad(i: Column) -> Column:
        p, q = _pair(ring, i)
        return F.array(point(p, bottom), point(q, bottom), point(q, roof), point(p, roof)) if order == "gml" else F.array(point(p, roof), point(p, bottom), point(q, bottom), point(q, roof))

    return F.transform(F.sequence(F.lit(0), F.size(ring) - 1), quad)


def obj_text(df: DataFrame, building: str = "building", ring: str = "ring", bottom: str = "zmin", roof: str = "z", order: str = "part") -> DataFrame:
    """(building, obj): vertices of all parts, their corners once more, then faces counted from 1."""
    n = F.size(ring)
    before = F.coalesce(F.sum(2 * n).over(Window.partitionBy(building).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    parts = df.withColumn("base__", before)
    line = lambda z: lambda p: F.format_string("v %.6f %.6f %.6f", p["x"], p["y"], z)
    vertices = F.concat(F.transform(ring, line(F.col(bottom))), F.transform(ring, line(F.col(roof))))
    index = F.sequence(F.lit(1), n)
    face = lambda xs: F.concat(F.lit("f "), F.array_join(F.transform(xs, lambda v: v.cast("string")), " "))
    low, high = F.transform(index, lambda i: i + F.col("base__")), F.transform(index, lambda i: i + F.col("base__") + n)
    side = F.transform(index, lambda i: face(F.array(i + F.col("base__"), i % n + 1 + F.col("base__"), i % n + 1 + F.col("base__") + n, i + F.col("base__") + n)))
    faces = F.concat(F.array(face(low)), F.array(face(high)), side)
    told = parts.select(building, F.struct(F.col(order).alias("o"), vertices.alias("v"), faces.alias("f")).alias("p"))
    whole = told.groupBy(building).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    vs, fs = F.flatten(F.transform("ps", lambda p: p["v"])), F.flatten(F.transform("ps", lambda p: p["f"]))
    return whole.select(building, F.array_join(F.concat(vs, vs, fs), "\n").alias("obj"))


def named_mesh(df: DataFrame, building: str = "building", ring: str = "ring", bottom: str = "zmin", roof: str = "z", order: str = "part", width: int = 8) -> DataFrame:
    """(building, vertex, name, x, y, z): distinct vertices (to six decimals) numbered in the order first seen."""
    n = F.size(ring)
    point = lambda z: lambda p, i: F.struct(F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"), F.round(z, 6).alias("z"))
    parts = df.select(building, F.col(order).alias("o"), F.posexplode(F.concat(F.transform(ring, point(F.col(bottom))), F.transform(ring, point(F.col(roof))))).alias("i", "p"))
    seen = parts.groupBy(building, "p.x", "p.y", "p.z").agg(F.min(F.struct("o", "i")).alias("first"))
    k = F.row_number().over(Window.partitionBy(building).orderBy("first"))
    return seen.withColumn("vertex", k).select(building, "vertex", F.concat(F.lit("V"), F.lpad(F.col("vertex").cast("string"), width, "0")).alias("name"), "x", "y", "z")


def envelope(df: DataFrame, ring: str = "ring", bottom: str = "zmin", roof: str = "z", keys: tuple[str, ...] = ()) -> DataFrame:
    p = df.select(*keys, F.explode(ring).alias("p"), F.col(bottom).alias("b__"), F.col(roof).alias("r__"))
    return p.groupBy(*keys).agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.min("b__").alias("z0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"), F.max("r__").alias("z1"))


def citygml(df: DataFrame, srs: str = "EPSG::0", building: str = "building", ring: str = "ring", bottom: str = "zmin", roof: str = "z", order: str = "part") -> DataFrame:
    """(building, xml): a building element with ground (reversed ring), roof and wall surfaces and a solid of links."""
    closed = lambda quad: F.array_join(F.transform(F.concat(quad, F.slice(quad, 1, 1)), lambda p: F.concat_ws(" ", *[_num(p[c]) for c in "xyz"])), " ")
    from plumbline.functions.scalar import short_number as _num

    def surface(kind: str, name: Column, positions: Column) -> Column:
        return F.concat(
            F.lit(f"<bldg:boundedBy><bldg:{kind}><bldg:lod2MultiSurface><gml:MultiSurface><gml:surfaceMember><gml:Polygon gml:id=\""), name,
            F.lit('"><gml:exterior><gml:LinearRing><gml:posList srsDimension="3">'), positions,
            F.lit(f"</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod2MultiSurface></bldg:{kind}></bldg:boundedBy>"),
        )

    stem = F.concat(F.lit("b"), F.col(building).cast("string"), F.lit("_p"), F.col(order).cast("string"))
    name = lambda tag: F.concat(stem, F.lit(f"_{tag}"))
    sides = walls(F.col(ring), F.col(bottom), F.col(roof))
    side_name = lambda i: F.concat(stem, F.lit("_wall"), i.cast("string"))
    texts = F.concat(
        F.array(surface("GroundSurface", name("ground"), position_list(F.reverse(F.col(ring)), F.col(bottom))), surface("RoofSurface", name("roof"), position_list(F.col(ring), F.col(roof)))),
        F.transform(sides, lambda q, i: surface("WallSurface", side_name(i), closed(q))),
    )
    links = F.concat(F.array(name("ground"), name("roof")), F.transform(sides, lambda q, i: side_name(i)))
    link = F.array_join(F.transform(links, lambda x: F.concat(F.lit('<gml:surfaceMember xlink:href="#'), x, F.lit('"/>'))), "")
    solid = F.concat(F.lit("<bldg:lod2Solid><gml:Solid><gml:exterior><gml:CompositeSurface>"), link, F.lit("</gml:CompositeSurface></gml:exterior></gml:Solid></bldg:lod2Solid>"))
    parts = df.select(building, F.struct(F.col(order).alias("o"), F.concat(F.array_join(texts, ""), solid).alias("t")).alias("p"))
    whole = parts.groupBy(building).agg(F.sort_array(F.collect_list("p")).alias("ps"))
    body = F.array_join(F.transform("ps", lambda p: p["t"]), "")
    return whole.select(building, F.concat(F.lit('<core:cityObjectMember><bldg:Building gml:id="b'), F.col(building).cast("string"), F.lit('">'), body, F.lit("</bldg:Building></core:cityObjectMember>")).alias("xml"))


def write_city_model(df: DataFrame, path: str, srs: str = "EPSG::0", **names: str) -> None:
    """One text file: the model with a common envelope and one building a line, in order of their ids."""
    keys = names.get("building", "building")
    e = envelope(df).first()
    corner = lambda c: " ".join(f"{e[k + c]:.6f}" for k in "xyz")
    head = (
        '<?xml version="1.0" encoding="UTF-8"?><core:CityModel xmlns:core="http://www.opengis.net/citygml/2.0" xmlns:bldg="http://www.opengis.net/citygml/building/2.0" '
        'xmlns:gml="http://www.opengis.net/gml" xmlns:xlink="http://www.w3.org/1999/xlink"><gml:boundedBy>'
        f'<gml:Envelope srsName="{srs}" srsDimension="3"><gml:lowerCorner>{corner("0")}</gml:lowerCorner><gml:upperCorner>{corner("1")}</gml:upperCorner></gml:Envelope></gml:boundedBy>'
    )
    spark = df.sparkSession
    rows = citygml(df, srs, **names).select(F.lit(1).alias("k"), F.col(keys).cast("long").alias("b"), "xml")
    edge = spark.range(2).select((F.col("id") * 2).cast("int").alias("k"), F.lit(0).cast("long").alias("b"), F.when(F.col("id") == 0, head).otherwise("</core:CityModel>").alias("xml"))
    rows.union(edge).orderBy("k", "b").coalesce(1).select("xml").write.mode("overwrite").text(path)
