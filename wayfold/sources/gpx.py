"""GPX files as tables of points, waypoints and names; catalogues of trails by GPX file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "STRUCT<_lat: DOUBLE, _lon: DOUBLE, name: STRING>"
SCHEMA = (f"metadata STRUCT<name: STRING>, wpt ARRAY<{POINT}>, rte ARRAY<STRUCT<name: STRING, rtept: ARRAY<{POINT}>>>, "
          f"trk ARRAY<STRUCT<name: STRING, type: STRING, trkseg: ARRAY<STRUCT<trkpt: ARRAY<{POINT}>>>>>")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("xml").option("rowTag", "gpx").schema(SCHEMA).load(path)
            .withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))


def _read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """Files of one document after another, such as the sink's: cut at the closing tags, so one file is
    read by many tasks. ``file`` names the document: its file and a number."""
    texts = spark.read.option("lineSep", "</gpx>").text(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    numbered = texts.withColumn("start", F.locate("<gpx", F.col("value"))).withColumn("file", F.concat_ws("#", "file", F.monotonically_increasing_id().cast("string")))
    document = F.concat(F.substr("value", "start"), F.lit("</gpx>"))
    return numbered.filter("start > 0").withColumn("gpx", F.from_xml(document, SCHEMA)).select("gpx.*", "file")


def _points(groups: Column, pick) -> Column:
    points = F.flatten(F.transform(F.coalesce(groups, F.array()), lambda g: F.coalesce(pick(g), F.array())))
    return F.filter(points, lambda p: p["_lat"].isNotNull() & p["_lon"].isNotNull())


def read_gpx(spark: SparkSession, path: str, bundled: bool = False) -> tuple[DataFrame, DataFrame]:
    """(points, waypoints) of each file, or each document of ``bundled`` files: track points, else
    route points, else waypoints."""
    docs = _read_bundles(spark, path) if bundled else _read(spark, path)
    track = _points(F.col("trk"), lambda t: F.flatten(F.transform(t["trkseg"], lambda s: F.coalesce(s["trkpt"], F.array()))))
    route = _points(F.col("rte"), lambda r: r["rtept"])
    way = F.filter(F.coalesce("wpt", F.array()), lambda p: p["_lat"].isNotNull() & p["_lon"].isNotNull())
    names = F.filter(F.concat(F.array("metadata.name"), F.coalesce(F.col("rte.name"), F.array()), F.coalesce(F.col("trk.name"), F.array())), lambda n: F.trim(n) != "")
    chosen = F.when(F.size(track) > 0, track).when(F.size(route) > 0, route).otherwise(way)
    title = F.trim(F.get(names, F.lit(0)))
    points = docs.select("file", title.alias("name"), F.posexplode(chosen).alias("seq", "p")).select("file", "name", "seq", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"))
    waypoints = docs.select("file", F.posexplode(way).alias("seq", "p")).select("file", "seq", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon"), F.col("p.name").alias("name"))
    return points, waypoints


# The part of a trail's tracks that is its main route, and the least longest variant.
MAIN_ROUTE, LEAST_KM = "mainRoute", 5.0


def read_trails(spark: SparkSession, csv_path: str, gpx_path: str) -> tuple[DataFrame, DataFrame]:
    """(trails, points) of a CSV catalogue and its GPX files: catalogued files only, main routes
    only, and only trails whose longest variant exceeds 5 km."""
    rows = (spark.read.option("header", True).schema("name STRING, start STRING, lengths_km STRING, longest_km DOUBLE, lat DOUBLE, lon DOUBLE, url STRING, gpx STRING").csv(csv_path)
            .filter((F.col("longest_km") > LEAST_KM) & F.col("gpx").isNotNull()).withColumn("file", F.element_at(F.split("gpx", "/"), -1)))
    docs = _read(spark, gpx_path)
    main = docs.select("file", F.posexplode(F.filter("trk", lambda t: t["type"] == MAIN_ROUTE)).alias("trk_no", "t")).select("file", "trk_no", F.posexplode("t.trkseg").alias("seg_no", "s"))
    points = (main.select("file", F.col("trk_no").alias("piece"), "seg_no", F.posexplode("s.trkpt").alias("seq", "p")).join(rows.select("file"), "file", "left_semi")
              .select("file", "piece", "seg_no", "seq", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lon")))
    trails = rows.join(points.select("file").distinct(), "file", "left_semi").withColumn("lengths", F.transform(F.split("lengths_km", ","), lambda v: F.trim(v).cast("double")))
    return trails.drop("gpx", "lengths_km"), points
