"""Boundary collections, road pieces and named places from GeoJSON exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.sources import collections

# The road classes climbs are looked for on, in order, and the named places used.
ROAD_CLASSES = ["trunk", "primary", "secondary", "tertiary", "unclassified", "residential", "living_street", "cycleway"]
PLACE_KINDS = ["city", "town", "village", "hamlet"]


def first_value(value: Column) -> Column:
    """The first entry of a value exported as a list (or as the list's text)."""
    listed = F.regexp_extract(value, r"""^\[\s*["']?([^"',\]]*)""", 1)
    return F.when(value.startswith("["), F.nullif(listed, F.lit(""))).otherwise(value)


def read_regions(spark: SparkSession, path: str, country: str, code_field: str, name_fields: list[str]) -> DataFrame:
    """Ring points (code, name, feature_id, ordinal, poly, ring, seq, lat, lon) of a collection.

    Codes get the country in front, names fall back along ``name_fields`` to the code, heights and
    the closing point of each ring are dropped."""
    fields = ", ".join(f"`{f}`: STRING" for f in dict.fromkeys([code_field, *name_fields]))
    schema = f"properties STRUCT<{fields}>, geometry STRUCT<type: STRING, coordinates: STRING>"
    feats = collections.read(spark, path).features.select(F.col("pos").alias("feature_id"), F.from_json("feature", schema).alias("f"))
    code = first_value(F.col(f"f.properties.`{code_field}`"))
    names = [first_value(F.col(f"f.properties.`{n}`")) for n in name_fields]
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polys = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    rings = (feats.select("feature_id", F.concat(F.lit(f"{country}:"), code).alias("code"), F.coalesce(*names, code).alias("name"), F.posexplode(polys).alias("poly", "p"))
             .select("feature_id", "code", "name", "poly", F.posexplode("p").alias("ring", "r")))
    opened = F.when(F.element_at("r", -1) == F.element_at("r", 1), F.slice("r", 1, F.size("r") - 1)).otherwise(F.col("r"))
    return (rings.select("feature_id", "code", "name", "poly", "ring", F.posexplode(opened).alias("seq", "q"))
            .select("feature_id", "code", "name", F.col("feature_id").alias("ordinal"), "poly", "ring", "seq", F.col("q")[1].alias("lat"), F.col("q")[0].alias("lon")))


ROADS = ("properties STRUCT<id: STRING, highway: STRING, ref: STRING, name: STRING, bicycle: STRING, motorroad: STRING, access: STRING, bridge: STRING, tunnel: STRING, `@id`: BIGINT, place: STRING>, "
         "geometry STRUCT<type: STRING, coordinates: STRING>, id STRING")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Newline (or record separator) GeoJSON features as structs."""
    text = spark.read.text(path).select(F.regexp_replace("value", "^\u001e", "").alias("t")).filter(F.trim("t") != "")
    return text.select(F.from_json("t", ROADS).alias("f")).select("f.*")


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """Road points (way_id, key, class, name, seq, lat, lon, flat) without roads closed to bikes."""
    p = F.col("properties")

    def is_not(field, *values):
        return ~F.coalesce(p[field].isin(*values), F.lit(False))

    open_ = _lines(spark, path).filter(is_not("bicycle", "no") & is_not("motorroad", "yes") & is_not("access", "no", "private") & (F.col("geometry.type") == "LineString"))
    flat = (F.coalesce(p["bridge"], F.lit("no")) != "no") | (F.coalesce(p["tunnel"], F.lit("no")) != "no")
    level = F.array_position(F.array(*map(F.lit, ROAD_CLASSES)), p["highway"]) - 1
    return (open_.select(F.coalesce(p["@id"].cast("string"), "id").alias("way_id"), F.coalesce(F.nullif(p["ref"], F.lit("")), F.nullif(p["name"], F.lit(""))).alias("key"),
                         F.coalesce(F.when(level >= 0, level), F.lit(-1)).cast("int").alias("class"), F.nullif(p["name"], F.lit("")).alias("name"), flat.alias("flat"),
                         F.posexplode(F.from_json("geometry.coordinates", "array<array<double>>")).alias("seq", "c"))
            .select("way_id", "key", "class", "name", "seq", F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon"), "flat"))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Named cities, towns, villages and hamlets (name, kind, lat, lon)."""
    at = F.from_json("geometry.coordinates", "array<double>")
    return (_lines(spark, path).filter((F.col("geometry.type") == "Point") & F.col("properties.place").isin(PLACE_KINDS) & (F.col("properties.name") != ""))
            .select(F.col("properties.name").alias("name"), F.col("properties.place").alias("kind"), at[1].alias("lat"), at[0].alias("lon")))
