"""Results written as partitioned files and as text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.functions import geo


def write_by_cell(df: DataFrame, path: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Compressed JSON lines per 1 degree cell of the start point; returns (cell, count)."""
    celled = df.withColumn("cell", geo.cell_1deg(lat, lon))
    celled.write.mode("overwrite").partitionBy("cell").option("compression", "gzip").json(path)
    return cell_index(celled)


def cell_index(celled: DataFrame) -> DataFrame:
    return celled.groupBy("cell").agg(F.count(F.lit(1)).alias("count"))


def _number(c: Column) -> Column:
    return F.round(c, 6)


def challenge_features(items: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """One GeoJSON feature per item as (item_id, feature); null and empty properties are left out.

    Locations have lat and lon, routes their pieces in ``lines``; a feature is one line of text,
    so its coordinates are gathered per piece first and per item then."""
    props = F.struct(F.col("name"), *[F.nullif(F.col(c), F.lit("")).alias(c) for c in ("subtitle", "icon", "url", "difficulty") if c in items.columns])
    if lines is None:
        shape = F.struct(F.lit("Point").alias("type"), F.array(_number(F.col("lon")), _number(F.col("lat"))).alias("coordinates"))
        base = items
    else:
        piece = (lines.groupBy("item_id", "piece").agg(F.array_sort(F.collect_list(F.struct("seq", F.array(F.round("lon", 5), F.round("lat", 5)).alias("p")))).alias("s"))
                 .withColumn("c", F.transform("s", lambda q: q["p"])).filter(F.size("c") >= 2))
        whole = piece.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("piece", "c"))), lambda q: q["c"]).alias("pieces"))
        base = items.join(whole, "item_id")
        single = F.to_json(F.struct(F.lit("LineString").alias("type"), F.col("pieces")[0].alias("coordinates")))
        many = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.col("pieces").alias("coordinates")))
    text = F.to_json(shape) if lines is None else F.when(F.size("pieces") == 1, single).otherwise(many)
    feature = F.concat(F.lit('{"type":"Feature","id":"'), F.col("item_id").cast("string"), F.lit('","geometry":'), text, F.lit(',"properties":'), F.to_json(props, {"ignoreNullFields": "true"}), F.lit("}"))
    return base.select("item_id", feature.alias("feature"))


# Titles of route networks.
NETWORKS = {"lcn": "Local route", "rcn": "Regional route", "ncn": "National route", "icn": "International route"}


def route_subtitle(network, ascent) -> Column:
    names = F.create_map(*[F.lit(v) for pair in NETWORKS.items() for v in pair])
    title = F.coalesce(F.try_element_at(names, geo._c(network)), F.lit("MTB route"))
    return F.concat_ws(" · ", title, F.when(geo._c(ascent) >= 1, F.format_string("%.0f m climbing", F.rint(geo._c(ascent)))))


def ferry_subtitle(name, origin, target, operator) -> Column:
    name, origin, target, operator = map(geo._c, (name, origin, target, operator))
    return F.concat_ws(" · ", F.when((name != "") & (origin != "") & (target != "") & (origin != target), F.concat(origin, F.lit(" – "), target)), F.nullif(operator, F.lit("")))


def grade_name(grade) -> Column:
    return F.when(geo._c(grade).between(0, 3), F.element_at(F.array(*map(F.lit, fa.GRADE_NAMES)), (geo._c(grade) + 1).cast("int")))


def write_challenge(features: DataFrame, header_json: str, path: str, header: str = "challenge", parts: int = 8, order: str = "item_id") -> None:
    """A folder of part files that make one GeoJSON document when read by name: the head, a feature per
    line in ``order``, and the end. Every part is written by its own task."""
    spark = features.sparkSession
    ends = spark.createDataFrame([(0, '{"type":"FeatureCollection","%s":%s,"features":[' % (header, header_json)), (2, "]}")], "side INT, text STRING")
    rows = features.select(F.lit(1).alias("side"), F.col(order).cast("string").alias("key"), F.col("feature").alias("text"))
    # A comma stands before every feature but the first.
    first = features.agg(F.min(F.col(order).cast("string"))).head()[0]
    commas = rows.select("side", "key", F.concat(F.when(F.col("key") == first, "").otherwise(","), "text").alias("text"))
    every = commas.unionByName(ends.select("side", F.lit(None).cast("string").alias("key"), "text"))
    every.repartitionByRange(parts, "side", "key").sortWithinPartitions("side", "key").select("text").write.mode("overwrite").text(path)


def _escaped(c: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def gpx_lines(routes: DataFrame, points: DataFrame, stops: DataFrame | None = None, creator: str = "wayfold") -> DataFrame:
    """GPX 1.1 documents as ordered lines (route_id, part, seq, line).

    Routes have (route_id, name, created_ts). Lines stay rows, so a long route is never one value."""
    name = _escaped(F.col("name"))
    at = F.format_string('lat="%.6f" lon="%.6f"', "lat", "lon")

    def row(part, seq, line):
        return F.struct(F.lit(part).alias("part"), F.lit(seq).alias("seq"), (line if isinstance(line, Column) else F.lit(line)).alias("line"))

    created = F.date_format("created_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    frame = [row(0, 0, '<?xml version="1.0" encoding="UTF-8"?>'), row(0, 1, f'<gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1">'),
             row(0, 2, F.concat(F.lit("  <metadata><name>"), name, F.lit("</name><time>"), created, F.lit("</time></metadata>"))),
             row(2, 0, "  <trk>"), row(2, 1, F.concat(F.lit("    <name>"), name, F.lit("</name>"))), row(2, 2, "    <type>cycling</type>"), row(2, 3, "    <trkseg>"),
             row(4, 0, "    </trkseg>"), row(4, 1, "  </trk>"), row(4, 2, "</gpx>")]
    heads = routes.select("route_id", F.explode(F.array(*frame)).alias("l"))
    out = heads.select("route_id", "l.part", "l.seq", "l.line").unionByName(
        points.select("route_id", F.lit(3).alias("part"), F.col("seq").cast("int").alias("seq"), F.concat(F.lit("      <trkpt "), at, F.lit("/>")).alias("line")))
    if stops is not None:
        out = out.unionByName(stops.select("route_id", F.lit(1).alias("part"), F.col("seq").cast("int").alias("seq"), F.concat(F.lit("  <wpt "), at, F.lit("><name>"), _escaped(F.col("name")), F.lit("</name></wpt>")).alias("line")))
    return out


def write_gpx(lines: DataFrame, path: str) -> None:
    """One text file per route: rows of a route are sorted within their task while writing."""
    (lines.repartition("route_id").sortWithinPartitions("route_id", "part", "seq").select("route_id", "line")
     .write.mode("overwrite").partitionBy("route_id").text(path))


def write_gpx_bundles(lines: DataFrame, path: str) -> None:
    """All routes in a few large text files, one whole document after another.

    A file a route costs some file system calls each, which for many short routes outweigh the rest;
    ``gpx.read_gpx`` reads both (``bundled``)."""
    lines.repartition("route_id").sortWithinPartitions("route_id", "part", "seq").select("line").write.mode("overwrite").text(path)


# Fixed value: columns of tiles that make a file of a snapshot; few athletes have more than one.
SNAPSHOT_COLUMNS = 1024


def snapshot_tiles(tiles: DataFrame, path: str) -> DataFrame:
    """Rewrites an athlete's visited tiles only where they changed; returns the changed athletes.

    Both sets are compared tile by tile; only partitions with a difference are overwritten."""
    spark: SparkSession = tiles.sparkSession
    now = tiles.select("athlete_id", "tile_key").distinct()
    changed = now.select("athlete_id")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        stored = spark.read.schema("tile_key BIGINT, athlete_id BIGINT").parquet(path)
        sides = now.withColumn("side", F.lit(1)).unionByName(stored.select("athlete_id", "tile_key").withColumn("side", F.lit(2)))
        changed = sides.groupBy("athlete_id", "tile_key").agg(F.sum("side").alias("sides")).filter("sides <> 3").select("athlete_id").join(now.select("athlete_id").distinct(), "athlete_id", "left_semi")
    from wayfold.session import cut
    changed = cut(changed.distinct())
    (now.join(changed, "athlete_id", "left_semi").repartition("athlete_id", F.floor(geo.key_x("tile_key") / SNAPSHOT_COLUMNS)).sortWithinPartitions("athlete_id", "tile_key")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("athlete_id").parquet(path))
    return changed
