"""From road pieces, named places and elevation to the list of climbs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import climbs, lines, nearby, polyline, profiles, tracks
from wayfold.session import cut

# Fixed value: metres by which climb lines are thinned.
LINE_TOLERANCE_M = 5.0


def climb_list(roads: DataFrame, elevation: DataFrame, places: DataFrame, rows_per_cell: int) -> DataFrame:
    """Climbs with id, name, place, category, metrics, ends and encoded line.

    Every stage that is read more than once is written to the shared checkpoint folder."""
    joined = cut(lines.stitch(cut(lines.chain(roads))))
    keys = joined.groupBy("way_id").agg(F.any_value("key").alias("key")).withColumnRenamed("way_id", "line_id")
    roads = joined.withColumnRenamed("way_id", "line_id")
    profile = profiles.profile(cut(profiles.gather(roads, "flat", "name")), elevation, rows_per_cell)
    found = cut(climbs.distinct_climbs(cut(climbs.metrics(profiles.find(profile))), ["line_id", "reverse", "start"]))
    at = [F.format_string("%.4f", c) for c in ("lat0", "lon0", "lat1", "lon1")]
    named = (found.join(keys, "line_id", "left")
             .withColumn("id", F.substring(F.sha1(F.concat_ws(",", *at)), 1, 10)).withColumn("name", F.coalesce("name", "key")))
    near = nearby.nearest_top_place(named.select("id", F.col("lat1").alias("lat"), F.col("lon1").alias("lon")).dropDuplicates(["id"]), places).withColumnRenamed("name", "place")
    shape = climbs._climb_samples(named.select("id", "line_id", "reverse", "size", "start", "top"), climbs.resample(roads), "lat", "lon").select("id", (F.col("j") - F.col("start")).alias("seq"), "lat", "lon")
    thin = tracks.reindex(tracks.simplify(cut(shape), LINE_TOLERANCE_M, ["id"]), ["id"])
    text = polyline.encode(thin, ["id"]).withColumnRenamed("encoded", "line")
    return (named.join(near, "id", "left").join(text, "id", "left")
            .select("id", "name", "place", "cat", F.round("length").alias("length"), F.round("gain").alias("gain"), F.round("avg", 1).alias("avg"), F.round("max", 1).alias("max"), F.round("elev1").alias("summit"),
                    "lat0", "lon0", "lat1", "lon1", "line"))
