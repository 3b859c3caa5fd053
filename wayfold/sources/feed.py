"""Upstream activity summaries and full-resolution streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import activity as fa

SUMMARY = ("athlete_id BIGINT, id BIGINT, name STRING, sport_type STRING, type STRING, start_date TIMESTAMP, distance DOUBLE, elapsed_time DOUBLE, moving_time DOUBLE, "
           "average_watts DOUBLE, device_watts BOOLEAN, trainer BOOLEAN, map STRUCT<summary_polyline: STRING>, total_elevation_gain DOUBLE")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Activities of summary files (JSON lines), with ``encoded`` where a real track is known."""
    return activities(spark.read.schema(SUMMARY).json(path))


def activities(raw: DataFrame) -> DataFrame:
    kind = F.coalesce("sport_type", "type")
    virtual = fa.is_virtual("name", kind, "trainer")
    return raw.select(
        "athlete_id", F.col("id").alias("activity_id"), F.lit("feed").alias("source"), "name", fa.sport_from_feed(kind).alias("sport"), F.col("start_date").alias("start_ts"),
        F.col("distance").alias("distance_m"), F.col("elapsed_time").alias("elapsed_s"), F.col("moving_time").alias("moving_s"), F.when(F.col("device_watts"), F.col("average_watts")).alias("avg_power_w"),
        F.col("total_elevation_gain").alias("ascent_m"), F.lit(None).cast("double").alias("descent_m"), virtual.alias("is_virtual"), F.coalesce(fa.is_zwift_name("name"), F.lit(False)).alias("is_zwift"),
        F.when(~virtual, F.col("map.summary_polyline")).alias("encoded"))


STREAMS = ("athlete_id BIGINT, activity_id BIGINT, latlng STRUCT<data: ARRAY<ARRAY<DOUBLE>>>, time STRUCT<data: ARRAY<DOUBLE>>, altitude STRUCT<data: ARRAY<DOUBLE>>")


def explode_streams(streams: DataFrame) -> DataFrame:
    """Parallel arrays to points; a pair counts only with two values, a missing time is its index,
    and altitudes count only when there is one per pair."""
    pairs, times, heights = F.col("latlng.data"), F.col("time.data"), F.col("altitude.data")
    rows = streams.select("athlete_id", "activity_id", times.alias("_t"), F.when(F.size(heights) == F.size(pairs), heights).alias("_a"), F.posexplode(pairs).alias("_i", "_p"))
    kept = rows.filter(F.size("_p") == 2).select("athlete_id", "activity_id", F.col("_i").alias("seq"), F.col("_p")[0].alias("lat"), F.col("_p")[1].alias("lon"),
                                                 F.coalesce(F.get("_t", F.col("_i")), F.col("_i").cast("double")).alias("t_off"), F.get("_a", F.col("_i")).alias("alt"))
    from wayfold.operators import tracks
    return tracks.reindex(kept)


def read_streams(spark: SparkSession, path: str) -> DataFrame:
    return explode_streams(spark.read.schema(STREAMS).json(path))
