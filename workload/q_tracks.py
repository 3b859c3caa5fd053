"""Track queries over ``points``."""

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import tracks
from workload import fixtures as fx
from workload.registry import query

R6 = 6


@query("trk_segments", fx.oracle(f"""
SELECT athlete_id, activity_id, count(*) AS n, round(sum(d), 3) AS metres, round(max(d), 6) AS longest FROM fx_dense_next
WHERE lat2 IS NOT NULL GROUP BY ALL""", fx.POINTS_SQL, fx.DENSE_TILES))
def trk_segments(spark, sf):
    segs = tracks.segments(fx.points(spark, sf))
    return segs.groupBy("athlete_id", "activity_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("metres"), 3).alias("metres"),
                                                         F.round(F.max("metres"), 6).alias("longest"))


@query("trk_densify", fx.oracle("""
SELECT athlete_id, activity_id, seq::BIGINT AS seq, sub::BIGINT AS sub, round(lat, 6) AS lat, round(lon, 6) AS lon FROM fx_dense""", fx.POINTS_SQL, fx.DENSE_TILES))
def trk_densify(spark, sf):
    dense = tracks.densify(fx.points(spark, sf), tracks.TILE_SPACING, tracks.TILE_GAP)
    return dense.select("athlete_id", "activity_id", F.col("seq").cast("bigint").alias("seq"), F.col("sub").cast("bigint").alias("sub"),
                        F.round("lat", R6).alias("lat"), F.round("lon", R6).alias("lon"))


@query("trk_tiles", fx.oracle("""
SELECT athlete_id, activity_id, tile_key FROM fx_activity_tiles""", fx.POINTS_SQL, fx.ACTIVITY_TILES_SQL))
def trk_tiles(spark, sf):
    return tracks.tiles(fx.points(spark, sf)).select("athlete_id", "activity_id", "tile_key")
