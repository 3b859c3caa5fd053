"""Area, country and region queries."""

from pyspark.sql import functions as F

from wayfold.operators import areas, tracks
from workload import fixtures as fx
from workload.registry import query

P, AR = fx.POINTS_SQL, fx.AREAS_SQL
INSIDE = """(p.lat >= r.lat0 AND p.lat < r.lat0 + 0.08e0 AND p.lon >= r.lon0 AND p.lon < r.lon0 + 0.09e0 AND NOT (r.holed
  AND p.lat BETWEEN r.lat0 + 0.08e0 / 3 AND r.lat0 + 0.16e0 / 3 AND p.lon BETWEEN r.lon0 + 0.03e0 AND r.lon0 + 0.06e0))"""


@query("jn_point_in_area", fx.oracle(f"SELECT activity_id, seq, code FROM fx_points p JOIN fx_area_rects r ON {INSIDE}", P, AR))
def jn_point_in_area(spark, sf):
    found = areas.located(fx.points(spark, sf), areas.cell_index(fx.area_rings(spark, sf)))
    return found.select("activity_id", F.col("seq").cast("bigint").alias("seq"), "code")


@query("jn_track_areas", fx.oracle(f"SELECT DISTINCT athlete_id, activity_id, code FROM fx_dense p JOIN fx_area_rects r ON {INSIDE}", P, AR, fx.DENSE_TILES))
def jn_track_areas(spark, sf):
    return areas.track_areas(fx.points(spark, sf), areas.cell_index(fx.area_rings(spark, sf)))


@query("jn_track_countries", fx.oracle(f"""
SELECT DISTINCT athlete_id, activity_id, split_part(code, ':', 1) AS country FROM fx_points p
JOIN fx_area_rects r ON {INSIDE.replace('r.holed', 'false')}""", P, AR))
def jn_track_countries(spark, sf):
    index = areas.cell_index(fx.area_rings(spark, sf), areas.COUNTRY_CELL, outer_only=True)
    return areas.track_countries(fx.points(spark, sf), index)


@query("agg_region_counts", fx.oracle(f"""
SELECT athlete_id, country, visited, total, round(100e0 * visited / total, 6) AS pct FROM (
SELECT a.athlete_id, c.country, count(v.code) AS visited, any_value(c.total) AS total FROM (SELECT DISTINCT athlete_id FROM seen) a CROSS JOIN (SELECT split_part(code, ':', 1) AS country, count(DISTINCT code) AS total FROM fx_area_rects GROUP BY 1) c
LEFT JOIN seen v ON v.athlete_id = a.athlete_id AND split_part(v.code, ':', 1) = c.country GROUP BY a.athlete_id, c.country)""", P, AR, fx.DENSE_TILES,
f"seen AS (SELECT DISTINCT athlete_id, code FROM fx_dense p JOIN fx_area_rects r ON {INSIDE})"))
def agg_region_counts(spark, sf):
    rings = fx.area_rings(spark, sf)
    visited = areas.track_areas(fx.points(spark, sf), areas.cell_index(rings)).select("athlete_id", "code").distinct()
    return areas.region_counts(visited, rings).withColumn("pct", F.round("pct", 6))


SPLIT_SQL = "features AS (SELECT ordinal AS feature_id, 'D' || (ordinal % 7) AS code, name, poly, lat0, lon0, holed FROM fx_area_rects)"


def features(spark, sf):
    return fx.area_rings(spark, sf).withColumn("feature_id", F.col("ordinal")).withColumn("code", F.concat(F.lit("D"), (F.col("ordinal") % 7).cast("string")))


@query("agg_dissolve", fx.oracle("""
SELECT code, first_value(name) OVER (PARTITION BY code ORDER BY feature_id) AS name, (row_number() OVER (PARTITION BY code ORDER BY feature_id, poly) - 1)::INTEGER AS poly,
  CASE WHEN holed THEN 8 ELSE 4 END::BIGINT AS points, round(lat0, 6) AS min_lat FROM features""", AR, SPLIT_SQL))
def agg_dissolve(spark, sf):
    merged = areas.dissolve(features(spark, sf))
    return merged.groupBy("code", "name", "poly").agg(F.count(F.lit(1)).alias("points"), F.round(F.min("lat"), 6).alias("min_lat"))


@query("agg_layer_manifest", fx.oracle("""
SELECT split_part(code, ':', 1) AS country, count(DISTINCT code) AS areas, sum(CASE WHEN holed THEN 8 ELSE 4 END)::BIGINT AS points, round(min(lon0), 4) AS min_lon,
  round(min(lat0), 4) AS min_lat, round(max(lon0 + 0.09e0), 4) AS max_lon, round(max(lat0 + 0.08e0), 4) AS max_lat, 'municipalities' AS kind FROM fx_area_rects GROUP BY 1""", AR))
def agg_layer_manifest(spark, sf):
    return areas.layer_manifest(fx.area_rings(spark, sf), "municipalities")


@query("agg_ring_area", fx.oracle("""
SELECT code, poly, 0 AS ring, round(0.08e0 * 0.09e0, 6) AS area FROM fx_area_rects UNION ALL
SELECT code, poly, 1, round(0.08e0 / 3 * 0.03e0, 6) FROM fx_area_rects WHERE holed""", AR))
def agg_ring_area(spark, sf):
    return tracks.ring_area(fx.area_rings(spark, sf)).withColumn("area", F.round("area", 6))


@query("flt_sliver_polygons", fx.oracle("""
SELECT code, poly FROM (SELECT code, poly, holed, max(poly) OVER (PARTITION BY code) AS top, 0.0072e0 - CASE WHEN holed THEN 0.0008e0 ELSE 0 END AS area FROM fx_area_rects)
WHERE area >= pow(9000e0 / 111000, 2) OR poly = top""", AR))
def flt_sliver_polygons(spark, sf):
    """A 9 km limit: every part is smaller, so the largest of each area stays."""
    shrunk = fx.area_rings(spark, sf)
    return areas.drop_slivers(shrunk, 9_000.0).select("code", "poly").distinct()


@query("win_nearest_unvisited_area", fx.oracle(f"""
SELECT athlete_id, location_id, code, round(d, 3) AS metres FROM (
  SELECT l.athlete_id, location_id, r.code, {fx.d_distance('clat', 'clon', 'l.lat', 'l.lon')} AS d,
    row_number() OVER (PARTITION BY l.athlete_id, location_id ORDER BY {fx.d_distance('clat', 'clon', 'l.lat', 'l.lon')}, ordinal) AS rn
  FROM starts l JOIN (SELECT code, any_value(ordinal) AS ordinal, (min(lat0) + max(lat0 + 0.08e0)) / 2 AS clat, (min(lon0) + max(lon0 + 0.09e0)) / 2 AS clon FROM fx_area_rects GROUP BY 1) r ON true
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.athlete_id = l.athlete_id AND s.code = r.code)) WHERE rn = 1""", P, AR, fx.DENSE_TILES,
f"seen AS (SELECT DISTINCT athlete_id, code FROM fx_dense p JOIN fx_area_rects r ON {INSIDE})",
"""starts AS (SELECT c_custkey % 150 AS athlete_id, c_custkey AS location_id, 51.5e0 + (c_custkey * 37 % 900) / 1000e0 AS lat, 4.6e0 + (c_custkey * 53 % 700) / 1000e0 AS lon FROM customer)"""))
def win_nearest_unvisited_area(spark, sf):
    k = F.col("c_custkey")
    starts = fx.table(spark, sf, "customer").select((k % 150).alias("athlete_id"), k.alias("location_id"), (F.lit(51.5) + (k * 37 % 900) / 1000).alias("lat"),
                                                    (F.lit(4.6) + (k * 53 % 700) / 1000).alias("lon"))
    rings = fx.area_rings(spark, sf)
    visited = areas.track_areas(fx.points(spark, sf), areas.cell_index(rings)).select("athlete_id", "code").distinct()
    return areas.nearest_unvisited_area(starts, rings, visited).withColumn("metres", F.round("metres", 3))
