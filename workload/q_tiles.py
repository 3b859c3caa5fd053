"""Tile queries: visited sets, history, squares, clusters and neighbourhoods."""

from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.functions import geo
from wayfold.operators import areas, tiles, tracks
from workload import fixtures as fx
from workload.q_areas import INSIDE
from workload.registry import query

T, P = fx.TILES_SQL, fx.POINTS_SQL


@query("agg_visited", fx.oracle("SELECT athlete_id, count(DISTINCT tile_key) AS tiles FROM fx_activity_tiles GROUP BY 1", P, fx.ACTIVITY_TILES_SQL))
def agg_visited(spark, sf):
    seen = tiles.visited(tracks.tiles(fx.points(spark, sf)))
    return seen.groupBy("athlete_id").agg(F.count(F.lit(1)).alias("tiles"))


@query("agg_visited_on_map", fx.oracle(f"""SELECT athlete_id, tiles, coalesce(areas, 0) AS areas FROM (SELECT athlete_id, count(DISTINCT tile_key) AS tiles FROM fx_activity_tiles WHERE activity_id % 11 <> 0 GROUP BY 1)
LEFT JOIN (SELECT athlete_id, count(DISTINCT code) AS areas FROM fx_dense p JOIN fx_area_rects r ON {INSIDE} WHERE activity_id % 11 <> 0 GROUP BY 1) USING (athlete_id)""", P, fx.ACTIVITY_TILES_SQL, fx.AREAS_SQL))
def agg_visited_on_map(spark, sf):
    """Tiles and areas of activities on the map; every eleventh is virtual."""
    points = fx.points(spark, sf)
    on_map = fx.point_activities(spark, sf).withColumn("is_virtual", F.col("activity_id") % 11 == 0).filter(fa.is_on_map("is_virtual", "n_points"))
    seen = tiles.visited(tracks.tiles(points), on_map).groupBy("athlete_id").agg(F.count("*").alias("tiles"))
    inside = tiles.visited(areas.track_areas(points, areas.cell_index(fx.area_rings(spark, sf))), on_map, ("code",)).groupBy("athlete_id").agg(F.count("*").alias("areas"))
    return seen.join(inside, "athlete_id", "left").select("athlete_id", "tiles", F.coalesce("areas", F.lit(0)).alias("areas"))


HISTORY_SQL = f"""reached AS (
  SELECT athlete_id, activity_id, {fx.d_tile_key('lat', 'lon')} AS tile_key, min((seq, sub)) AS pos FROM fx_walk GROUP BY ALL),
fx_history AS (
  SELECT *, row_number() OVER (PARTITION BY athlete_id ORDER BY start_ts, activity_id, pos, tile_key) AS ord FROM (
    SELECT t.athlete_id, t.tile_key, a.start_ts, t.activity_id, r.pos,
      row_number() OVER (PARTITION BY t.athlete_id, t.tile_key ORDER BY a.start_ts, t.activity_id, r.pos) AS rn
    FROM fx_activity_tiles t JOIN fx_point_activities a USING (athlete_id, activity_id) LEFT JOIN reached r USING (athlete_id, activity_id, tile_key))
  WHERE rn = 1)"""
H = (P, fx.ACTIVITY_TILES_SQL, fx.DENSE_HISTORY, HISTORY_SQL)


def history(spark, sf):
    return tiles.first_visits(tracks.tiles_ordered(fx.points(spark, sf)), fx.point_activities(spark, sf))


@query("trk_tiles_ordered", fx.oracle(f"""
SELECT athlete_id, activity_id, tile_key, min((seq, sub)).seq::BIGINT AS first_seq, min((seq, sub)).sub::BIGINT AS first_sub FROM (
  SELECT athlete_id, activity_id, {fx.d_tile_key('lat', 'lon')} AS tile_key, {{'seq': seq, 'sub': sub}} AS p, seq, sub FROM fx_walk)
GROUP BY ALL""".replace("min((seq, sub)).seq", "min(p).seq").replace("min((seq, sub)).sub", "min(p).sub"), P, fx.DENSE_HISTORY))
def trk_tiles_ordered(spark, sf):
    out = tracks.tiles_ordered(fx.points(spark, sf))
    return out.select("athlete_id", "activity_id", "tile_key", F.col("first_seq").cast("bigint").alias("first_seq"), F.col("first_sub").cast("bigint").alias("first_sub"))


@query("win_tile_first_visit", fx.oracle("SELECT athlete_id, tile_key, activity_id, ord, epoch_us(start_ts) AS first_us FROM fx_history", *H))
def win_tile_first_visit(spark, sf):
    return history(spark, sf).select("athlete_id", "tile_key", "activity_id", "ord", F.unix_micros("first_ts").alias("first_us"))


@query("win_tiles_before", fx.oracle("SELECT athlete_id, tile_key FROM fx_history WHERE start_ts < TIMESTAMP '2024-01-12'", *H))
def win_tiles_before(spark, sf):
    return tiles.before(history(spark, sf), F.lit("2024-01-12").cast("timestamp")).select("athlete_id", "tile_key")


@query("win_history_frames", fx.oracle("""
SELECT athlete_id, tile_key, ord, frame, frame + 12 AS highlight_until FROM (
  SELECT h.athlete_id, tile_key, ord, (SELECT min(f) FROM range(600) r(f) WHERE floor(n * (f + 1) / 600) > ord - 1) AS frame
  FROM fx_history h JOIN (SELECT athlete_id, count(*) AS n FROM fx_history GROUP BY 1) c USING (athlete_id))""", *H))
def win_history_frames(spark, sf):
    return tiles.history_frames(history(spark, sf)).select("athlete_id", "tile_key", "ord", "frame", "highlight_until")


@query("win_frame_counts", fx.oracle("""
SELECT athlete_id, f::INTEGER AS frame, coalesce(sum(c) OVER w, 0)::BIGINT AS shown, c AS added,
  coalesce(sum(c) OVER (PARTITION BY athlete_id ORDER BY f ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0)::BIGINT AS highlighted
FROM (SELECT n.athlete_id, f, count(h.tile_key) AS c FROM (SELECT athlete_id, count(*) AS n FROM fx_history GROUP BY 1) n CROSS JOIN range(690) r(f)
  LEFT JOIN fx_history h ON h.athlete_id = n.athlete_id AND h.ord > CASE WHEN f > 600 THEN n WHEN f = 0 THEN 0 ELSE n * f // 600 END
    AND h.ord <= CASE WHEN f >= 600 THEN n ELSE n * (f + 1) // 600 END GROUP BY ALL)
WINDOW w AS (PARTITION BY athlete_id ORDER BY f)""", *H))
def win_frame_counts(spark, sf):
    return tiles.frame_counts(history(spark, sf))


SQUARE_SQL = """counted AS (SELECT a.athlete_id, s.s AS side, a.x, a.y, count(*) AS n FROM fx_visited_tiles a CROSS JOIN range(1, 13) s(s)
  JOIN fx_visited_tiles b ON b.athlete_id = a.athlete_id AND b.x BETWEEN a.x - s.s + 1 AND a.x AND b.y BETWEEN a.y - s.s + 1 AND a.y GROUP BY ALL),
squares AS (SELECT athlete_id, side, x, y, row_number() OVER (PARTITION BY athlete_id ORDER BY side DESC, y, x) AS rn FROM counted WHERE n = side * side)"""
CLUSTER_SQL = """inner_tiles AS (SELECT athlete_id, x, y, x::BIGINT * 4294967296 + y AS k FROM fx_visited_tiles t WHERE
  (SELECT count(*) FROM fx_visited_tiles u WHERE u.athlete_id = t.athlete_id AND abs(u.x - t.x) + abs(u.y - t.y) = 1) = 4),
spread(athlete_id, x, y, k) AS (
  SELECT athlete_id, x, y, k FROM inner_tiles
  UNION SELECT t.athlete_id, t.x, t.y, s.k FROM spread s JOIN inner_tiles t ON t.athlete_id = s.athlete_id AND abs(t.x - s.x) + abs(t.y - s.y) = 1),
labelled AS (SELECT athlete_id, x, y, min(k) AS label FROM spread GROUP BY ALL),
clusters AS (SELECT athlete_id, label, count(*) AS size, avg(x) + 0.5 AS cx, avg(y) + 0.5 AS cy,
  row_number() OVER (PARTITION BY athlete_id ORDER BY count(*) DESC, label) AS rn FROM labelled GROUP BY 1, 2)"""


@query("win_max_square", fx.oracle("SELECT athlete_id, side::INTEGER AS side, (x - side + 1)::INTEGER AS x, (y - side + 1)::INTEGER AS y FROM squares WHERE rn = 1", T, SQUARE_SQL))
def win_max_square(spark, sf):
    return tiles.max_square(fx.visited_tiles(spark, sf))


@query("win_max_cluster", fx.oracle("SELECT athlete_id, size AS cluster, round(cx, 6) AS center_x, round(cy, 6) AS center_y FROM clusters WHERE rn = 1", T, CLUSTER_SQL, recursive=True))
def win_max_cluster(spark, sf):
    out = tiles.max_cluster(fx.visited_tiles(spark, sf))
    return out.withColumn("center_x", F.round("center_x", 6)).withColumn("center_y", F.round("center_y", 6))


@query("win_square_stats", fx.oracle("""
SELECT c.athlete_id, c.tiles, s.side::INTEGER AS square, (s.x - s.side + 1)::INTEGER AS square_x, (s.y - s.side + 1)::INTEGER AS square_y,
  coalesce(k.size, 0) AS cluster, round(k.cx, 6) AS center_x, round(k.cy, 6) AS center_y
FROM (SELECT athlete_id, count(*) AS tiles FROM fx_visited_tiles GROUP BY 1) c LEFT JOIN squares s ON s.athlete_id = c.athlete_id AND s.rn = 1
LEFT JOIN clusters k ON k.athlete_id = c.athlete_id AND k.rn = 1""", T, SQUARE_SQL, CLUSTER_SQL, recursive=True))
def win_square_stats(spark, sf):
    out = tiles.square_stats(fx.visited_tiles(spark, sf))
    return out.withColumn("center_x", F.round("center_x", 6)).withColumn("center_y", F.round("center_y", 6))


LOCATIONS_SQL = """fx_locations AS (SELECT c_custkey % 10 AS athlete_id, c_custkey AS location_id, 52.05e0 + (c_custkey * 37 % 500) / 1000e0 AS lat,
  4.6e0 + (c_custkey * 53 % 700) / 1000e0 AS lon FROM customer)"""
LOC_TILES = f"(SELECT *, {fx.d_tile_x('lon')} AS cx, {fx.d_tile_y('lat')} AS cy FROM fx_locations)"


def locations(spark, sf):
    k = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select((k % 10).alias("athlete_id"), k.alias("location_id"), (F.lit(52.05) + (k * 37 % 500) / 1000).alias("lat"),
                                                  (F.lit(4.6) + (k * 53 % 700) / 1000).alias("lon"))


@query("jn_neighbourhood", fx.oracle(f"""
SELECT l.athlete_id, location_id, count(t.x) AS visited, 55::BIGINT AS total FROM {LOC_TILES} l LEFT JOIN fx_visited_tiles t ON t.athlete_id = l.athlete_id
  AND t.x BETWEEN cx - 5 AND cx + 5 AND t.y BETWEEN cy - 2 AND cy + 2 GROUP BY 1, 2""", T, LOCATIONS_SQL))
def jn_neighbourhood(spark, sf):
    return tiles.neighbourhood(locations(spark, sf), fx.visited_tiles(spark, sf), 11, 5)


@query("win_nearest_unvisited", fx.oracle(f"""
SELECT athlete_id, location_id, x::INTEGER AS x, y::INTEGER AS y, rank FROM (
  SELECT l.athlete_id, location_id, cx + dx AS x, cy + dy AS y, row_number() OVER (PARTITION BY l.athlete_id, location_id ORDER BY dx * dx + dy * dy, cx + dx, cy + dy)::INTEGER AS rank
  FROM {LOC_TILES} l CROSS JOIN range(-24, 25) a(dx) CROSS JOIN range(-24, 25) b(dy) WHERE (dx <> 0 OR dy <> 0)
    AND NOT EXISTS (SELECT 1 FROM fx_visited_tiles t WHERE t.athlete_id = l.athlete_id AND t.x = cx + dx AND t.y = cy + dy)) WHERE rank <= 4""", T, LOCATIONS_SQL))
def win_nearest_unvisited(spark, sf):
    return tiles.nearest_unvisited(locations(spark, sf), fx.visited_tiles(spark, sf)).select("athlete_id", "location_id", "x", "y", "rank")


@query("agg_densest_center", fx.oracle(f"""
SELECT athlete_id, n AS points, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (
  SELECT athlete_id, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon, row_number() OVER (PARTITION BY athlete_id ORDER BY count(*) DESC, bx, by_) AS rn
  FROM (SELECT *, {fx.d_tile_x('lon', 10)} AS bx, {fx.d_tile_y('lat', 10)} AS by_ FROM fx_points) GROUP BY athlete_id, bx, by_) WHERE rn = 1""", P))
def agg_densest_center(spark, sf):
    out = tiles.densest_center(fx.points(spark, sf))
    return out.select("athlete_id", "points", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("trk_bbox", fx.oracle("""
SELECT athlete_id, activity_id, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon
FROM fx_points GROUP BY 1, 2""", P))
def trk_bbox(spark, sf):
    box = tracks.bbox(fx.points(spark, sf))
    return box.select("athlete_id", "activity_id", *[F.round(c, 6).alias(c) for c in ("min_lat", "max_lat", "min_lon", "max_lon")])


@query("trk_length", fx.oracle("SELECT athlete_id, activity_id, round(coalesce(sum(d), 0), 4) AS metres FROM fx_dense_next GROUP BY 1, 2", P, fx.DENSE_TILES))
def trk_length(spark, sf):
    return tracks.length(fx.points(spark, sf)).withColumn("metres", F.round("metres", 4))


@query("trk_midpoint", fx.oracle("""
SELECT athlete_id, activity_id, round(lat + (lat2 - lat) * (half - walked) / d, 6) AS lat, round(lon + (lon2 - lon) * (half - walked) / d, 6) AS lon FROM (
  SELECT *, row_number() OVER (PARTITION BY activity_id ORDER BY seq) AS rn FROM (
    SELECT *, sum(d) OVER (PARTITION BY activity_id) / 2 AS half, coalesce(sum(d) OVER (PARTITION BY activity_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS walked
    FROM fx_dense_next WHERE lat2 IS NOT NULL) WHERE walked + d >= half AND d > 0) WHERE rn = 1
UNION ALL
SELECT athlete_id, activity_id, round(min(lat), 6), round(min(lon), 6) FROM fx_points GROUP BY 1, 2 HAVING count(*) = 1""", P, fx.DENSE_TILES))
def trk_midpoint(spark, sf):
    return tracks.midpoint(fx.points(spark, sf)).select("athlete_id", "activity_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("trk_even_times", fx.oracle("""
SELECT p.activity_id, seq, round((seq - 1) * CASE WHEN n > 1 THEN coalesce(e, m, n) / (n - 1) ELSE 0 END, 4) AS t_off
FROM (SELECT *, count(*) OVER (PARTITION BY activity_id) AS n, CASE WHEN activity_id % 3 = 0 THEN 3600e0 + activity_id END AS e,
  CASE WHEN activity_id % 3 = 1 THEN 1800e0 END AS m FROM fx_points) p""", P))
def trk_even_times(spark, sf):
    k = F.col("activity_id")
    acts = fx.point_activities(spark, sf).withColumn("elapsed_s", F.when(k % 3 == 0, F.lit(3600.0) + k)).withColumn("moving_s", F.when(k % 3 == 1, F.lit(1800.0)))
    return tracks.even_times(fx.points(spark, sf), acts).select("activity_id", F.col("seq").cast("bigint").alias("seq"), F.round("t_off", 4).alias("t_off"))


@query("trk_simplify")
def trk_simplify(spark, sf):
    """Zigzag tracks thinned at 150 m; compared with a brute-force recursion in the tests."""
    wavy = fx.points(spark, sf).withColumn("lat", F.col("lat") + F.lit(0.002) * ((F.col("seq") * 7919 + F.col("activity_id")) % 5))
    return tracks.simplify(wavy, 150.0).select("athlete_id", "activity_id", "seq", "lat", "lon")


@query("flt_valid_position", fx.oracle("""
SELECT activity_id, row_number() OVER (PARTITION BY activity_id ORDER BY seq) - 1 AS seq, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (
  SELECT athlete_id, activity_id, seq, CASE seq % 9 WHEN 4 THEN 0e0 WHEN 7 THEN 95e0 ELSE lat END AS lat, CASE WHEN seq % 9 = 4 THEN 0e0 ELSE lon END AS lon FROM fx_points)
WHERE NOT (lat = 0 AND lon = 0) AND lat BETWEEN -90 AND 90""", P))
def flt_valid_position(spark, sf):
    m = F.col("seq") % 9
    noisy = (fx.points(spark, sf).withColumn("lat", F.when(m == 4, 0.0).when(m == 7, 95.0).otherwise(F.col("lat"))).withColumn("lon", F.when(m == 4, 0.0).otherwise(F.col("lon"))))
    kept = tracks.reindex(tracks.valid_positions(noisy))
    return kept.select("activity_id", F.col("seq").cast("bigint").alias("seq"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
