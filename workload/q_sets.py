"""Challenge progress, candidate routes, library sets, device messages and the year in review."""

from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import areas, library, messages, nearby, progress, routes, tiles, tracks
from wayfold.plans import challenge_results, refresh, review
from wayfold.session import cut
from workload import fixtures as fx
from workload.q_activities import SAME, TIMED_SQL
from workload.q_areas import INSIDE
from workload.q_nearby import CHECKPOINTS_SQL, CLIMB_MATCH_SQL, CROSS_SQL, HIT_CTES, VISITS_SQL
from workload.registry import query

P, A, AR = fx.POINTS_SQL, fx.ACTIVITIES_SQL, fx.AREAS_SQL

CHALLENGES_SQL = "challenges AS (SELECT * FROM (VALUES ('c0', 'k2'), ('c1', 'k1'), ('c2', 'k5'), ('c3', 'k5'), ('c4', 'k5')) t(challenge_id, key))"
RESULTS_SQL = "results AS (SELECT activity_id, 'c' || activity_id % 4 AS challenge_id, 'k' || activity_id % 3 AS key FROM fx_activities)"


def challenges(spark, sf):
    """One live challenge with its key for each region."""
    r = F.col("r_regionkey")
    key = F.when(r == 0, "k2").when(r == 1, "k1").otherwise("k5")
    return fx.table(spark, sf, "region").select(F.concat(F.lit("c"), r.cast("string")).alias("challenge_id"), key.alias("key"))


def results(spark, sf):
    k = F.col("activity_id")
    return fx.activities(spark, sf).select("activity_id", F.concat(F.lit("c"), (k % 4).cast("string")).alias("challenge_id"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("key"))


@query("set_pending", fx.oracle("""
SELECT a.activity_id, c.challenge_id, c.key FROM fx_activities a CROSS JOIN challenges c WHERE NOT EXISTS (
  SELECT 1 FROM results r WHERE r.activity_id = a.activity_id AND r.challenge_id = c.challenge_id AND r.key = c.key)""", A, CHALLENGES_SQL, RESULTS_SQL))
def set_pending(spark, sf):
    return progress.pending(fx.activities(spark, sf), challenges(spark, sf), results(spark, sf)).select("activity_id", "challenge_id", "key")


@query("sink_results_upsert", fx.oracle("""
SELECT activity_id, challenge_id, key FROM results r WHERE challenge_id IN (SELECT challenge_id FROM challenges) AND NOT (activity_id % 5 = 0 AND challenge_id = 'c1')
UNION ALL SELECT activity_id, 'c1', 'new' FROM fx_activities WHERE activity_id % 5 = 0""", A, CHALLENGES_SQL, RESULTS_SQL))
def sink_results_upsert(spark, sf):
    new = fx.activities(spark, sf).filter(F.col("activity_id") % 5 == 0).select("activity_id", F.lit("c1").alias("challenge_id"), F.lit("new").alias("key"))
    return progress.upsert(results(spark, sf), new, challenges(spark, sf)).select("activity_id", "challenge_id", "key")


@query("agg_visit_dates", fx.oracle("""
SELECT athlete_id, item_id, row_number() OVER (PARTITION BY athlete_id, item_id ORDER BY start_ts DESC, activity_id) AS ord, epoch_us(start_ts) AS visit_us
FROM fx_visits JOIN fx_point_activities USING (athlete_id, activity_id) WHERE activity_id % 3 <> 0""", P, fx.DENSE_TILES, fx.PLACES_SQL, VISITS_SQL))
def agg_visit_dates(spark, sf):
    places = fx.places(spark, sf)
    same = cut(challenge_results.same_items(places))
    hits = nearby.place_visits(fx.points(spark, sf), challenge_results.first_items(places, same)).withColumn("key", F.when(F.col("activity_id") % 3 != 0, "now").otherwise("old"))
    current = hits.select("challenge_id").distinct().withColumn("key", F.lit("now"))
    out = progress.visit_dates(cut(hits), current, fx.point_activities(spark, sf), same)
    return out.select("athlete_id", F.col("item_id").cast("bigint").alias("item_id"), "ord", F.unix_micros("visit_ts").alias("visit_us"))


COVERAGE_SQL = """shares AS (SELECT athlete_id, route_id, least(1e0, count(DISTINCT idx) / any_value(total)::DOUBLE) AS share FROM fx_hits
  JOIN (SELECT route_id, count(*) AS total FROM fx_checkpoints GROUP BY 1) USING (route_id) GROUP BY 1, 2)"""


def shares(spark, sf):
    return progress.tracks_coverage(fx.points(spark, sf), cut(nearby.route_checkpoints(fx.routes(spark, sf), 50.0)))


@query("agg_route_coverage", fx.oracle("SELECT athlete_id, route_id, round(share, 6) AS share FROM shares", *HIT_CTES, COVERAGE_SQL))
def agg_route_coverage(spark, sf):
    return shares(spark, sf).withColumn("share", F.round("share", 6))


@query("agg_challenge_done", fx.oracle("""
SELECT athlete_id, 'routes' AS challenge_id, count(*) FILTER (share >= 0.5) AS done, (SELECT count(DISTINCT p_partkey) FROM part) AS total FROM shares GROUP BY 1 HAVING count(*) FILTER (share >= 0.5) > 0
UNION ALL SELECT athlete_id, 'places', count(DISTINCT item_id), (SELECT count(*) FROM supplier) FROM fx_visits GROUP BY 1""", *HIT_CTES, COVERAGE_SQL, fx.DENSE_TILES, fx.PLACES_SQL, VISITS_SQL))
def agg_challenge_done(spark, sf):
    """Routes with equal checkpoints and places of one spot are matched and counted once with their number."""
    points, places, marks = fx.points(spark, sf), fx.places(spark, sf), cut(nearby.route_checkpoints(fx.routes(spark, sf), 50.0))
    twins, same = cut(nearby.same_checkpoints(marks)), cut(challenge_results.same_items(places))
    share = progress.first_coverage(points, marks, twins).withColumn("challenge_id", F.lit("routes")).withColumn("route_id", F.col("route_id").cast("string"))
    visits = nearby.place_visits(points, challenge_results.first_items(places, same)).withColumn("item_id", F.col("item_id").cast("string"))
    r = F.col("r_regionkey")
    both = fx.table(spark, sf, "region").select(F.when(r == 0, "routes").when(r == 1, "places").otherwise(F.concat(F.lit("empty "), r.cast("string"))).alias("challenge_id"), (r == 0).alias("is_cover"), F.lit(0.5).alias("coverage"))
    items = (fx.table(spark, sf, "part").select(F.lit("routes").alias("challenge_id"), F.col("p_partkey").alias("item_id"))
             .unionByName(fx.table(spark, sf, "supplier").select(F.lit("places").alias("challenge_id"), F.col("s_suppkey").alias("item_id"))))
    routes_of = twins.select(F.lit("routes").alias("challenge_id"), F.col("same").cast("string").alias("item_id"))
    return progress.challenge_done(share, items, visits, both, copies_of(routes_of.unionByName(same.select("challenge_id", F.col("same").alias("item_id"))), "challenge_id", "item_id"))


def copies_of(firsts, *keys):
    """How many items each first one stands for."""
    return cut(firsts.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")))


# Candidate routes: every track, moved aside, as a route of its athlete.
PLAN_SQL = """plan_points AS (SELECT athlete_id, activity_id AS route_id, seq, lat + 0.02e0 AS lat, lon + 0.01e0 AS lon FROM fx_points)""" + ",\n" + fx.d_dense(
    "plan", "plan_points", "CASE WHEN d > 20 AND d <= 5000 THEN ceil(d / 20e0) END", "athlete_id, route_id")
PLAN_D = fx.d_segment_distance("pl.lat", "pl.lon", "p.lat", "p.lon", "p.lat2", "p.lon2")
PASSED_SQL = f"""passed AS (SELECT DISTINCT athlete_id, route_id, 'tile' AS kind, {fx.d_tile_key('lat', 'lon')}::VARCHAR AS id FROM plan
  UNION SELECT athlete_id, route_id, 'area', code FROM plan p JOIN fx_area_rects r ON {INSIDE}
  UNION SELECT athlete_id, route_id, 'place', item_id::VARCHAR FROM plan_next p JOIN fx_places pl ON CASE WHEN lat2 IS NULL THEN {fx.d_distance('p.lat', 'p.lon', 'pl.lat', 'pl.lon')} ELSE {PLAN_D} END <= 300),
known AS (SELECT DISTINCT athlete_id, 'tile' AS kind, tile_key::VARCHAR AS id FROM fx_activity_tiles UNION SELECT athlete_id, 'area', code FROM fx_dense p JOIN fx_area_rects r ON {INSIDE})"""
PLAN_CTES = (P, AR, fx.PLACES_SQL, fx.ACTIVITY_TILES_SQL, PLAN_SQL, PASSED_SQL)
# What a route adds: climbs too, and places and climbs that the athlete's own tracks pass are known.
ADDED_SQL = "plan_tracks AS (SELECT athlete_id, route_id AS activity_id, seq, lat, lon FROM plan_points),\n" + fx.d_dense("plan_match", "plan_tracks", "greatest(1, floor(d / 20e0))") + f""",
passed_all AS (SELECT * FROM passed UNION ALL SELECT athlete_id, activity_id, 'climb', climb_id::VARCHAR FROM ({CLIMB_MATCH_SQL.replace("fx_match", "plan_match")})),
known_all AS (SELECT * FROM known UNION SELECT athlete_id, 'climb', climb_id::VARCHAR FROM ({CLIMB_MATCH_SQL}) UNION SELECT athlete_id, 'place', item_id::VARCHAR FROM fx_visits)"""


def plan_lines(spark, sf):
    return fx.points(spark, sf).select("athlete_id", F.col("activity_id").alias("route_id"), "seq", (F.col("lat") + 0.02).alias("lat"), (F.col("lon") + 0.01).alias("lon"))


def plan(spark, sf):
    points, lines = fx.points(spark, sf), plan_lines(spark, sf)
    index = cut(areas.cell_index(fx.area_rings(spark, sf)))
    known = (tracks.tiles(points).select("athlete_id", F.lit("tile").alias("kind"), F.col("tile_key").cast("string").alias("id"))
             .unionByName(areas.track_areas(points, index).select("athlete_id", F.lit("area").alias("kind"), F.col("code").alias("id"))).distinct())
    marks = cut(nearby.route_checkpoints(fx.routes(spark, sf), 50.0).withColumnRenamed("route_id", "climb_id"))
    return routes.new_things(lines, known, index, marks, fx.places(spark, sf), points)


@query("set_new_things", fx.oracle("SELECT * FROM passed_all p WHERE NOT EXISTS (SELECT 1 FROM known_all k WHERE k.athlete_id = p.athlete_id AND k.kind = p.kind AND k.id = p.id)",
                                   *PLAN_CTES, fx.DENSE_MATCH, fx.ROUTES_SQL, CHECKPOINTS_SQL, VISITS_SQL, ADDED_SQL))
def set_new_things(spark, sf):
    return plan(spark, sf)[1].select("athlete_id", "route_id", "kind", "id")


@query("set_target_missed", fx.oracle("""
SELECT * FROM (SELECT DISTINCT athlete_id, route_id, 'place' AS kind, (route_id * 7 % 100)::VARCHAR AS id FROM plan_points UNION SELECT DISTINCT athlete_id, route_id, 'area', 'C2:12' FROM plan_points) t
WHERE NOT EXISTS (SELECT 1 FROM passed p WHERE p.route_id = t.route_id AND p.kind = t.kind AND p.id = t.id)""", *PLAN_CTES))
def set_target_missed(spark, sf):
    wanted = fx.point_activities(spark, sf).select("athlete_id", F.col("activity_id").alias("route_id"), F.explode(F.array(
        F.struct(F.lit("place").alias("kind"), (F.col("activity_id") * 7 % 100).cast("string").alias("id")), F.struct(F.lit("area").alias("kind"), F.lit("C2:12").alias("id")))).alias("t"))
    wanted = wanted.select("athlete_id", "route_id", "t.kind", "t.id")
    passed = routes.passed_targets(wanted, plan_lines(spark, sf), cut(areas.cell_index(fx.area_rings(spark, sf))), places=fx.places(spark, sf))
    return routes.missed_targets(wanted, passed)


@query("win_target_points_tile", fx.oracle("""
SELECT target_id, round(n + (s - n) * (i + 0.5e0) / 6, 6) AS lat, round(w + (e - w) * (j + 0.5e0) / 6, 6) AS lon FROM (
  SELECT DISTINCT x::BIGINT * 4294967296 + y AS target_id, degrees(atan(sinh(pi() * (1 - 2e0 * y / 16384e0)))) AS n, degrees(atan(sinh(pi() * (1 - 2e0 * (y + 1) / 16384e0)))) AS s,
    x / 16384e0 * 360 - 180 AS w, (x + 1) / 16384e0 * 360 - 180 AS e FROM fx_visited_tiles), range(6) a(i), range(6) b(j)""", fx.TILES_SQL))
def win_target_points_tile(spark, sf):
    targets = fx.visited_tiles(spark, sf).select("x", "y").distinct().withColumn("target_id", geo.tile_key("x", "y"))
    return routes.tile_candidates(targets).select("target_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("win_target_points_place", fx.oracle("""
SELECT item_id AS target_id, round(lat + CASE WHEN k < 0 THEN 0 ELSE 120 / 111000e0 * sin(k * pi() / 4) END, 6) AS lat,
  round(lon + CASE WHEN k < 0 THEN 0 ELSE 120 / 111000e0 / cos(radians(lat)) * cos(k * pi() / 4) END, 6) AS lon FROM fx_places, range(-1, 8) t(k)""", fx.PLACES_SQL))
def win_target_points_place(spark, sf):
    return routes.place_candidates(fx.places(spark, sf).withColumnRenamed("item_id", "target_id")).select("target_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("win_target_points_area", fx.oracle("""
SELECT code, level, round(lat, 6) AS lat, round(lon, 6) AS lon FROM cand JOIN (SELECT code, min(level) FILTER (n >= 12 OR level = 2) AS level FROM (SELECT code, level, count(*) AS n FROM cand GROUP BY 1, 2) GROUP BY 1) USING (code, level)""",
AR, f"""boxes AS (SELECT code, min(lat0) AS s, max(lat0 + 0.08e0) AS n, min(lon0) AS w, max(lon0 + 0.09e0) AS e FROM fx_area_rects GROUP BY 1),
grid AS (SELECT code AS want, level, s + (n - s) * (i + 0.5e0) / k AS lat, w + (e - w) * (j + 0.5e0) / k AS lon FROM boxes, (VALUES (0, 12), (1, 24), (2, 48)) t(level, k), range(48) a(i), range(48) b(j) WHERE i < k AND j < k),
cand AS (SELECT r.code, level, lat, lon FROM grid p JOIN fx_area_rects r ON r.code = p.want AND {INSIDE})"""))
def win_target_points_area(spark, sf):
    return routes.area_candidates(fx.area_rings(spark, sf)).select("code", "level", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


CELLS_SQL = """cells AS (SELECT p_partkey AS cell_id, 45e0 + p_partkey % 40 * 0.5e0 AS lat, -5e0 + p_partkey // 40 % 60 * 0.5e0 AS lon, CASE p_partkey % 3 WHEN 0 THEN 4e0 WHEN 1 THEN 1e0 ELSE 0.25e0 END AS size, p_partkey * 17 % 9000 AS bytes FROM part)"""
STOPS_SQL = """stops AS (SELECT c_custkey // 3 AS path_id, c_custkey % 3 AS seq, 47e0 + c_custkey * 37 % 900 / 100e0 AS lat, 1e0 + c_custkey * 53 % 1000 / 100e0 AS lon FROM customer)"""


def cells(spark, sf):
    k = F.col("p_partkey")
    return fx.table(spark, sf, "part").select(k.alias("cell_id"), (45 + k % 40 * F.lit(0.5)).alias("lat"), (-5 + F.floor(k / 40) % 60 * F.lit(0.5)).alias("lon"),
                                              F.when(k % 3 == 0, 4.0).when(k % 3 == 1, 1.0).otherwise(0.25).alias("size"), (k * 17 % 9000).alias("bytes"))


def stops(spark, sf):
    k = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select(F.floor(k / 3).alias("path_id"), (k % 3).cast("int").alias("seq"), (47 + k * 37 % 900 / 100).alias("lat"), (1 + k * 53 % 1000 / 100).alias("lon"))


@query("jn_corridor_cells", fx.oracle("""
SELECT path_id, count(*) AS cells, sum(bytes)::BIGINT AS bytes FROM (SELECT DISTINCT path_id, cell_id, bytes FROM walk p JOIN cells c ON p.lat > c.lat - 15000 / 111000e0 AND p.lat < c.lat + size + 15000 / 111000e0
  AND p.lon > c.lon - 15000 / (111000e0 * cos(radians(c.lat + size / 2))) AND p.lon < c.lon + size + 15000 / (111000e0 * cos(radians(c.lat + size / 2)))) GROUP BY 1""",
CELLS_SQL, STOPS_SQL, fx.d_dense("walk", "stops", "greatest(1, floor(d / 2000e0))", "path_id")))
def jn_corridor_cells(spark, sf):
    return routes.corridor_bytes(routes.corridor_cells(stops(spark, sf), cells(spark, sf), 15_000.0))


@query("jn_cells_near_outline", fx.oracle("""
SELECT DISTINCT cell_id FROM cells c JOIN fx_area_rects r ON (
  EXISTS (SELECT 1 FROM (VALUES (lat0, lon0), (lat0 + 0.08e0, lon0), (lat0, lon0 + 0.09e0), (lat0 + 0.08e0, lon0 + 0.09e0)) v(y, x) WHERE y BETWEEN c.lat - 70 / 111e0 AND c.lat + size + 70 / 111e0
    AND x BETWEEN c.lon - 70 / (111e0 * cos(radians(c.lat + size / 2))) AND c.lon + size + 70 / (111e0 * cos(radians(c.lat + size / 2))))
  OR (c.lat + size / 2 BETWEEN lat0 AND lat0 + 0.08e0 AND c.lon + size / 2 BETWEEN lon0 AND lon0 + 0.09e0))""", CELLS_SQL, AR))
def jn_cells_near_outline(spark, sf):
    return routes.cells_near_outline(cells(spark, sf), fx.area_rings(spark, sf))


@query("jn_cells_in_box", fx.oracle("""
SELECT c_custkey AS activity_id, cell_lat, cell_lon FROM (SELECT c_custkey, (c_custkey * 41 % 700) / 100e0 + 45 AS a, (c_custkey * 41 % 700) / 100e0 + 45 + c_custkey % 13 / 10e0 AS b, (c_custkey * 43 % 900) / 100e0 AS o,
  (c_custkey * 43 % 900) / 100e0 + c_custkey % 7 / 10e0 AS q FROM customer), (SELECT DISTINCT 45 + p_partkey % 8 AS cell_lat, p_partkey // 8 % 10 AS cell_lon FROM part)
WHERE cell_lat < b + 0.05e0 AND cell_lat + 1 > a - 0.05e0 AND cell_lon < q + 0.05e0 AND cell_lon + 1 > o - 0.05e0"""))
def jn_cells_in_box(spark, sf):
    k, p = F.col("c_custkey"), F.col("p_partkey")
    boxes = fx.table(spark, sf, "customer").select(k.alias("activity_id"), ((k * 41 % 700) / 100 + 45).alias("min_lat"), ((k * 41 % 700) / 100 + 45 + k % 13 / 10).alias("max_lat"),
                                                   ((k * 43 % 900) / 100).alias("min_lon"), ((k * 43 % 900) / 100 + k % 7 / 10).alias("max_lon"))
    index = fx.table(spark, sf, "part").select((45 + p % 8).alias("cell_lat"), (F.floor(p / 8) % 10).alias("cell_lon")).distinct()
    return routes.cells_in_box(boxes, index)


@query("jn_pairwise_cost", fx.oracle(f"SELECT a.path_id AS request_id, a.seq::INTEGER AS i, b.seq::INTEGER AS j, round({fx.d_distance('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 3) AS metres FROM stops a JOIN stops b USING (path_id)", STOPS_SQL))
def jn_pairwise_cost(spark, sf):
    return routes.pairwise_cost(stops(spark, sf).withColumnRenamed("path_id", "request_id")).withColumn("metres", F.round("metres", 3))


CAT = "sqrt(pow((b.lat - a.lat) * 110574e0, 2) + pow((b.lon - a.lon) * 111320e0 * cos(radians(a.lat)), 2))"
FERRY_SQL = """ferry_points AS (SELECT p_partkey AS line_id, s.seq, 52e0 + p_partkey % 500 / 1000e0 + (CASE WHEN p_partkey % 6 = 0 AND s.seq = 2 THEN 0 ELSE s.seq END) * (1 + p_partkey % 17) * 0.0007e0 AS lat, 5e0 + s.seq * 0.0001e0 AS lon FROM part, (SELECT unnest(range(3)) AS seq) s)"""


def ferry_points(spark, sf):
    base = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("line_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"))
    k, s = F.col("line_id"), F.col("seq")
    return base.select("line_id", "seq", (52 + k % 500 / 1000 + F.when((k % 6 == 0) & (s == 2), 0).otherwise(s) * (1 + k % 17) * F.lit(0.0007)).alias("lat"), (5 + s * F.lit(0.0001)).alias("lon"))


@query("flt_ferry", fx.oracle(f"""
SELECT line_id, round(m, 3) AS metres FROM (SELECT a.line_id, sum({CAT}) AS m FROM ferry_points a JOIN ferry_points b ON b.line_id = a.line_id AND b.seq = a.seq + 1 GROUP BY 1) t
JOIN (SELECT a.line_id, {CAT} AS apart FROM ferry_points a JOIN ferry_points b ON b.line_id = a.line_id AND a.seq = 0 AND b.seq = 2) e USING (line_id)
WHERE m BETWEEN 30 AND 2000 AND apart >= m / 3 AND line_id % 5 <> 1 AND line_id % 7 <> 1 AND line_id % 11 <> 1""", FERRY_SQL))
def flt_ferry(spark, sf):
    from wayfold.functions.activity import is_usable_ferry
    k = F.col("line_id")
    tags = F.create_map(F.lit("route"), F.lit("ferry"), F.lit("bicycle"), F.when(k % 5 == 1, "no").otherwise("yes"), F.lit("access"), F.when(k % 7 == 1, "private"), F.lit("disused"), F.when(k % 11 == 1, "yes"))
    return routes.ferries(ferry_points(spark, sf).filter(is_usable_ferry(tags))).select("line_id", F.round("metres", 3).alias("metres"))


@query("win_cross_border_dedup", fx.oracle("""
SELECT route_id, extract FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY metres DESC, extract) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY e ORDER BY extract, route_id) AS f FROM (SELECT p_partkey // 3 AS route_id, (p_partkey % 3)::INTEGER AS extract, p_partkey * 31 % 977 AS metres, p_partkey // 2 AS e FROM part)) WHERE f = 1) WHERE k = 1"""))
def win_cross_border_dedup(spark, sf):
    k = F.col("p_partkey")
    e = F.floor(k / 2)
    a, b = F.struct((40 + e / 100).alias("lat"), F.lit(5.0).alias("lon")), F.struct((41 + e / 100).alias("lat"), F.lit(6.0).alias("lon"))
    rows = fx.table(spark, sf, "part").select(F.floor(k / 3).alias("route_id"), (k % 3).cast("int").alias("extract"), (k * 31 % 977).alias("metres"), F.when(k % 2 == 0, a).otherwise(b).alias("a"), F.when(k % 2 == 0, b).otherwise(a).alias("b"))
    return routes.cross_border_distinct(rows).select("route_id", "extract")


WAYS_SQL = "ways AS (SELECT l_orderkey AS route_id, l_quantity * 100 AS metres, CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 30 / 10e0 END AS scale FROM lineitem)"


@query("agg_weighted_technical", fx.oracle("""
SELECT route_id, CASE WHEN tagged >= total / 3 THEN round((weighted / tagged)::DECIMAL(18, 9), 1)::DOUBLE END AS technical FROM (
  SELECT route_id, sum(metres) FILTER (scale IS NOT NULL) AS tagged, sum(metres) AS total, sum(metres * scale) AS weighted FROM ways GROUP BY 1)""", WAYS_SQL))
def agg_weighted_technical(spark, sf):
    ways = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route_id"), (F.col("l_quantity") * 100).alias("metres"), F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey") % 30 / 10).alias("scale"))
    return routes.weighted_technical(ways)


@query("agg_catalog_stats", "SELECT p_type, count(*) AS routes, round(sum(p_retailprice) / 1000, 6) AS km FROM part GROUP BY ROLLUP (p_type)")
def agg_catalog_stats(spark, sf):
    rows = fx.table(spark, sf, "part").select("p_type", F.col("p_retailprice").alias("metres"))
    return routes.catalogue_stats(rows, "p_type").withColumn("km", F.round("km", 6))


@query("set_mirror_diff", "SELECT DISTINCT 'f' || o_custkey AS name FROM orders WHERE o_custkey % 3 <> 0 AND o_custkey % 7 <> 0")
def set_mirror_diff(spark, sf):
    name = F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("name")
    orders, cust = fx.table(spark, sf, "orders").select(name), fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return library.mirror_diff(orders, cust.filter("o_custkey % 3 = 0").select(name), cust.filter("o_custkey % 7 = 0").select(name))


@query("set_country_prune", """
SELECT e.athlete_id, e.country FROM (SELECT DISTINCT c_custkey % 200 AS athlete_id, 'K' || c_nationkey AS country, c_nationkey FROM customer) e
WHERE (athlete_id + c_nationkey) % 4 = 0 OR NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey % 200 = e.athlete_id AND (c.c_custkey % 200 + c.c_nationkey) % 4 = 0)""")
def set_country_prune(spark, sf):
    a, n = (F.col("c_custkey") % 200).alias("athlete_id"), F.col("c_nationkey")
    cust = fx.table(spark, sf, "customer")
    enabled = cust.select(a, F.concat(F.lit("K"), n.cast("string")).alias("country")).distinct()
    hit = cust.filter((F.col("c_custkey") % 200 + n) % 4 == 0)
    visited = hit.filter(n % 2 == 0).select(a, F.concat(F.lit("K"), n.cast("string"), F.lit(":x")).alias("code"))
    return library.country_prune(enabled, visited, hit.filter(n % 2 == 1).select(a, F.concat(F.lit("K"), n.cast("string")).alias("country")))


@query("set_feed_new", fx.oracle("""
SELECT activity_id FROM fx_activities a LEFT JOIN (SELECT athlete_id, max(start_ts) AS mark FROM fx_activities WHERE activity_id % 3 = 0 AND start_ts < TIMESTAMP '2001-01-01' GROUP BY 1) m USING (athlete_id)
WHERE (mark IS NULL OR start_ts > mark - INTERVAL 1 DAY) AND NOT (activity_id % 3 = 0 AND start_ts < TIMESTAMP '2001-01-01') AND activity_id % 5 <> 0""", A))
def set_feed_new(spark, sf):
    acts = fx.activities(spark, sf)
    known = acts.filter((F.col("activity_id") % 3 == 0) & (F.col("start_ts") < F.lit("2001-01-01").cast("timestamp")))
    return library.feed_new(acts, known, acts.filter(F.col("activity_id") % 5 == 0)).select("activity_id")


@query("set_detail_queue", fx.oracle("""
SELECT athlete_id, activity_id, row_number() OVER (PARTITION BY athlete_id ORDER BY start_ts DESC NULLS LAST, activity_id) AS pos
FROM fx_activities f WHERE source = 'feed' AND quality > 0 AND (quality = 1 OR activity_id % 4 = 0 OR activity_id % 6 = 0)
  AND NOT EXISTS (SELECT 1 FROM copied c WHERE c.activity_id = f.activity_id)""", fx.ACTIVITIES_SQL, TIMED_SQL, f"""
copied AS (SELECT DISTINCT a.activity_id FROM timed a JOIN timed b ON a.athlete_id = b.athlete_id AND {SAME} WHERE a.activity_id < 1000000000 AND b.activity_id >= 1000000000)"""))
def set_detail_queue(spark, sf):
    acts = fx.activities(spark, sf)
    k = F.col("activity_id")
    feed = acts.filter("source = 'feed'").withColumn("exported_file", F.when(k % 4 != 0, F.format_string("a-%d.fit", k)))
    present = feed.filter("exported_file is not null").filter(k % 6 != 0).select(F.col("exported_file").alias("name"))
    return library.detail_queue(feed, acts.filter("source = 'file'"), present).select("athlete_id", "activity_id", "pos")


@query("set_catalog_changes", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'added' ELSE 'removed' END AS change FROM part WHERE (p_partkey % 3 = 0) <> (p_partkey % 5 = 0)")
def set_catalog_changes(spark, sf):
    ids = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    return library.catalogue_changes(ids.filter("id % 5 = 0"), ids.filter("id % 3 = 0"))


@query("st_tombstones_batch", """
SELECT name, changed_at > 0 AS deleted FROM (
  SELECT name, changed_at, row_number() OVER (PARTITION BY name ORDER BY abs(changed_at) DESC, writer) AS rn FROM (
    SELECT 'f' || o_custkey AS name, (CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * (100000 + o_orderkey * 7919 % 1000003) AS changed_at, o_orderkey % 2 AS writer FROM orders)) WHERE rn = 1""")
def st_tombstones_batch(spark, sf):
    k = F.col("o_orderkey")
    log = fx.table(spark, sf, "orders").select(F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("name"), (F.when(k % 3 == 0, -1).otherwise(1) * (100000 + k * 7919 % 1000003)).alias("changed_at"), (k % 2).alias("writer"))
    return library.tombstones(log).select("name", "deleted")


@query("st_names_log_batch", """
SELECT o_custkey % 5 AS athlete_id, 'file-' || lpad((o_custkey % 900)::VARCHAR, 4, '0') AS file_name, max_by('n' || o_orderkey, o_orderkey) AS new_name FROM orders GROUP BY 1, 2""")
def st_names_log_batch(spark, sf):
    log = fx.table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("athlete_id"), F.format_string("file-%04d", F.col("o_custkey") % 900).alias("file_name"),
                                               F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("new_name"), F.col("o_orderkey").alias("arrival"))
    return library.names_log(log).select("athlete_id", "file_name", "new_name")


MESSAGES_SQL = """sess AS (SELECT l_orderkey AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq,
  CASE WHEN l_tax = 0 THEN NULL ELSE floor(l_extendedprice * 100)::BIGINT END AS distance, (l_quantity * 60000)::BIGINT AS timer, nullif(l_partkey % 400, 0) AS power, CASE WHEN l_tax = 0 THEN NULL ELSE l_suppkey END AS ascent, l_partkey % 60 AS sport FROM lineitem)"""


def device_messages(spark, sf):
    """One session message per line item; invalid values where the tax is zero."""
    from pyspark.sql import Window
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    li = fx.table(spark, sf, "lineitem").withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    void = F.col("l_tax") == 0
    fields = [(9, F.when(void, F.lit(0xFFFFFFFF)).otherwise(F.floor(F.col("l_extendedprice") * 100))), (8, (F.col("l_quantity") * 60000).cast("bigint")), (20, F.col("l_partkey") % 400),
              (22, F.when(void, F.lit(0xFFFF)).otherwise(F.col("l_suppkey"))), (5, F.col("l_partkey") % 60)]
    return li.select(F.col("l_orderkey").alias("file"), "seq", F.lit(18).alias("global"), F.explode(F.array(*[F.struct(F.lit(n).alias("field"), v.cast("bigint").alias("value")) for n, v in fields])).alias("f")).select("file", "seq", "global", "f.field", "f.value")


@query("agg_message_fold", fx.oracle("""
SELECT file, round(sum(distance) / 100e0, 3) AS distance_m, round(sum(timer) / 1000e0, 3) AS moving_s, sum(ascent)::DOUBLE AS ascent_m, round(sum(power * timer) FILTER (power > 0 AND timer > 0) / sum(timer) FILTER (power > 0 AND timer > 0), 5) AS avg_power_w,
  CASE min_by(sport, seq) WHEN 1 THEN 'Running' WHEN 2 THEN 'Cycling' WHEN 4 THEN 'Fitness' WHEN 5 THEN 'Swimming' WHEN 11 THEN 'Walking' WHEN 12 THEN 'Cross-country skiing' WHEN 13 THEN 'Skiing' WHEN 14 THEN 'Snowboarding'
    WHEN 15 THEN 'Rowing' WHEN 17 THEN 'Hiking' WHEN 21 THEN 'E-biking' WHEN 30 THEN 'Inline skating' WHEN 53 THEN 'Diving' ELSE 'Activity' END AS sport FROM sess GROUP BY 1""", MESSAGES_SQL))
def agg_message_fold(spark, sf):
    out = messages.fold(device_messages(spark, sf))
    return out.select("file", F.round("distance_m", 3).alias("distance_m"), F.round("moving_s", 3).alias("moving_s"), "ascent_m", F.round("avg_power_w", 5).alias("avg_power_w"), "sport")


@query("agg_message_positions", """
WITH laps AS (SELECT l_orderkey AS file, l_linenumber AS ln, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq FROM lineitem)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS seq, round((600000000 + seq * 100000 + s) * (180e0 / 2147483648e0), 6) AS lat FROM laps WHERE file % 2 = 0 OR seq % 3 <> 0""")
def agg_message_positions(spark, sf):
    """Even files carry records; odd files only laps, some with the invalid marker."""
    from pyspark.sql import Window
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    li = fx.table(spark, sf, "lineitem").withColumn("seq", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)))
    record = F.col("l_orderkey") % 2 == 0
    lat = F.when(~record & (F.col("seq") % 3 == 0), F.lit(2147483647)).otherwise(600000000 + F.col("seq") * 100000 + F.col("l_suppkey"))
    fields = F.when(record, F.array(F.struct(F.lit(0).alias("field"), lat.alias("value")), F.struct(F.lit(1).alias("field"), F.lit(60000000).cast("bigint").alias("value")))) \
        .otherwise(F.array(F.struct(F.lit(3).alias("field"), lat.alias("value")), F.struct(F.lit(4).alias("field"), F.lit(60000000).cast("bigint").alias("value"))))
    rows = li.select(F.col("l_orderkey").alias("file"), "seq", F.when(record, 20).otherwise(19).alias("global"), F.explode(fields).alias("f")).select("file", "seq", "global", "f.field", "f.value")
    return messages.positions(rows).select("file", F.col("seq").cast("bigint").alias("seq"), F.round("lat", 6).alias("lat"))


@query("win_focus_region")
def win_focus_region(spark, sf):
    """Bounding region of each athlete's home-country tiles; checked in the tests."""
    seen = tiles.visited(tracks.tiles(fx.points(spark, sf)), columns=("x", "y"))
    index = cut(areas.cell_index(fx.area_rings(spark, sf), areas.COUNTRY_CELL, outer_only=True))
    return tiles.focus_region(seen, index, 1080 / 1920)


REVIEW_ACTS = """review_acts AS (SELECT athlete_id, activity_id, start_ts, 20000e0 + activity_id % 50 * 1000 AS distance_m, 3600e0 AS elapsed_s, 100e0 + activity_id % 30 AS ascent_m FROM (
  SELECT athlete_id, activity_id, start_ts - INTERVAL 1 DAY * (CASE WHEN activity_id % 10 < 3 THEN 40 ELSE 0 END) AS start_ts FROM fx_point_activities))"""


def review_activities(spark, sf):
    k = F.col("activity_id")
    acts = fx.point_activities(spark, sf)
    return (acts.withColumn("start_ts", F.when(k % 10 < 3, F.col("start_ts") - F.expr("INTERVAL 40 DAYS")).otherwise(F.col("start_ts"))).withColumn("distance_m", 20000.0 + k % 50 * 1000)
            .withColumn("elapsed_s", F.lit(3600.0)).withColumn("moving_s", F.lit(None).cast("double")).withColumn("ascent_m", 100.0 + k % 30).withColumn("descent_m", F.lit(None).cast("double"))
            .withColumn("is_zwift", F.lit(False)).withColumn("name", F.lit("Ride")))


@query("agg_year_in_review", fx.oracle(f"""
SELECT athlete_id, activities, km, hours, ascent, tiles_before, tiles_after - tiles_before AS new_tiles, square_before, square_after, eddington_before, eddington_after, new_areas FROM (
SELECT athlete_id, count(*) AS activities, round(sum(distance_m) / 1000, 6) AS km, round(sum(elapsed_s) / 3600, 6) AS hours, sum(ascent_m) AS ascent FROM review_acts WHERE year(start_ts) = 2024 GROUP BY 1)
LEFT JOIN (SELECT athlete_id, count(DISTINCT tile_key) FILTER (start_ts < TIMESTAMP '2024-01-01') AS tiles_before, count(DISTINCT tile_key) AS tiles_after FROM fx_activity_tiles JOIN review_acts USING (athlete_id, activity_id) GROUP BY 1) USING (athlete_id)
LEFT JOIN (SELECT athlete_id, coalesce(max(side) FILTER (NOT after), 0)::INTEGER AS square_before, coalesce(max(side) FILTER (after), 0)::INTEGER AS square_after FROM squares GROUP BY 1) USING (athlete_id)
LEFT JOIN (SELECT athlete_id, max(least(km, n)) FILTER (NOT after)::BIGINT AS eb, max(least(km, n)) FILTER (after)::BIGINT AS eddington_after, coalesce(max(least(km, n)) FILTER (NOT after), 0)::BIGINT AS eddington_before FROM edd GROUP BY 1) USING (athlete_id)
LEFT JOIN (SELECT athlete_id, count(*) FILTER (first >= TIMESTAMP '2024-01-01') AS new_areas FROM (SELECT athlete_id, code, min(start_ts) AS first FROM fx_dense p JOIN fx_area_rects r ON {INSIDE} JOIN review_acts a USING (athlete_id, activity_id) GROUP BY 1, 2) GROUP BY 1) USING (athlete_id)""",
P, AR, fx.ACTIVITY_TILES_SQL, REVIEW_ACTS, """at_cut AS (SELECT DISTINCT athlete_id, true AS after, tile_key // 4294967296 AS x, tile_key % 4294967296 AS y FROM fx_activity_tiles UNION
  SELECT DISTINCT athlete_id, false, tile_key // 4294967296, tile_key % 4294967296 FROM fx_activity_tiles JOIN review_acts USING (athlete_id, activity_id) WHERE start_ts < TIMESTAMP '2024-01-01'),
squares AS (SELECT a.athlete_id, a.after, s.s AS side, a.x, a.y FROM at_cut a CROSS JOIN range(1, 9) s(s) JOIN at_cut b ON b.athlete_id = a.athlete_id AND b.after = a.after AND b.x BETWEEN a.x - s.s + 1 AND a.x AND b.y BETWEEN a.y - s.s + 1 AND a.y
  GROUP BY ALL HAVING count(*) = s.s * s.s),
daily AS (SELECT athlete_id, start_ts::DATE AS day, sum(distance_m / 1000) AS k FROM review_acts GROUP BY 1, 2),
edd AS (SELECT athlete_id, after, floor(k) AS km, count(*) OVER (PARTITION BY athlete_id, after ORDER BY floor(k) DESC) AS n FROM daily, (VALUES (true), (false)) c(after) WHERE after OR day < DATE '2024-01-01')"""))
def agg_year_in_review(spark, sf):
    points = fx.points(spark, sf)
    index = cut(areas.cell_index(fx.area_rings(spark, sf)))
    facts = cut(areas.track_areas(points, index))
    out = review.year_in_review(review_activities(spark, sf), cut(tracks.tiles(points)), 2024, activity_areas=facts)
    return out.select("athlete_id", "activities", F.round("km", 6).alias("km"), F.round("hours", 6).alias("hours"), "ascent", "tiles_before", "new_tiles", "square_before", "square_after",
                      "eddington_before", "eddington_after", "new_areas")


def _first_year(name, facts, column):
    """Oracle: ids whose first activity lies in 2024."""
    return f"LEFT JOIN (SELECT athlete_id, count(*) FILTER (first >= TIMESTAMP '2024-01-01') AS {name} FROM (SELECT f.athlete_id, {column}, min(start_ts) AS first FROM ({facts}) f JOIN review_acts USING (athlete_id, activity_id) GROUP BY 1, 2) GROUP BY 1) USING (athlete_id)"


@query("agg_year_new", fx.oracle("SELECT athlete_id, coalesce(new_countries, 0) AS new_countries, coalesce(new_climbs, 0) AS new_climbs, coalesce(new_items, 0) AS new_items, coalesce(new_routes, 0) AS new_routes, coalesce(cluster_before, 0) AS cluster_before, coalesce(cluster_after, 0) AS cluster_after FROM (SELECT DISTINCT athlete_id FROM review_acts WHERE year(start_ts) = 2024) "
    + _first_year("new_countries", "SELECT DISTINCT athlete_id, activity_id, split_part(code, ':', 1) AS country FROM fx_points p JOIN fx_area_rects r ON " + INSIDE.replace("r.holed", "false"), "country")
    + _first_year("new_climbs", CLIMB_MATCH_SQL, "climb_id") + _first_year("new_items", "SELECT athlete_id, activity_id, item_id FROM fx_visits", "item_id") + """
LEFT JOIN (SELECT athlete_id, count(*) FILTER (at_end >= 0.9e0 * total AND at_start < 0.9e0 * total) AS new_routes FROM (SELECT athlete_id, route_id, count(DISTINCT idx) AS at_end, count(DISTINCT idx) FILTER (start_ts < TIMESTAMP '2024-01-01') AS at_start
  FROM fx_hits JOIN review_acts USING (athlete_id, activity_id) WHERE start_ts < TIMESTAMP '2025-01-01' GROUP BY 1, 2) JOIN (SELECT route_id, count(*) AS total FROM fx_checkpoints GROUP BY 1) USING (route_id) GROUP BY 1) USING (athlete_id)
LEFT JOIN (SELECT athlete_id, max(size) FILTER (NOT after)::BIGINT AS cluster_before, max(size) FILTER (after)::BIGINT AS cluster_after FROM (SELECT athlete_id, after, label, count(*) AS size FROM (
  SELECT i.athlete_id, i.after, i.x, i.y, min(r.tx * 100000 + r.ty) AS label FROM inner_tiles i JOIN reach r USING (athlete_id, after, x, y) GROUP BY ALL) GROUP BY ALL) GROUP BY 1) USING (athlete_id)""",
    *HIT_CTES, AR, fx.ACTIVITY_TILES_SQL, fx.PLACES_SQL, VISITS_SQL, REVIEW_ACTS, """at_cut AS (SELECT DISTINCT athlete_id, true AS after, tile_key // 4294967296 AS x, tile_key % 4294967296 AS y FROM fx_activity_tiles UNION
  SELECT DISTINCT athlete_id, false, tile_key // 4294967296, tile_key % 4294967296 FROM fx_activity_tiles JOIN review_acts USING (athlete_id, activity_id) WHERE start_ts < TIMESTAMP '2024-01-01'),
inner_tiles AS (SELECT t.* FROM at_cut t WHERE (SELECT count(*) FROM at_cut n WHERE n.athlete_id = t.athlete_id AND n.after = t.after AND abs(n.x - t.x) + abs(n.y - t.y) = 1) = 4),
reach AS (SELECT athlete_id, after, x, y, x AS tx, y AS ty FROM inner_tiles UNION SELECT r.athlete_id, r.after, n.x, n.y, r.tx, r.ty FROM reach r JOIN inner_tiles n ON n.athlete_id = r.athlete_id AND n.after = r.after AND abs(n.x - r.x) + abs(n.y - r.y) = 1)""", recursive=True))
def agg_year_new(spark, sf):
    """What the year brought: countries, climbs, items and routes that were new, and the cluster's growth."""
    points, acts = fx.points(spark, sf), review_activities(spark, sf)
    marks = cut(nearby.route_checkpoints(fx.routes(spark, sf), 50.0))
    twins = cut(nearby.same_checkpoints(marks))
    once = cut(marks.join(twins.filter("route_id = same").select("route_id"), "route_id", "left_semi"))
    copies = copies_of(twins.select(F.col("same").alias("route_id")), "route_id")
    counts = once.groupBy("route_id").agg(F.count("*").alias("total")).join(copies, "route_id")
    climbed = nearby.first_climb_matches(points, marks.withColumnRenamed("route_id", "climb_id"), twins.withColumnRenamed("route_id", "climb_id")).join(copies.withColumnRenamed("route_id", "climb_id"), "climb_id")
    places = fx.places(spark, sf)
    same = cut(challenge_results.same_items(places))
    visits = nearby.place_visits(points, challenge_results.first_items(places, same)).withColumn("item_id", F.col("item_id").cast("string"))
    visits = visits.join(copies_of(same.select("challenge_id", F.col("same").alias("item_id")), "challenge_id", "item_id"), ["challenge_id", "item_id"])
    countries = areas.track_countries(points, areas.cell_index(fx.area_rings(spark, sf), areas.COUNTRY_CELL, outer_only=True))
    out = review.year_in_review(acts, cut(tracks.tiles(points)), 2024, activity_countries=cut(countries), activity_climbs=climbed,
                                challenge_hits=visits, checkpoint_hits=nearby.checkpoint_hits(points, once), checkpoint_counts=counts)
    return out.select("athlete_id", "new_countries", "new_climbs", "new_items", "new_routes", F.col("cluster_before").cast("bigint").alias("cluster_before"), F.col("cluster_after").cast("bigint").alias("cluster_after"))


@query("agg_review_years", fx.oracle("SELECT DISTINCT athlete_id, year(start_ts)::INTEGER AS year FROM fx_activities", A))
def agg_review_years(spark, sf):
    return review.years(fx.activities(spark, sf))


PLAN_ACTS_SQL = """acts AS (SELECT *, (['Cycling', 'Running', 'Walking'])[activity_id % 3 + 1] AS kind_of FROM fx_point_activities WHERE activity_id % 11 <> 0),
plan_lines AS (SELECT DISTINCT route_id FROM fx_crossings)"""


def plan_activities(spark, sf):
    k = F.col("activity_id")
    return fx.point_activities(spark, sf).withColumn("sport", F.element_at(F.array(*map(F.lit, ["Cycling", "Running", "Walking"])), (k % 3 + 1).cast("int"))).withColumn("is_virtual", k % 11 == 0)


@query("plan_challenges", fx.oracle(f"""
SELECT athlete_id, challenge_id, coalesce(done, 0) AS done, CASE WHEN done IS NOT NULL THEN total END AS total, checked FROM (
  SELECT athlete_id, challenge_id, count(*) AS checked FROM acts, (VALUES ('places'), ('ferries'), ('trails')) c(challenge_id) GROUP BY ALL) LEFT JOIN (
  SELECT v.athlete_id, 'places' AS challenge_id, count(DISTINCT item_id) AS done, (SELECT count(*) FROM supplier) AS total FROM fx_visits v JOIN acts USING (athlete_id, activity_id) GROUP BY 1
  UNION ALL SELECT athlete_id, 'ferries', count(DISTINCT route_id), (SELECT count(*) FROM part) FROM (
    SELECT p.athlete_id, p.activity_id, route_id FROM fx_dense_next p JOIN acts USING (athlete_id, activity_id) JOIN anchors pl ON abs(p.lat - pl.lat) < 0.01 AND {fx.d_segment_distance("pl.lat", "pl.lon", "p.lat", "p.lon", "p.lat2", "p.lon2")} <= pl.radius
    WHERE lat2 IS NOT NULL AND kind_of = 'Cycling' GROUP BY 1, 2, 3 HAVING count(DISTINCT k) = 3) GROUP BY 1
  UNION ALL SELECT athlete_id, 'trails', count(*), (SELECT count(*) FROM part) FROM (
    SELECT h.athlete_id, route_id FROM fx_hits h JOIN acts USING (athlete_id, activity_id) JOIN (SELECT route_id, count(*) AS total FROM fx_checkpoints GROUP BY 1) USING (route_id)
    WHERE kind_of <> 'Running' GROUP BY 1, 2 HAVING count(DISTINCT idx) >= 0.5e0 * any_value(total)) GROUP BY 1) USING (athlete_id, challenge_id)""",
    *HIT_CTES, fx.DENSE_TILES, fx.PLACES_SQL, VISITS_SQL, fx.CROSSINGS_SQL, CROSS_SQL, PLAN_ACTS_SQL))
def plan_challenges(spark, sf):
    """Half of the activities and another set of challenges first, then everything: results that are
    stored and still hold are not matched again."""
    acts, points = cut(plan_activities(spark, sf)), fx.points(spark, sf)
    r = F.col("r_regionkey")

    def pick(*values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), r + 1)

    both = fx.table(spark, sf, "region").select(pick("places", "ferries", "trails", "gone", "unused").alias("challenge_id"), pick("k2", "k1", "k1", "k1", "k1").alias("key"), pick("locations", "routes", "routes", "locations", "locations").alias("kind"),
                                                pick("cover", "cross", "cover", "cover", "cover").alias("complete"), F.lit(50.0).alias("spacing"), F.lit(0.5).alias("coverage"),
                                                F.when(r == 1, F.array(F.lit("Cycling"))).when(r == 2, F.array(F.lit("Cycling"), F.lit("Walking"))).alias("sports"))
    places = fx.places(spark, sf)
    places = places.unionByName(places.withColumn("challenge_id", F.lit("gone")))
    lines = (fx.crossings(spark, sf).select(F.lit("ferries").alias("challenge_id"), F.col("route_id").alias("item_id"), F.lit(0).alias("piece"), "seq", "lat", "lon")
             .unionByName(fx.routes(spark, sf).select(F.lit("trails").alias("challenge_id"), F.col("route_id").alias("item_id"), "piece", "seq", "lat", "lon")))
    before = both.filter("challenge_id <> 'unused'").withColumn("key", F.lit("k1"))
    first = challenge_results.update(challenge_results.empty(spark), acts.filter("activity_id % 2 = 0"), points, before, places, lines)
    now = both.filter("challenge_id not in ('gone', 'unused')")
    return challenge_results.standing(challenge_results.update(first, acts, points, now, places, lines), now, places, lines)


@query("plan_refresh", fx.oracle("""
SELECT athlete_id, activities, files, coalesce(tiles, 0) AS tiles, coalesce(areas, 0) AS areas, coalesce(square, 0) AS square, coalesce(cluster, 0) AS cluster, coalesce(climbs, 0) AS climbs, coalesce(eddington, 0) AS eddington FROM (
  SELECT athlete_id, count(*) AS activities, (count(*) + count(*) FILTER (activity_id % 4 = 0))::BIGINT AS files FROM fx_point_activities GROUP BY 1)
LEFT JOIN (SELECT athlete_id, count(*) AS tiles FROM lib_tiles GROUP BY 1) USING (athlete_id)
LEFT JOIN (SELECT athlete_id, count(DISTINCT code) AS areas FROM fx_dense p JOIN fx_area_rects r ON """ + INSIDE + """ WHERE activity_id % 7 <> 0 GROUP BY 1) USING (athlete_id)
LEFT JOIN (SELECT athlete_id, max(side)::BIGINT AS square FROM squares GROUP BY 1) USING (athlete_id)
LEFT JOIN (SELECT athlete_id, max(size)::BIGINT AS cluster FROM (SELECT athlete_id, label, count(*) AS size FROM (SELECT i.athlete_id, i.x, i.y, min(r.tx * 100000 + r.ty) AS label FROM inner_tiles i JOIN reach r USING (athlete_id, x, y) GROUP BY ALL) GROUP BY ALL) GROUP BY 1) USING (athlete_id)
LEFT JOIN (SELECT athlete_id, count(DISTINCT climb_id) AS climbs FROM (""" + CLIMB_MATCH_SQL + """) WHERE activity_id % 7 <> 0 GROUP BY 1) USING (athlete_id)
LEFT JOIN (SELECT athlete_id, max(least(km, n))::BIGINT AS eddington FROM (SELECT athlete_id, floor(k) AS km, count(*) OVER (PARTITION BY athlete_id ORDER BY floor(k) DESC) AS n FROM (
  SELECT athlete_id, (start_ts + to_seconds(CASE WHEN activity_id % 4 = 0 THEN 60 ELSE 0 END))::DATE AS day, sum(activity_id * 7919 % 90000 / 1000e0) AS k FROM fx_point_activities GROUP BY 1, 2)) GROUP BY 1) USING (athlete_id)""",
    *HIT_CTES, AR, fx.ACTIVITY_TILES_SQL, """lib_tiles AS (SELECT DISTINCT athlete_id, tile_key // 4294967296 AS x, tile_key % 4294967296 AS y FROM fx_activity_tiles WHERE activity_id % 7 <> 0),
squares AS (SELECT a.athlete_id, s.s AS side, a.x, a.y FROM lib_tiles a CROSS JOIN range(1, 9) s(s) JOIN lib_tiles b ON b.athlete_id = a.athlete_id AND b.x BETWEEN a.x - s.s + 1 AND a.x AND b.y BETWEEN a.y - s.s + 1 AND a.y
  GROUP BY ALL HAVING count(*) = s.s * s.s),
inner_tiles AS (SELECT t.* FROM lib_tiles t WHERE (SELECT count(*) FROM lib_tiles n WHERE n.athlete_id = t.athlete_id AND abs(n.x - t.x) + abs(n.y - t.y) = 1) = 4),
reach AS (SELECT athlete_id, x, y, x AS tx, y AS ty FROM inner_tiles UNION SELECT r.athlete_id, n.x, n.y, r.tx, r.ty FROM reach r JOIN inner_tiles n ON n.athlete_id = r.athlete_id AND abs(n.x - r.x) + abs(n.y - r.y) = 1)""", recursive=True))
def plan_refresh(spark, sf):
    """A fourth of the tracks has a second file a minute later; new names make a seventh virtual."""
    k = F.col("activity_id")
    acts = fx.point_activities(spark, sf).select(
        "athlete_id", "activity_id", "start_ts", "sport", (k * 7919 % 90000).cast("double").alias("distance_m"), F.lit(3600.0).alias("elapsed_s"), F.lit(None).cast("double").alias("moving_s"), F.lit(None).cast("double").alias("ascent_m"),
        F.lit(None).cast("double").alias("descent_m"), F.lit(None).cast("double").alias("avg_power_w"), F.lit(1).alias("quality"), "is_virtual", F.lit(False).alias("is_zwift"), F.lit("ride").alias("name"), F.lit("feed").alias("source"),
        "n_points", k.cast("string").alias("file_name"))
    again = acts.filter(k % 4 == 0).withColumn("start_ts", F.timestamp_micros(F.unix_micros("start_ts") + 60_000_000)).withColumn("quality", F.lit(2)).withColumn("source", F.lit("file")).withColumn("file_name", F.concat(F.lit("again "), "file_name")).withColumn("activity_id", k + 1_000_000_000)
    points = fx.points(spark, sf)
    points = points.unionByName(points.filter(k % 4 == 0).withColumn("activity_id", k + 1_000_000_000))
    names = acts.filter(k % 7 == 0).select("file_name", F.lit("Zwift - evening").alias("new_name"))
    marks = nearby.route_checkpoints(fx.routes(spark, sf), 50.0).withColumnRenamed("route_id", "climb_id")
    return refresh.summary(refresh.refresh(acts.unionByName(again), points, names, fx.area_rings(spark, sf), marks))
