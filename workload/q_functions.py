"""Scalar functions applied to whole tables."""

from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.functions import geo, health
from wayfold.functions.sql import register
from workload import fixtures as fx
from workload.registry import query

P, A = fx.POINTS_SQL, fx.ACTIVITIES_SQL
TX, TY = fx.d_tile_x("lon"), fx.d_tile_y("lat")


@query("fn_tile_xy", fx.oracle(f"SELECT activity_id, seq, {TX}::INTEGER AS x, {TY}::INTEGER AS y FROM fx_points", P))
def fn_tile_xy(spark, sf):
    t = geo.tile_xy("lat", "lon")
    return fx.points(spark, sf).select("activity_id", F.col("seq").cast("bigint").alias("seq"), t["x"].alias("x"), t["y"].alias("y"))


@query("fn_tile_key", fx.oracle("SELECT athlete_id, x::BIGINT * 4294967296 + y AS tile_key, x AS back_x, y AS back_y FROM fx_visited_tiles", fx.TILES_SQL))
def fn_tile_key(spark, sf):
    keyed = fx.visited_tiles(spark, sf).select("athlete_id", geo.tile_key("x", "y").alias("tile_key"))
    back = geo.tile_unkey("tile_key")
    return keyed.select("athlete_id", "tile_key", back["x"].alias("back_x"), back["y"].alias("back_y"))


@query("fn_tile_corner", fx.oracle("""
SELECT athlete_id, x, y, round(degrees(atan(sinh(pi() * (1 - 2e0 * y / 16384e0)))), 6) AS lat, round(x / 16384e0 * 360 - 180, 6) AS lon,
  round(degrees(atan(sinh(pi() * (1 - 2e0 * (y + 0.5e0) / 16384e0)))), 6) AS mid_lat, round((x + 0.5e0) / 16384e0 * 360 - 180, 6) AS mid_lon FROM fx_visited_tiles""", fx.TILES_SQL))
def fn_tile_corner(spark, sf):
    a, b = geo.tile_corner("x", "y"), geo.tile_center("x", "y")
    return fx.visited_tiles(spark, sf).select("athlete_id", "x", "y", F.round(a["lat"], 6).alias("lat"), F.round(a["lon"], 6).alias("lon"),
                                              F.round(b["lat"], 6).alias("mid_lat"), F.round(b["lon"], 6).alias("mid_lon"))


@query("fn_distance_m", fx.oracle(f"SELECT activity_id, seq, round({fx.d_distance('lat', 'lon', '52.1e0', '5.1e0')}, 4) AS metres FROM fx_points", P))
def fn_distance_m(spark, sf):
    return fx.points(spark, sf).select("activity_id", F.col("seq").cast("bigint").alias("seq"), F.round(geo.distance_m("lat", "lon", 52.1, 5.1), 4).alias("metres"))


@query("fn_segment_distance_m", fx.oracle(f"""
SELECT activity_id, seq, round({fx.d_segment_distance('lat', 'lon', '52.0e0', '5.0e0', '52.1e0', '5.2e0')}, 4) AS metres FROM fx_points""", P))
def fn_segment_distance_m(spark, sf):
    return fx.points(spark, sf).select("activity_id", F.col("seq").cast("bigint").alias("seq"), F.round(geo.segment_distance_m("lat", "lon", 52.0, 5.0, 52.1, 5.2), 4).alias("metres"))


TYPES = ["Ride", "VirtualRide", "EBikeRide", "TrailRun", "Walk", "Hike", "Swim", "NordicSki", "Snowboard", "VirtualRow", "InlineSkate", "Yoga"]
TYPE_SQL = "([" + ", ".join(f"'{t}'" for t in TYPES) + "])[k % 12 + 1]"
FEED_CASE = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fa.FEED_SPORTS.items()) + " ELSE 'Activity' END"
CODE_CASE = "CASE k % 60 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fa.CODE_SPORTS.items()) + " ELSE 'Activity' END"


def typed(spark, sf):
    k = F.col("o_orderkey")
    return fx.table(spark, sf, "orders").select(k.alias("k"), F.element_at(F.array(*map(F.lit, TYPES)), (k % 12 + 1).cast("int")).alias("t"))


@query("fn_sport_from_feed", f"SELECT k, {FEED_CASE} AS sport FROM (SELECT o_orderkey AS k, {TYPE_SQL.replace('k %', 'o_orderkey %')} AS t FROM orders)")
def fn_sport_from_feed(spark, sf):
    return typed(spark, sf).select("k", fa.sport_from_feed("t").alias("sport"))


@query("fn_sport_from_code", f"SELECT k, {CODE_CASE} AS sport FROM (SELECT o_orderkey AS k FROM orders)")
def fn_sport_from_code(spark, sf):
    return typed(spark, sf).select("k", fa.sport_from_code(F.col("k") % 60).alias("sport"))


@query("fn_is_virtual", f"""
SELECT k, starts_with(t, 'Virtual') OR k % 17 = 0 OR k % 5 = 0 OR k % 70 IN (1, 6, 14, 58) OR k % 300 = 260 AS is_virtual FROM (SELECT o_orderkey AS k, {TYPE_SQL.replace('k %', 'o_orderkey %')} AS t FROM orders)""")
def fn_is_virtual(spark, sf):
    k = F.col("k")
    words = F.element_at(F.array(*map(F.lit, ["Zwift race", "rouvy", "Fulgaz tour", "Wahoo SYSTM", "Kinomap", "INDOOR"])), (k % 6 + 1).cast("int"))
    named = typed(spark, sf).withColumn("name", F.when(k % 5 == 0, words).otherwise(F.lit("Morning ride")))
    flags = fa.is_virtual("name", "t", F.when(k % 17 == 0, True).when(k % 17 == 1, F.lit(None)).otherwise(False), k % 70, k % 300)
    return named.select("k", flags.alias("is_virtual"))


@query("fn_is_on_map", fx.oracle("SELECT activity_id, NOT is_virtual AND quality > 0 AS on_map FROM fx_activities", A))
def fn_is_on_map(spark, sf):
    return fx.activities(spark, sf).select("activity_id", fa.is_on_map("is_virtual", F.col("quality") * 7).alias("on_map"))


@query("fn_duration", fx.oracle("""
SELECT activity_id, round(CASE WHEN moving_s > 0 THEN moving_s ELSE elapsed_s END, 3) AS seconds,
  round(CASE WHEN distance_m > 0 THEN distance_m / CASE WHEN moving_s > 0 THEN moving_s ELSE elapsed_s END END, 6) AS speed FROM fx_activities""", A))
def fn_duration(spark, sf):
    return fx.activities(spark, sf).select("activity_id", F.round(fa.duration(), 3).alias("seconds"), F.round(fa.avg_speed(), 6).alias("speed"))


@query("fn_quality", fx.oracle("SELECT activity_id, CASE WHEN activity_id % 4 = 0 THEN 0 WHEN activity_id % 3 = 0 THEN 1 ELSE 2 END AS q FROM fx_activities", A))
def fn_quality(spark, sf):
    k = F.col("activity_id")
    return fx.activities(spark, sf).select("activity_id", fa.quality(k % 4, k % 3 == 0).alias("q"))


@query("fn_details_text", fx.oracle("""
SELECT activity_id, concat_ws(' · ', CASE WHEN s >= 3600 THEN printf('%d:%02d:%02d', r // 3600, r // 60 % 60, r % 60) ELSE printf('%d:%02d', r // 60, r % 60) END,
  CASE WHEN distance_m > 0 THEN printf('%.1f km', round((distance_m / 1000)::DECIMAL(18,7), 1)::DOUBLE) END, CASE WHEN avg_power_w > 0 THEN printf('%.0f W', avg_power_w) WHEN distance_m > 0 THEN printf('%.1f km/h', round((distance_m / s * 3.6e0)::DECIMAL(18,9), 1)::DOUBLE) END) AS details
FROM (SELECT *, round_even(s, 0)::BIGINT AS r FROM (SELECT *, CASE WHEN moving_s > 0 THEN moving_s ELSE elapsed_s END AS s FROM fx_activities))""", A))
def fn_details_text(spark, sf):
    acts = fx.activities(spark, sf)
    return acts.select("activity_id", fa.details_text().alias("details"))


@query("fn_category", fx.oracle("""
SELECT activity_id, CASE WHEN sport IN ('Cycling', 'E-biking') THEN 'bike' WHEN sport = 'Running' THEN 'run' WHEN sport IN ('Walking', 'Hiking') THEN 'foot' ELSE 'other' END AS category FROM fx_activities""", A))
def fn_category(spark, sf):
    return fx.activities(spark, sf).select("activity_id", fa.category().alias("category"))


@query("fn_folded_contains", fx.oracle("SELECT activity_id, contains(strip_accents(lower(name)), 'uber pretzel') AS hit FROM fx_activities", A))
def fn_folded_contains(spark, sf):
    return fx.activities(spark, sf).select("activity_id", fa.folded_contains("name", "uber pretzel").alias("hit"))


@query("fn_slug", """
SELECT doc_id, CASE WHEN s = '' THEN 'challenge' WHEN length(s) > 64 THEN substring(s, 1, 55) || '-' || substring(sha256(s), 1, 8) ELSE s END AS slug FROM (
  SELECT doc_id, trim(regexp_replace(strip_accents(translate(replace(lower(text), 'œ', 'oe'), 'øđł', 'odl')), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM documents)""")
def fn_slug(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", fa.slug("text").alias("slug"))


@query("fn_content_name", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Ride-Strava-' || doc_id || '.fit' ELSE 'My ride ' || doc_id || '-' || substring(sha256(text), 1, 8) || '.fit' END AS file FROM documents""")
def fn_content_name(spark, sf):
    k = F.col("doc_id")
    name = F.when(k % 5 == 0, F.format_string("Ride-Strava-%d.fit", k)).when(k % 5 == 1, F.concat(F.format_string("My ride %d-", k), F.substring(F.sha2("text", 256), 1, 8), F.lit(".fit"))) \
        .otherwise(F.format_string("My:ride %d.FIT", k))
    return fx.table(spark, sf, "documents").select("doc_id", fa.content_name(name, "text").alias("file"))


@query("fn_area_codes", fx.oracle("""
SELECT code, poly, split_part(code, ':', 1) AS country, split_part(code, ':', 2) AS local, split_part(code, ':', 2) || ' ' || name AS label FROM fx_area_rects""", fx.AREAS_SQL))
def fn_area_codes(spark, sf):
    a = fa.area_codes("code", "name")
    return fx.area_rings(spark, sf).select("code", "name", "poly").distinct().select("code", "poly", a["country"].alias("country"), a["local"].alias("local"), a["label"].alias("label"))


@query("fn_cell_1deg", """
SELECT c_custkey, CASE WHEN a >= 0 THEN 'n' ELSE 's' END || lpad(abs(a)::VARCHAR, 2, '0') || CASE WHEN o >= 0 THEN 'e' ELSE 'w' END || lpad(abs(o)::VARCHAR, 3, '0') AS cell
FROM (SELECT c_custkey, floor((c_custkey * 37 % 1600) / 10e0 - 80)::INTEGER AS a, floor((c_custkey * 53 % 3600) / 10e0 - 180)::INTEGER AS o FROM customer)""")
def fn_cell_1deg(spark, sf):
    k = F.col("c_custkey")
    return fx.table(spark, sf, "customer").select("c_custkey", geo.cell_1deg((k * 37 % 1600) / 10 - 80, (k * 53 % 3600) / 10 - 180).alias("cell"))


@query("fn_climb_category", """
SELECT p_partkey, CASE WHEN a < 3 THEN NULL WHEN l * a >= 80000 THEN 'HC' WHEN l * a >= 64000 THEN '1' WHEN l * a >= 32000 THEN '2' WHEN l * a >= 16000 THEN '3' WHEN l * a >= 8000 THEN '4'
  WHEN l >= 300 AND a >= 5 THEN 'hill' END AS cat FROM (SELECT p_partkey, (p_partkey * 97 % 12000)::DOUBLE AS l, (p_partkey % 130) / 10e0 AS a FROM part)""")
def fn_climb_category(spark, sf):
    k = F.col("p_partkey")
    return fx.table(spark, sf, "part").select("p_partkey", fa.climb_category((k * 97 % 12000).cast("double"), (k % 130) / 10).alias("cat"))


GRADE_ROWS = "(SELECT p_partkey AS k, ([NULL, 'Easy', 'expert', 'advanced', 'unknown', NULL])[p_partkey % 6 + 1] AS word, ([NULL, '0', '1+', '2-', '3', '4+', 'x'])[p_partkey % 7 + 1] AS imba, ([NULL, 'Blue', 'red', 'pink'])[p_partkey % 4 + 1] AS colour, ([ 'FR', 'NL', 'CH' ])[p_partkey % 3 + 1] AS country, (p_partkey * 379 % 90000)::DOUBLE AS metres, (p_partkey * 31 % 2000)::DOUBLE AS ascent, CASE WHEN p_partkey % 5 > 0 THEN (p_partkey % 30) / 10e0 END AS technical FROM part)"


@query("fn_route_grade", f"""
SELECT k, coalesce(posted, greatest(CASE WHEN e < 20 THEN 0 WHEN e < 40 THEN 1 WHEN e < 70 THEN 2 ELSE 3 END,
  CASE WHEN technical IS NULL THEN 0 WHEN technical >= 2.5 THEN 3 WHEN technical >= 1.5 THEN 2 WHEN technical >= 0.8 THEN 1 ELSE 0 END))::INTEGER AS grade, posted IS NOT NULL AS signposted
FROM (SELECT *, metres / 1000 + ascent / 100 AS e, CASE WHEN lower(word) = 'easy' THEN 0 WHEN word = 'expert' THEN 3 WHEN word = 'advanced' THEN 2 WHEN imba = '0' THEN 0 WHEN imba = '1+' THEN 1
  WHEN imba = '2-' THEN 1 WHEN imba = '3' THEN 2 WHEN imba = '4+' THEN 3 WHEN country <> 'NL' AND colour = 'Blue' THEN 1 WHEN country <> 'NL' AND colour = 'red' THEN 2 END AS posted FROM {GRADE_ROWS})""")
def fn_route_grade(spark, sf):
    k = F.col("p_partkey")

    def pick(values, n):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k % n + 1).cast("int"))

    tags = F.create_map(F.lit("mtb:difficulty"), pick([None, "Easy", "expert", "advanced", "unknown", None], 6), F.lit("mtb:scale:imba"), pick([None, "0", "1+", "2-", "3", "4+", "x"], 7),
                        F.lit("colour"), pick([None, "Blue", "red", "pink"], 4))
    g = fa.route_grade(tags, pick(["FR", "NL", "CH"], 3), (k * 379 % 90000).cast("double"), (k * 31 % 2000).cast("double"), F.when(k % 5 > 0, (k % 30) / 10))
    return fx.table(spark, sf, "part").select(k.alias("k"), g["grade"].alias("grade"), g["signposted"].alias("signposted"))


@query("fn_scale_parse", """
SELECT p_partkey, round(CASE p_partkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2.3e0 WHEN 2 THEN 2.7e0 WHEN 3 THEN NULL WHEN 4 THEN 0 END, 6)::DOUBLE AS scale FROM part""")
def fn_scale_parse(spark, sf):
    k = F.col("p_partkey")
    return fx.table(spark, sf, "part").select("p_partkey", F.round(fa.scale_parse(F.element_at(F.array(*[F.lit(v) for v in ("1", "2+", "3-", "hard", "0", None)]), (k % 6 + 1).cast("int"))), 6).alias("scale"))


@query("fn_item_title", """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 3 = 0 AND p_partkey % 5 > 0 AND p_brand <> p_type THEN p_brand || ' – ' || p_type
  WHEN p_partkey % 3 = 0 THEN 'Ferry at ' || p_brand WHEN p_partkey % 5 > 0 THEN 'Ferry at ' || p_type ELSE 'Ferry' END AS ferry,
  CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 3 = 0 THEN 'Climb near ' || p_brand ELSE 'Climb' END AS climb FROM part""")
def fn_item_title(spark, sf):
    k = F.col("p_partkey")
    name, a, b = F.when(k % 4 == 0, F.col("p_name")), F.when(k % 3 == 0, F.col("p_brand")), F.when(k % 5 > 0, F.col("p_type"))
    return fx.table(spark, sf, "part").select("p_partkey", fa.ferry_title(name, a, b).alias("ferry"), fa.climb_title(name, a).alias("climb"))


@query("fn_json_metric", """
SELECT event_id, event_id * 7 % 20000 AS steps, CASE WHEN event_id % 2 = 0 THEN 8000 ELSE 9000 END::BIGINT AS goal, 20000 + event_id % 9000 AS sleep_s, event_id % 100 AS score,
  CASE WHEN event_id % 3 = 0 THEN event_id % 77 ELSE event_id % 88 END AS battery FROM events""")
def fn_json_metric(spark, sf):
    """JSON in the differing shapes of steps, sleep and battery reports, built from ``events``."""
    k = F.col("event_id")
    t = fx.table(spark, sf, "events").select(
        k, F.when(k % 2 == 0, F.format_string('[{"totalSteps": %d, "stepGoal": 8000}]', k * 7 % 20000)).otherwise(F.format_string('{"values": [{"totalSteps": %d, "dailyStepGoal": 9000}]}', k * 7 % 20000)).alias("a"),
        F.when(k % 3 == 0, F.format_string('{"dailySleepDTO": {"sleepTimeSeconds": %d, "sleepScores": {"overall": {"value": %d}}}}', 20000 + k % 9000, k % 100))
        .when(k % 3 == 1, F.format_string('{"sleepTimeSeconds": %d, "overallSleepScore": {"value": %d}}', 20000 + k % 9000, k % 100))
        .otherwise(F.format_string('[{"sleepTimeSeconds": %d, "sleepScore": %d}]', 20000 + k % 9000, k % 100)).alias("b"),
        F.when(k % 3 == 0, F.format_string('[{"bodyBatteryValuesArray": [[1, 5], [2, %d], [3, null]]}]', k % 77))
        .otherwise(F.format_string('[{"bodyBatteryValuesArray": [[1, "MEASURED", 4, 9], [2, "MEASURED", 3, %d]], "bodyBatteryValueDescriptorDTOList": [{"bodyBatteryValueDescriptorIndex": 0, "bodyBatteryValueDescriptorKey": "timestamp"}, {"bodyBatteryValueDescriptorIndex": 3, "bodyBatteryValueDescriptorKey": "bodyBatteryLevel"}]}]', k % 88)).alias("c"))
    return t.select("event_id", health.steps("a")["count"].alias("steps"), health.steps("a")["goal"].alias("goal"), health.sleep("b")["seconds"].alias("sleep_s"),
                    health.sleep("b")["score"].alias("score"), health.body_battery("c")["level"].alias("battery"))


@query("fn_sql_functions", fx.oracle(f"""
SELECT activity_id, seq, {TX} * 4294967296 + {TY} AS tile_key, round({fx.d_distance('lat', 'lon', '52.1e0', '5.1e0')}, 4) AS metres, 'n' || lpad(floor(lat)::INTEGER::VARCHAR, 2, '0') || 'e' || lpad(floor(lon)::INTEGER::VARCHAR, 3, '0') AS cell FROM fx_points""", P))
def fn_sql_functions(spark, sf):
    register(spark)
    return fx.points(spark, sf).selectExpr("activity_id", "cast(seq as bigint) as seq", "wf_tile_key(wf_tile_x(lon), wf_tile_y(lat)) as tile_key",
                                           "round(wf_distance_m(lat, lon, 52.1D, 5.1D), 4) as metres", "wf_cell_1deg(lat, lon) as cell")


@query("flt_sport", fx.oracle("""
SELECT activity_id, s.c AS challenge_id FROM fx_activities a JOIN (VALUES (1, ['Cycling', 'E-biking']), (2, ['Running']), (3, NULL)) s(c, sports) ON s.sports IS NULL OR list_contains(s.sports, a.sport)""", A))
def flt_sport(spark, sf):
    challenges = F.array(*[F.struct(F.lit(c).alias("challenge_id"), (F.array(*map(F.lit, s)) if s else F.lit(None).cast("array<string>")).alias("sports")) for c, s in ((1, ["Cycling", "E-biking"]), (2, ["Running"]), (3, None))])
    rows = fx.activities(spark, sf).select("activity_id", "sport", F.explode(challenges).alias("c"))
    return rows.filter(fa.sport_counts("c.sports", "sport")).select("activity_id", "c.challenge_id")


@query("flt_signposted", """
SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 < 4 AND p_partkey % 11 <> 0 AND p_partkey % 13 NOT IN (0, 1) AND p_partkey % 3 < 2""")
def flt_signposted(spark, sf):
    k = F.col("p_partkey")
    tags = F.create_map(F.lit("type"), F.lit("route"), F.lit("route"), F.when(k % 7 != 0, "mtb").otherwise("road"), F.lit("network"), F.element_at(F.array(*map(F.lit, ["lcn", "rcn", "ncn", "mtb", "iwn"])), (k % 5 + 1).cast("int")),
                        F.lit("unsigned"), F.when(k % 11 == 0, "yes").otherwise("no"), F.lit("state"), F.when(k % 13 == 0, "proposed").when(k % 13 == 1, "disused:2020").otherwise(""),
                        F.lit("name"), F.when(k % 3 == 0, F.col("p_name")), F.lit("ref"), F.when(k % 3 == 1, F.lit("R1")))
    return fx.table(spark, sf, "part").filter(fa.is_signposted(tags)).select("p_partkey")


@query("flt_bbox_overlap", fx.oracle("""
SELECT a.activity_id, s.item_id FROM boxes a JOIN fx_places s ON s.lat BETWEEN min_lat - 2000 / 111000e0 AND max_lat + 2000 / 111000e0
  AND s.lon BETWEEN min_lon - 2000 / 111000e0 / greatest(cos(radians(s.lat)), 0.2e0) AND max_lon + 2000 / 111000e0 / greatest(cos(radians(s.lat)), 0.2e0)""", P, fx.PLACES_SQL,
"boxes AS (SELECT activity_id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM fx_points GROUP BY 1)"))
def flt_bbox_overlap(spark, sf):
    """Track boxes meet places in shared cells of 0.1 degrees, then the exact box test applies."""
    from wayfold.operators import tracks
    size, pad = 0.1, 0.04
    boxes = tracks.bbox(fx.points(spark, sf), ["activity_id"])
    spread = (boxes.withColumn("cy", F.explode(F.sequence(geo.cell(F.col("min_lat") - pad, size), geo.cell(F.col("max_lat") + pad, size))))
              .withColumn("cx", F.explode(F.sequence(geo.cell(F.col("min_lon") - pad, size), geo.cell(F.col("max_lon") + pad, size)))))
    places = fx.places(spark, sf).select("item_id", "lat", "lon", geo.cell("lat", size).alias("cy"), geo.cell("lon", size).alias("cx"))
    box = {c: c for c in ("min_lat", "max_lat", "min_lon", "max_lon")}
    point = {"min_lat": "lat", "max_lat": "lat", "min_lon": "lon", "max_lon": "lon"}
    return spread.join(places, ["cy", "cx"]).filter(geo.boxes_overlap(box, point, 2000.0, F.col("lat"))).select("activity_id", "item_id")
