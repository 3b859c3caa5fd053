"""Tracks, activities, areas, places and routes derived from the driver's tables.

Every view exists twice: as a DataFrame and as a DuckDB common table expression with the same
arithmetic, so each query can be compared with SQL on the same input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import ordered


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


SPORT_CYCLE = ["Cycling", "Running", "Cycling", "Walking", "E-biking", "Swimming", "Cycling", "Skiing"]


def activities(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k")
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("day"))
    base = base.select("k", (F.unix_micros("day") + k * 7919 % 86400 * 1_000_000).alias("start_us"))
    shaped = base.select(
        k.alias("activity_id"), F.floor(k / 1500).alias("athlete_id"), F.timestamp_micros("start_us").alias("start_ts"),
        F.element_at(F.array(*map(F.lit, SPORT_CYCLE)), (k % 8 + 1).cast("int")).alias("sport"),
        (k * 104729 % 1800000 / 10).alias("distance_m"), (600 + k * 6151 % 30000).cast("double").alias("elapsed_s"),
        F.when(k % 5 != 0, (600 + k * 6151 % 30000) * F.lit(0.9)).alias("moving_s"),
        F.when(k % 7 != 0, (k * 6131 % 6000).cast("double")).alias("ascent_m"),
        F.when(k % 8 == 7, (k * 5431 % 2500).cast("double")).alias("descent_m"),
        F.when(k % 3 == 0, (k % 400).cast("double")).alias("avg_power_w"),
        (k % 3).cast("int").alias("quality"), (k % 11 == 0).alias("is_virtual"), (k % 13 == 0).alias("is_zwift"),
        F.when(k % 97 == 0, F.lit("Zwift - Über Pretzel")).otherwise(F.concat(F.lit("Ride "), k.cast("string"))).alias("name"),
        F.lit("feed").alias("source"))
    again = F.col("activity_id") % 10 == 0
    copies = F.struct(
        (F.col("activity_id") + 1_000_000_000).alias("activity_id"), "athlete_id",
        F.timestamp_micros(F.unix_micros("start_ts") + 180_000_000).alias("start_ts"), "sport",
        (F.col("distance_m") * 0.98).alias("distance_m"), (F.col("elapsed_s") - 200).alias("elapsed_s"),
        F.lit(None).cast("double").alias("moving_s"), "ascent_m", "descent_m", "avg_power_w", F.lit(2).alias("quality"),
        "is_virtual", "is_zwift", F.concat(F.lit("file "), F.col("activity_id").cast("string")).alias("name"),
        F.lit("file").alias("source"))
    own = F.struct(*shaped.columns)
    return shaped.select(F.explode(F.when(again, F.array(own, copies)).otherwise(F.array(own))).alias("a")).select("a.*")


def visited_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the rows fill a dense block of 40 x 40 tiles, the others lie thinly in a wider one."""
    o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    a, b, dense = p * 7 + n * 13, s * 3 + F.floor(o / 10), (p + o) % 2 == 0
    return table(spark, sf, "lineitem").select(
        F.floor(o / 1500).alias("athlete_id"), F.when(dense, 8400 + a % 40).otherwise(8500 + a % 80).cast("int").alias("x"),
        F.when(dense, 5400 + b % 40).otherwise(5500 + b % 80).cast("int").alias("y")).distinct()


def points(spark: SparkSession, sf: str, with_time: bool = False) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("athlete_id"))
    ev = ev.withColumn("activity_id", F.col("athlete_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 6))
    numbered = ordered.ordinals(ev, ["athlete_id", "activity_id"], ["ts", "event_id"], F.date_trunc("hour", "ts"), "seq")
    lat = F.lit(52.00013) + F.lit(0.004) * F.col("seq") + F.lit(0.01) * (F.col("athlete_id") % 20)
    lon = F.lit(5.00017) + F.lit(0.003) * F.col("seq") + F.lit(0.02) * ((F.col("athlete_id") + F.col("activity_id")) % 15)
    cols = ["athlete_id", "activity_id", F.col("seq").cast("int").alias("seq"), lat.alias("lat"), lon.alias("lon")]
    return numbered.select(*cols, *(["ts"] if with_time else []))


def point_activities(spark: SparkSession, sf: str) -> DataFrame:
    """One dated activity per track of ``points``."""
    ev = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("athlete_id"))
    ev = ev.withColumn("activity_id", F.col("athlete_id") * 10 + F.floor((F.dayofmonth("ts") - 1) / 6))
    return (ev.groupBy("athlete_id", "activity_id").agg(F.min("ts").alias("start_ts"), F.count(F.lit(1)).alias("n_points"))
            .withColumn("sport", F.lit("Cycling")).withColumn("is_virtual", F.lit(False)))


def area_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Ring points of 5 x 5 rectangles; nation 12 has a hole and nation 7 a second polygon."""
    n = F.col("n_nationkey")
    base = table(spark, sf, "nation").select(
        F.concat(F.lit("C"), F.col("n_regionkey").cast("string"), F.lit(":"), n.cast("string")).alias("code"), F.col("n_name").alias("name"),
        n.alias("ordinal"), (F.lit(51.95037) + F.lit(0.08) * F.floor(n / 5)).alias("lat0"), (F.lit(4.95041) + F.lit(0.09) * (n % 5)).alias("lon0"))

    def rect(poly, ring, lat0, lat1, lon0, lon1):
        corners = [(lat0, lon0), (lat0, lon1), (lat1, lon1), (lat1, lon0)]
        return [F.struct(F.lit(poly).alias("poly"), F.lit(ring).alias("ring"), F.lit(i).alias("seq"), a.alias("lat"), o.alias("lon"))
                for i, (a, o) in enumerate(corners)]

    lat, lon = F.col("lat0"), F.col("lon0")
    outer = rect(0, 0, lat, lat + 0.08, lon, lon + 0.09)
    hole = rect(0, 1, lat + 0.08 / 3, lat + 0.16 / 3, lon + 0.03, lon + 0.06)
    second = rect(1, 0, lat + 0.5, lat + 0.58, lon + 0.5, lon + 0.59)
    shape = F.when(F.col("ordinal") == 12, F.array(*outer, *hole)).when(F.col("ordinal") == 7, F.array(*outer, *second)).otherwise(F.array(*outer))
    return base.select("code", "name", "ordinal", F.explode(shape).alias("p")).select("code", "name", "ordinal", "p.*")


def places(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.lit("places").alias("challenge_id"), s.alias("item_id"), (F.lit(52.0005) + (s * 37 % 300) / 1000).alias("lat"),
        (F.lit(5.0005) + (s * 53 % 350) / 1000).alias("lon"), F.lit(300.0).alias("radius"), F.col("s_name").alias("name"))


def routes(spark: SparkSession, sf: str) -> DataFrame:
    """Straight five-point lines; the length depends on the part's size."""
    p = F.col("p_partkey")
    base = table(spark, sf, "part").select(p.alias("route_id"), F.col("p_size").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("seq"))
    step = F.col("seq") * (1 + F.col("size") % 4)
    lat = F.lit(52.00013) + F.lit(0.004) * (F.col("route_id") % 40) + F.lit(0.001) * step
    lon = F.lit(5.00017) + F.lit(0.003) * (F.col("route_id") % 40) + F.lit(0.02) * (F.col("route_id") % 15) + F.lit(0.00075) * step
    return base.select("route_id", F.lit(0).alias("piece"), "seq", lat.alias("lat"), lon.alias("lon"))


def crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Two-point lines of about 300 m."""
    p = F.col("p_partkey")
    base = table(spark, sf, "part").select(p.alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("seq"))
    lat = F.lit(52.00113) + F.lit(0.004) * (F.col("route_id") % 40) + F.lit(0.0022) * F.col("seq")
    lon = F.lit(5.00092) + F.lit(0.003) * (F.col("route_id") % 40) + F.lit(0.02) * (F.col("route_id") % 15) + F.lit(0.00165) * F.col("seq")
    return base.select("route_id", "seq", lat.alias("lat"), lon.alias("lon"))


ACTIVITIES_SQL = """fx_base AS (
  SELECT o_orderkey AS k, o_orderdate + to_seconds(o_orderkey * 7919 % 86400) AS start_ts FROM orders),
fx_own AS (
  SELECT k AS activity_id, k // 1500 AS athlete_id, start_ts,
    (['Cycling','Running','Cycling','Walking','E-biking','Swimming','Cycling','Skiing'])[k % 8 + 1] AS sport,
    (k * 104729 % 1800000)::DOUBLE / 10e0 AS distance_m, (600 + k * 6151 % 30000)::DOUBLE AS elapsed_s,
    CASE WHEN k % 5 <> 0 THEN (600 + k * 6151 % 30000)::DOUBLE * 0.9e0 END AS moving_s,
    CASE WHEN k % 7 <> 0 THEN (k * 6131 % 6000)::DOUBLE END AS ascent_m,
    CASE WHEN k % 8 = 7 THEN (k * 5431 % 2500)::DOUBLE END AS descent_m,
    CASE WHEN k % 3 = 0 THEN (k % 400)::DOUBLE END AS avg_power_w,
    (k % 3)::INTEGER AS quality, k % 11 = 0 AS is_virtual, k % 13 = 0 AS is_zwift,
    CASE WHEN k % 97 = 0 THEN 'Zwift - Über Pretzel' ELSE 'Ride ' || k END AS name, 'feed' AS source
  FROM fx_base),
fx_activities AS (
  SELECT * FROM fx_own UNION ALL
  SELECT activity_id + 1000000000, athlete_id, start_ts + INTERVAL 180 SECOND, sport, distance_m * 0.98e0, elapsed_s - 200e0,
    NULL::DOUBLE, ascent_m, descent_m, avg_power_w, 2, is_virtual, is_zwift, 'file ' || activity_id, 'file'
  FROM fx_own WHERE activity_id % 10 = 0)"""

TILES_SQL = """fx_visited_tiles AS (
  SELECT DISTINCT athlete_id, CASE WHEN dense THEN 8400 + a % 40 ELSE 8500 + a % 80 END::INTEGER AS x, CASE WHEN dense THEN 5400 + b % 40 ELSE 5500 + b % 80 END::INTEGER AS y
  FROM (SELECT l_orderkey // 1500 AS athlete_id, l_partkey * 7 + l_linenumber * 13 AS a, l_suppkey * 3 + l_orderkey // 10 AS b, (l_partkey + l_orderkey) % 2 = 0 AS dense FROM lineitem))"""

POINTS_SQL = """fx_events AS (
  SELECT event_id, ts, user_id AS athlete_id, user_id * 10 + (day(ts) - 1) // 6 AS activity_id FROM events),
fx_seq AS (
  SELECT athlete_id, activity_id, ts, row_number() OVER (PARTITION BY athlete_id, activity_id ORDER BY ts, event_id) AS seq FROM fx_events),
fx_points AS (
  SELECT athlete_id, activity_id, seq, ts, 52.00013e0 + 0.004e0 * seq + 0.01e0 * (athlete_id % 20) AS lat,
    5.00017e0 + 0.003e0 * seq + 0.02e0 * ((athlete_id + activity_id) % 15) AS lon FROM fx_seq),
fx_point_activities AS (
  SELECT athlete_id, activity_id, min(ts) AS start_ts, count(*) AS n_points, 'Cycling' AS sport, false AS is_virtual FROM fx_events GROUP BY ALL)"""

AREAS_SQL = """fx_area_rects AS (
  SELECT 'C' || n_regionkey || ':' || n_nationkey AS code, n_name AS name, n_nationkey AS ordinal, 0 AS poly,
    51.95037e0 + 0.08e0 * (n_nationkey // 5) AS lat0, 4.95041e0 + 0.09e0 * (n_nationkey % 5) AS lon0, n_nationkey = 12 AS holed FROM nation
  UNION ALL
  SELECT 'C' || n_regionkey || ':' || n_nationkey, n_name, n_nationkey, 1, 51.95037e0 + 0.08e0 * (n_nationkey // 5) + 0.5e0,
    4.95041e0 + 0.09e0 * (n_nationkey % 5) + 0.5e0, false FROM nation WHERE n_nationkey = 7)"""

PLACES_SQL = """fx_places AS (
  SELECT 'places' AS challenge_id, s_suppkey AS item_id, 52.0005e0 + (s_suppkey * 37 % 300) / 1000e0 AS lat,
    5.0005e0 + (s_suppkey * 53 % 350) / 1000e0 AS lon, 300e0 AS radius, s_name AS name FROM supplier)"""

ROUTES_SQL = """fx_routes AS (
  SELECT p_partkey AS route_id, 0 AS piece, s.seq, 52.00013e0 + 0.004e0 * (p_partkey % 40) + 0.001e0 * (s.seq * (1 + p_size % 4)) AS lat,
    5.00017e0 + 0.003e0 * (p_partkey % 40) + 0.02e0 * (p_partkey % 15) + 0.00075e0 * (s.seq * (1 + p_size % 4)) AS lon
  FROM part, (SELECT unnest(range(5)) AS seq) s)"""

CROSSINGS_SQL = """fx_crossings AS (
  SELECT p_partkey AS route_id, s.seq, 52.00113e0 + 0.004e0 * (p_partkey % 40) + 0.0022e0 * s.seq AS lat,
    5.00092e0 + 0.003e0 * (p_partkey % 40) + 0.02e0 * (p_partkey % 15) + 0.00165e0 * s.seq AS lon
  FROM part, (SELECT unnest(range(2)) AS seq) s)"""


def d_distance(lat1, lon1, lat2, lon2) -> str:
    """DuckDB expression of the equirectangular distance."""
    return (f"sqrt(pow(({lon2} - {lon1}) * cos(radians(({lat1} + {lat2}) / 2e0)) * 111320e0, 2)"
            f" + pow(({lat2} - {lat1}) * 110574e0, 2))")


def d_segment_distance(plat, plon, alat, alon, blat, blon) -> str:
    k = f"(cos(radians({plat})) * 111320e0)"
    ax, ay = f"(({alon} - {plon}) * {k})", f"(({alat} - {plat}) * 110574e0)"
    dx, dy = f"(({blon} - {alon}) * {k})", f"(({blat} - {alat}) * 110574e0)"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {len2} > 0 THEN greatest(0e0, least(1e0, -({ax} * {dx} + {ay} * {dy}) / {len2})) ELSE 0e0 END)"
    return f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"


def d_tile_x(lon, zoom=14) -> str:
    n = 1 << zoom
    return f"greatest(0, least({n - 1}, floor(({lon} + 180e0) / 360e0 * {n}e0)::BIGINT))"


def d_tile_y(lat, zoom=14) -> str:
    n = 1 << zoom
    return f"greatest(0, least({n - 1}, floor((1e0 - ln(tan(radians({lat})) + 1e0 / cos(radians({lat}))) / pi()) / 2e0 * {n}e0)::BIGINT))"


def d_tile_key(lat, lon) -> str:
    return f"({d_tile_x(lon)} * 4294967296 + {d_tile_y(lat)})"


def d_dense(name: str, source: str, steps: str, keys: str = "athlete_id, activity_id") -> str:
    """CTE with the points of ``source`` cut into ``steps`` (over d) parts per segment."""
    d = d_distance("lat", "lon", "lat2", "lon2")
    return f"""{name}_next AS (
  SELECT *, {d} AS d FROM (
    SELECT *, lead(lat) OVER (PARTITION BY {keys} ORDER BY seq) AS lat2, lead(lon) OVER (PARTITION BY {keys} ORDER BY seq) AS lon2 FROM {source})),
{name} AS (
  SELECT * EXCLUDE (lat, lon, n), CASE WHEN sub = 0 THEN lat ELSE lat + (lat2 - lat) * (sub::DOUBLE / n) END AS lat,
    CASE WHEN sub = 0 THEN lon ELSE lon + (lon2 - lon) * (sub::DOUBLE / n) END AS lon
  FROM (SELECT *, unnest(range(n)) AS sub FROM (SELECT *, coalesce({steps}, 1)::BIGINT AS n FROM {name}_next)))"""


DENSE_TILES = d_dense("fx_dense", "fx_points", "CASE WHEN d > 100 AND d <= 2000 THEN ceil(d / 100e0) END")
DENSE_HISTORY = d_dense("fx_walk", "fx_points", "CASE WHEN d > 100 THEN ceil(d / 100e0) END")
DENSE_COVER = d_dense("fx_cover", "fx_points", "CASE WHEN d > 20 AND d <= 5000 THEN ceil(d / 20e0) END")
DENSE_MATCH = d_dense("fx_match", "fx_points", "greatest(1, floor(d / 20e0))")

ACTIVITY_TILES_SQL = DENSE_TILES + f""",
fx_activity_tiles AS (
  SELECT DISTINCT athlete_id, activity_id, {d_tile_key('lat', 'lon')} AS tile_key FROM fx_dense)"""


def oracle(body: str, *ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" + body if ctes else body
