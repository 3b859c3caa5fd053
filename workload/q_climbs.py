"""Road profiles and climbs over lines derived from ``part`` and a generated elevation raster."""

from pyspark.sql import functions as F

from wayfold.operators import climbs, polyline, profiles
from wayfold.session import cut
from workload import fixtures as fx
from workload.registry import query

# Raster posts per degree.
RASTER = 1200


def road_points(spark, sf):
    """Three-kilometre roads of 13 points; some points lie on bridges."""
    p = F.col("p_partkey")
    base = fx.table(spark, sf, "part").select(p.alias("line_id"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("seq"))
    k, s = F.col("line_id"), F.col("seq")
    return base.select("line_id", "seq", (F.lit(52.10013) + (k % 60) / 100 + s * 0.0021).alias("lat"),
                       (F.lit(5.10017) + F.floor(k / 60) / 100 + s * F.when(k % 3 == 0, 0.0007).otherwise(0.0013)).alias("lon"),
                       ((k + s) % 9 == 4).alias("flat"), F.when((k + F.floor(s / 5)) % 4 != 0, F.concat(F.lit("Road "), ((k + F.floor(s / 5)) % 7).cast("string"))).alias("name"))


ROADS_SQL = """roads AS (SELECT p_partkey AS line_id, s.seq, 52.10013e0 + (p_partkey % 60) / 100e0 + s.seq * 0.0021e0 AS lat,
  5.10017e0 + (p_partkey // 60) / 100e0 + s.seq * CASE WHEN p_partkey % 3 = 0 THEN 0.0007e0 ELSE 0.0013e0 END AS lon, (p_partkey + s.seq) % 9 = 4 AS flat,
  CASE WHEN (p_partkey + s.seq // 5) % 4 <> 0 THEN 'Road ' || ((p_partkey + s.seq // 5) % 7) END AS name FROM part, (SELECT unnest(range(13)) AS seq) s)"""
SAMPLES_SQL = """road_segs AS (SELECT *, sum(m) OVER (PARTITION BY line_id ORDER BY seq) - m AS walked, sum(m) OVER (PARTITION BY line_id) AS total FROM (
  SELECT r.*, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(flat) OVER w AS flat2,
    sqrt(pow((lead(lon) OVER w - lon) * cos(radians(avg(lat) OVER (PARTITION BY line_id))), 2) + pow(lead(lat) OVER w - lat, 2)) * 111320e0 AS m
  FROM roads r WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE lat2 IS NOT NULL),
samples AS (SELECT line_id, i, lat + (lat2 - lat) * t AS lat, lon + (lon2 - lon) * t AS lon, flat::INTEGER + (flat2::INTEGER - flat::INTEGER) * t > 0.5 AS flat, name FROM (
  SELECT *, (i * 20e0 - walked) / m AS t FROM (SELECT *, unnest(range(ceil(walked / 20e0)::BIGINT, ceil(least(walked + m, total) / 20e0)::BIGINT)) AS i FROM road_segs WHERE total >= 300)))"""


def elevation(spark, sf, samples):
    """Raster posts of the tables' footprint: the posts around the given samples."""
    posts = (samples.select(F.floor("lat").alias("cell_lat"), F.floor("lon").alias("cell_lon"),
                            F.floor((F.floor("lat") + 1 - F.col("lat")) * RASTER).alias("r"), F.floor((F.col("lon") - F.floor("lon")) * RASTER).alias("c"))
             .withColumn("row", F.explode(F.sequence(F.col("r"), F.col("r") + 1))).withColumn("col", F.explode(F.sequence(F.col("c"), F.col("c") + 1)))
             .select("cell_lat", "cell_lon", "row", "col").distinct())
    return with_heights(posts)


def with_heights(posts):
    return posts.withColumn("elev", F.when((F.col("row") * 37 + F.col("col")) % 4001 == 0, F.lit(climbs.VOID)).otherwise(
        F.expr("cast(floor(row / 10) * floor(row / 10) * 7 % 300 + col % 13 as int)")))


ELEV_SQL = """CASE WHEN ({r} * 37 + {c}) % 4001 = 0 THEN NULL ELSE ({r} // 10) * ({r} // 10) * 7 % 300 + {c} % 13 END"""


def _corner(dy, dx):
    wy, wx = ("fy" if dy else "(1 - fy)"), ("fx" if dx else "(1 - fx)")
    return f"({ELEV_SQL.format(r=f'(r + {dy})', c=f'(c + {dx})')}) * {wy} * {wx}"


HEIGHTS_SQL = f"""heights AS (SELECT line_id, i, lat, lon, flat, name, {' + '.join(_corner(dy, dx) for dy in (0, 1) for dx in (0, 1))} AS elev FROM (
  SELECT *, floor(y)::BIGINT AS r, floor(x)::BIGINT AS c, y - floor(y) AS fy, x - floor(x) AS fx FROM (
    SELECT *, (floor(lat) + 1 - lat) * {RASTER} AS y, (lon - floor(lon)) * {RASTER} AS x FROM samples))),
profiles AS (SELECT * FROM heights h WHERE line_id NOT IN (SELECT line_id FROM heights WHERE elev IS NULL))"""
FILLED_SQL = """filled AS (SELECT line_id, i, lat, lon, flat, name, CASE WHEN NOT flat THEN elev WHEN b IS NULL THEN a.e WHEN a IS NULL THEN b.e ELSE b.e + (a.e - b.e) * ((i - b.at)::DOUBLE / (a.at - b.at)) END AS elev FROM (
  SELECT *, max(CASE WHEN NOT flat THEN {'at': i, 'e': elev} END) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
    min(CASE WHEN NOT flat THEN {'at': i, 'e': elev} END) OVER (PARTITION BY line_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM profiles))"""
SMOOTH_SQL = """smoothed AS (SELECT line_id, i, lat, lon, name, (coalesce(lag(elev) OVER w, elev) + elev + coalesce(lead(elev) OVER w, elev)) / 3 AS elev
  FROM filled WHERE elev IS NOT NULL WINDOW w AS (PARTITION BY line_id ORDER BY i))"""


def raster(lines):
    """Raster posts of the lines' footprint: all posts of the blocks their samples lie in."""
    touched = profiles.raster_posts(lines, RASTER).select(*profiles.CELL).distinct()
    own = touched.withColumn("brow", F.explode(F.array("brow", F.col("brow") + 1))).withColumn("bcol", F.explode(F.array("bcol", F.col("bcol") + 1))).distinct()

    def places(c):
        return F.explode(F.sequence(F.col(c) * climbs.BLOCK, F.least(F.col(c) * climbs.BLOCK + climbs.BLOCK - 1, F.lit(RASTER))))

    return with_heights(own.withColumn("row", places("brow")).withColumn("col", places("bcol")).select("cell_lat", "cell_lon", "row", "col"))


def profile(spark, sf, upto="smooth", *columns):
    lines = cut(profiles.gather(road_points(spark, sf), "flat", *columns))
    return profiles.profile(lines, raster(lines), RASTER, upto)


@query("trk_resample", fx.oracle("SELECT line_id, i, round(lat, 6) AS lat, round(lon, 6) AS lon, flat, name FROM samples", ROADS_SQL, SAMPLES_SQL))
def trk_resample(spark, sf):
    out = climbs.resample(road_points(spark, sf))
    return out.select("line_id", F.col("i").cast("bigint").alias("i"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "flat", "name")


@query("jn_elevation", fx.oracle("SELECT line_id, i, round(elev, 4) AS elev FROM profiles", ROADS_SQL, SAMPLES_SQL, HEIGHTS_SQL))
def jn_elevation(spark, sf):
    out = profiles.samples(profile(spark, sf, "whole"))
    return out.select("line_id", F.col("i").cast("bigint").alias("i"), F.round("elev", 4).alias("elev"))


@query("trk_fill_flat", fx.oracle("SELECT line_id, i, round(elev, 4) AS elev FROM filled WHERE elev IS NOT NULL", ROADS_SQL, SAMPLES_SQL, HEIGHTS_SQL, FILLED_SQL))
def trk_fill_flat(spark, sf):
    out = profiles.samples(profile(spark, sf, "filled"))
    return out.select("line_id", F.col("i").cast("bigint").alias("i"), F.round("elev", 4).alias("elev"))


PROFILE_CTES = (ROADS_SQL, SAMPLES_SQL, HEIGHTS_SQL, FILLED_SQL, SMOOTH_SQL)


@query("trk_smooth", fx.oracle("SELECT line_id, i, round(elev, 4) AS elev FROM smoothed", *PROFILE_CTES))
def trk_smooth(spark, sf):
    return profiles.samples(profile(spark, sf)).select("line_id", F.col("i").cast("bigint").alias("i"), F.round("elev", 4).alias("elev"))


# The climb rule as a row-by-row recursion over one profile and direction: state is
# (foot, top, high); a step that ends a climb restarts at its top.
CLIMBS_SQL = """both_ways AS (SELECT line_id, false AS reverse, i AS j, elev, max(i) OVER (PARTITION BY line_id) AS last FROM smoothed
  UNION ALL SELECT line_id, true, max(i) OVER (PARTITION BY line_id) - i, elev, max(i) OVER (PARTITION BY line_id) FROM smoothed),
packed AS (SELECT line_id, reverse, any_value(last) AS last, list(elev ORDER BY j) AS e FROM both_ways GROUP BY 1, 2),
walk(line_id, reverse, last, e, k, foot, top, done_foot, done_top) AS (
  SELECT line_id, reverse, last, e, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM packed
  UNION ALL
  SELECT line_id, reverse, last, e, CASE WHEN over THEN top ELSE k + 1 END,
    CASE WHEN over THEN NULL WHEN foot IS NULL AND k < last AND e[k + 2] > e[k + 1] THEN k ELSE foot END,
    CASE WHEN over THEN NULL WHEN foot IS NULL AND k < last AND e[k + 2] > e[k + 1] THEN k WHEN foot IS NOT NULL AND e[k + 1] > e[top + 1] THEN k ELSE top END,
    CASE WHEN over THEN foot END, CASE WHEN over THEN top END
  FROM (SELECT *, foot IS NOT NULL AND (k > last OR (e[k + 1] <= e[top + 1] AND e[top + 1] - e[k + 1] > greatest(10, least(50, 0.05e0 * (e[top + 1] - e[foot + 1]))))) AS over FROM walk
    WHERE k <= last OR foot IS NOT NULL)),
raw AS (SELECT line_id, reverse, last, e, done_foot AS foot, done_top AS top FROM walk WHERE done_top > done_foot),
found AS (SELECT line_id, reverse, last, e, top, coalesce((SELECT min(s) FROM range(foot, top - 5) r(s) WHERE e[s + 6] - e[s + 1] >= 2), greatest(foot, top - 5)) AS start FROM raw)"""


@query("win_find_climbs", fx.oracle("SELECT line_id, reverse, start, top FROM found", *PROFILE_CTES, CLIMBS_SQL, recursive=True))
def win_find_climbs(spark, sf):
    out = profiles.find(profile(spark, sf))
    return out.select("line_id", "reverse", F.col("start").cast("bigint").alias("start"), F.col("top").cast("bigint").alias("top"))


RATED_SQL = """rated AS (SELECT *, CASE WHEN avg < 3 THEN NULL WHEN length * avg >= 80000 THEN 'HC' WHEN length * avg >= 64000 THEN '1' WHEN length * avg >= 32000 THEN '2'
  WHEN length * avg >= 16000 THEN '3' WHEN length * avg >= 8000 THEN '4' WHEN length >= 300 AND avg >= 5 THEN 'hill' END AS cat,
  coalesce((SELECT max((e[s + 11] - e[s + 1]) / 200e0 * 100) FROM range(start, top - 9) r(s)), avg) AS steep FROM (
    SELECT line_id, reverse, last, e, start, top, (top - start) * 20e0 AS length, e[top + 1] - e[start + 1] AS gain, (e[top + 1] - e[start + 1]) / ((top - start) * 20e0) * 100 AS avg FROM found))"""
RATED_CTES = (*PROFILE_CTES, CLIMBS_SQL, RATED_SQL)


def rated(spark, sf, *columns):
    return climbs.metrics(profiles.find(profile(spark, sf, "smooth", *columns)))


@query("win_steepest_200m", fx.oracle("SELECT line_id, reverse, start, round(gain, 3) AS gain, round(avg, 3) AS avg, round(steep, 3) AS max, cat FROM rated WHERE cat IS NOT NULL", *RATED_CTES, recursive=True))
def win_steepest_200m(spark, sf):
    out = rated(spark, sf)
    return out.select("line_id", "reverse", F.col("start").cast("bigint").alias("start"), *[F.round(c, 3).alias(c) for c in ("gain", "avg", "max")], "cat")


@query("agg_dominant_name", fx.oracle("""
SELECT line_id, reverse, start, name FROM (SELECT line_id, reverse, start FROM rated WHERE cat IS NOT NULL) LEFT JOIN (
  SELECT line_id, reverse, start, CASE WHEN max(upper) > 0 THEN min_by(name, (-upper, name)) ELSE min_by(name, (-everywhere, name)) END AS name FROM used GROUP BY 1, 2, 3) USING (line_id, reverse, start)""",
*RATED_CTES, """used AS (SELECT r.line_id, r.reverse, r.start, s.name, count(*) AS everywhere,
  count(*) FILTER (CASE WHEN reverse THEN last - s.i ELSE s.i END - start >= (top - start + 1) // 2) AS upper
  FROM rated r JOIN smoothed s ON s.line_id = r.line_id AND CASE WHEN reverse THEN last - s.i ELSE s.i END BETWEEN start AND top WHERE cat IS NOT NULL AND s.name IS NOT NULL GROUP BY 1, 2, 3, 4)""", recursive=True))
def agg_dominant_name(spark, sf):
    return rated(spark, sf, "name").select("line_id", "reverse", F.col("start").cast("bigint").alias("start"), "name")


@query("win_nms_climbs")
def win_nms_climbs(spark, sf):
    """The greedy choice is compared with brute force in the tests."""
    out = cut(rated(spark, sf))
    kept = climbs.distinct_climbs(out, ["line_id", "reverse", "start"])
    return kept.select("line_id", "reverse", "start", F.round("gain", 3).alias("gain"))


@query("top_climbs", fx.oracle("""
SELECT line_id, reverse, start, cat, rank FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY round(gain, 6) DESC, line_id, reverse, start) AS rank FROM rated WHERE cat IS NOT NULL)""", *RATED_CTES, recursive=True))
def top_climbs(spark, sf):
    out = cut(rated(spark, sf))
    keyed = out.withColumn("climb_id", F.struct("line_id", "reverse", "start")).withColumn("gain", F.round("gain", 6))
    return climbs.ranked(keyed).select("line_id", "reverse", F.col("start").cast("bigint").alias("start"), "cat", "rank")


ASCENT_SQL = """meaned AS (SELECT line_id, list(v ORDER BY i) AS m, count(*) AS n FROM (SELECT line_id, i, avg(elev) OVER w AS v, count(*) OVER w AS c, count(*) OVER (PARTITION BY line_id) AS size
  FROM heights WHERE elev IS NOT NULL WINDOW w AS (PARTITION BY line_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE c = 3 AND size >= 4 GROUP BY 1),
fold(line_id, m, n, k, total, low) AS (SELECT line_id, m, n, 1::BIGINT, 0e0, m[1] FROM meaned
  UNION ALL SELECT line_id, m, n, k + 1, CASE WHEN m[k + 1] - low > 3 THEN total + m[k + 1] - low ELSE total END, CASE WHEN m[k + 1] - low > 3 OR m[k + 1] < low THEN m[k + 1] ELSE low END FROM fold WHERE k < n)"""
ASCENT = "SELECT line_id, round(coalesce(max(total) FILTER (k = n), 0), 4) AS ascent FROM fold RIGHT JOIN (SELECT DISTINCT line_id FROM heights) USING (line_id) GROUP BY 1"


@query("trk_ascent", fx.oracle(ASCENT, ROADS_SQL, SAMPLES_SQL, HEIGHTS_SQL, ASCENT_SQL, recursive=True))
def trk_ascent(spark, sf):
    return climbs.profile_ascent(profile(spark, sf, "bilinear")).withColumn("ascent", F.round("ascent", 4))


ROUTE_SAMPLES_SQL = """samples AS (SELECT line_id, seq * 1000 + k AS i, CASE WHEN lat2 IS NULL THEN lat ELSE lat + (lat2 - lat) * k / n END AS lat, CASE WHEN lon2 IS NULL THEN lon ELSE lon + (lon2 - lon) * k / n END AS lon, flat, name FROM (
  SELECT *, unnest(range(n)) AS k FROM (SELECT *, coalesce(greatest(1, floor(sqrt(pow((lat2 - lat) * 110574e0, 2) + pow((lon2 - lon) * 111320e0 * cos(radians(lat)), 2)) / 30)), 1)::BIGINT AS n FROM (
    SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM roads WINDOW w AS (PARTITION BY line_id ORDER BY seq)))))"""


@query("trk_ascent_route", fx.oracle(ASCENT, ROADS_SQL, ROUTE_SAMPLES_SQL, HEIGHTS_SQL, ASCENT_SQL, recursive=True))
def trk_ascent_route(spark, sf):
    """Ascent of whole routes, sampled every 30 m as a route catalogue does."""
    samples = cut(climbs.route_samples(road_points(spark, sf)))
    heights = climbs.with_elevation(samples, elevation(spark, sf, samples), RASTER, drop_lines=False)
    return climbs.ascent(heights).withColumn("ascent", F.round("ascent", 4))


@query("trk_checkpoints_climb", fx.oracle("""
SELECT climb_id, (row_number() OVER (PARTITION BY climb_id ORDER BY seq) - 1)::INTEGER AS idx, round(lat, 6) AS lat, round(lon, 6) AS lon FROM (
  SELECT climb_id, seq, lat, lon FROM acc WHERE hit OR seq = 0 OR seq = n - 1)""", """
climb_points AS (SELECT p_partkey AS climb_id, s.seq, 52e0 + s.seq * 0.00017e0 * (1 + p_partkey % 3) AS lat, 5e0 + s.seq * 0.0001e0 AS lon, 20 + p_partkey % 30 AS n
  FROM part, (SELECT unnest(range(50)) AS seq) s WHERE s.seq < 20 + p_partkey % 30)""", f"""
climb_next AS (SELECT a.*, {fx.d_distance('b.lat', 'b.lon', 'a.lat', 'a.lon')} AS d FROM climb_points a LEFT JOIN climb_points b ON b.climb_id = a.climb_id AND b.seq = a.seq - 1),
acc(climb_id, seq, lat, lon, n, since, hit) AS (SELECT climb_id, seq, lat, lon, n, 0e0, false FROM climb_next WHERE seq = 0
  UNION ALL SELECT c.climb_id, c.seq, c.lat, c.lon, c.n, CASE WHEN a.since + c.d >= 50 THEN 0e0 ELSE a.since + c.d END, a.since + c.d >= 50 FROM acc a JOIN climb_next c ON c.climb_id = a.climb_id AND c.seq = a.seq + 1)""", recursive=True))
def trk_checkpoints_climb(spark, sf):
    k = F.col("p_partkey")
    base = fx.table(spark, sf, "part").select(k.alias("climb_id"), F.explode(F.sequence(F.lit(0), (19 + k % 30).cast("int"))).alias("seq"))
    lines = base.select("climb_id", "seq", (F.lit(52.0) + F.col("seq") * F.lit(0.00017) * (1 + F.col("climb_id") % 3)).alias("lat"), (F.lit(5.0) + F.col("seq") * F.lit(0.0001)).alias("lon"))
    out = climbs.climb_checkpoints(lines)
    return out.select("climb_id", "idx", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("agg_climbs_ridden", fx.oracle("""
SELECT athlete_id, climb_id, count(*) AS times, epoch_us(max(start_ts)) AS latest_us FROM matches JOIN fx_point_activities USING (athlete_id, activity_id) GROUP BY 1, 2""", fx.POINTS_SQL,
"matches AS (SELECT athlete_id, activity_id, c.k AS climb_id FROM fx_point_activities a JOIN (SELECT unnest(range(40)) AS k) c ON (a.activity_id + c.k) % 7 = 0)"))
def agg_climbs_ridden(spark, sf):
    acts = fx.point_activities(spark, sf)
    matches = acts.withColumn("climb_id", F.explode(F.sequence(F.lit(0), F.lit(39)))).filter((F.col("activity_id") + F.col("climb_id")) % 7 == 0).select("athlete_id", "activity_id", F.col("climb_id").cast("bigint").alias("climb_id"))
    return climbs.ridden(matches, acts).select("athlete_id", "climb_id", "times", F.unix_micros("latest").alias("latest_us"))


@query("trk_polyline_roundtrip", fx.oracle("""
SELECT athlete_id, activity_id, seq - 1 AS seq, round(round_even(lat * 1e5, 0) / 1e5, 6) AS lat, round(round_even(lon * 1e5, 0) / 1e5, 6) AS lon FROM fx_points""", fx.POINTS_SQL))
def trk_polyline_roundtrip(spark, sf):
    """Encodes every track and decodes it again: the input rounded to five decimals."""
    back = polyline.decode(polyline.encode(fx.points(spark, sf)))
    return back.select("athlete_id", "activity_id", F.col("seq").cast("bigint").alias("seq"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
