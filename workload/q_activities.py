"""Merging, totals, Eddington numbers and badges over ``activities``."""

from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.operators import badges, merge, stats
from workload import fixtures as fx
from workload.registry import query

A = fx.ACTIVITIES_SQL
KIND = "CASE WHEN {0}.sport IN ('Cycling','E-biking') THEN 'bike' WHEN {0}.sport = 'Running' THEN 'run' WHEN {0}.sport IN ('Walking','Hiking') THEN 'foot' ELSE 'other' END"
TIMED_SQL = f"""timed AS (
  SELECT athlete_id, activity_id, epoch_us(start_ts) AS s, coalesce(elapsed_s, 0) AS d, {KIND.format('a')} AS kind, sport FROM fx_activities a)"""
RATIO = "((least(a.s + a.d * 1e6, b.s + b.d * 1e6) - greatest(a.s, b.s)) / (1e6 * least(a.d, b.d)))"
SAME = f"""(abs(a.s - b.s) <= 120000000 OR (a.d > 0 AND b.d > 0 AND {RATIO} > 0 AND ({RATIO} >= 0.8 OR ({RATIO} >= 0.5
  AND (a.kind = b.kind OR a.kind = 'other' OR b.kind = 'other')))))"""
GROUPS_SQL = f"""links AS (
  SELECT a.athlete_id, a.s AS src_s, a.activity_id AS src, b.s AS dst_s, b.activity_id AS dst FROM timed a JOIN timed b
    ON a.athlete_id = b.athlete_id AND (a.s, a.activity_id) < (b.s, b.activity_id) AND b.s - a.s < 86400000000 AND {SAME}),
reach AS (
  SELECT athlete_id, dst, src, src_s FROM links
  UNION SELECT r.athlete_id, r.dst, l.src, l.src_s FROM reach r JOIN links l ON l.athlete_id = r.athlete_id AND l.dst = r.src),
fx_groups AS (
  SELECT t.athlete_id, t.activity_id, coalesce(min_by(r.src, (r.src_s, r.src)), t.activity_id) AS group_id
  FROM timed t LEFT JOIN reach r ON r.athlete_id = t.athlete_id AND r.dst = t.activity_id GROUP BY t.athlete_id, t.activity_id)"""


def members(spark, sf):
    acts = fx.activities(spark, sf)
    return acts.join(merge.duplicate_groups(acts), ["athlete_id", "activity_id"])


@query("win_duplicate_groups", fx.oracle("SELECT athlete_id, activity_id, group_id FROM fx_groups", A, TIMED_SQL, GROUPS_SQL, recursive=True))
def win_duplicate_groups(spark, sf):
    return merge.duplicate_groups(fx.activities(spark, sf))


@query("agg_best_copy", fx.oracle("""
SELECT m.athlete_id, m.group_id, m.activity_id, m.sport, round(m.distance_m, 3) AS distance_m,
  CASE WHEN m.source <> 'feed' AND feed_name IS NOT NULL THEN feed_name ELSE m.name END AS name,
  e.is_virtual, e.is_zwift, e.copies, coalesce(m.avg_power_w, e.power) AS avg_power_w, round(coalesce(m.moving_s, e.moving), 3) AS moving_s,
  coalesce(m.ascent_m, e.ascent) AS ascent_m, coalesce(m.descent_m, e.descent) AS descent_m
FROM m JOIN extra e USING (group_id) WHERE rn = 1""", A, TIMED_SQL, GROUPS_SQL, """
m AS (SELECT a.*, g.group_id, row_number() OVER (PARTITION BY g.group_id ORDER BY quality DESC, distance_m DESC, start_ts, activity_id) AS rn
  FROM fx_activities a JOIN fx_groups g USING (athlete_id, activity_id)),
extra AS (SELECT group_id, bool_or(is_virtual) AS is_virtual, bool_or(is_zwift) AS is_zwift, count(*) AS copies,
  min_by(name, (start_ts, activity_id)) FILTER (source = 'feed') AS feed_name,
  min_by(avg_power_w, (start_ts, activity_id)) FILTER (avg_power_w IS NOT NULL) AS power,
  min_by(moving_s, (start_ts, activity_id)) FILTER (moving_s IS NOT NULL) AS moving,
  min_by(ascent_m, (start_ts, activity_id)) FILTER (ascent_m IS NOT NULL) AS ascent,
  min_by(descent_m, (start_ts, activity_id)) FILTER (descent_m IS NOT NULL) AS descent FROM m GROUP BY group_id)""", recursive=True))
def agg_best_copy(spark, sf):
    return (merge.best_copy(members(spark, sf))
            .select("athlete_id", "group_id", "activity_id", "sport", F.round("distance_m", 3).alias("distance_m"), "name", "is_virtual", "is_zwift",
                    "copies", "avg_power_w", F.round("moving_s", 3).alias("moving_s"), "ascent_m", "descent_m"))


@query("agg_preferred_file", fx.oracle("""
SELECT athlete_id, group_id, activity_id, row_number() OVER (PARTITION BY group_id ORDER BY quality DESC,
  CASE WHEN activity_id % 4 = 0 THEN 1 ELSE 0 END, CASE WHEN avg_power_w IS NULL THEN 1 ELSE 0 END, distance_m DESC, start_ts, activity_id) = 1 AS keep
FROM fx_activities JOIN fx_groups USING (athlete_id, activity_id)""", A, TIMED_SQL, GROUPS_SQL, recursive=True))
def agg_preferred_file(spark, sf):
    own = F.when(F.col("activity_id") % 4 == 0, F.format_string("folder|Ride-Strava-%d.fit", "activity_id"))
    return merge.preferred_file(members(spark, sf).withColumn("file_name", F.coalesce(own, F.format_string("folder|Ride-%d.fit", "activity_id"))))


@query("jn_same_workout", fx.oracle(f"""
SELECT a.athlete_id, a.activity_id, b.activity_id AS library_id FROM timed a JOIN timed b ON a.athlete_id = b.athlete_id AND {SAME} WHERE a.activity_id < 1000000000 AND b.activity_id >= 1000000000""", A, TIMED_SQL))
def jn_same_workout(spark, sf):
    acts = fx.activities(spark, sf)
    return merge.same_workout(acts.filter("source = 'feed'"), acts.filter("source = 'file'"))


@query("jn_names_overlay", fx.oracle("""
SELECT a.activity_id, CASE WHEN coalesce(n.new_name, '') <> '' THEN n.new_name ELSE a.name END AS name,
  a.is_virtual OR coalesce(regexp_matches(lower(n.new_name), 'zwift|indoor'), false) AS is_virtual,
  a.is_zwift OR coalesce(starts_with(lower(n.new_name), 'zwift'), false) AS is_zwift
FROM fx_activities a LEFT JOIN names n ON n.file_id = a.activity_id""", A, """
names AS (SELECT c_custkey AS file_id, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Zwift - ' || c_name WHEN 2 THEN 'Indoor ' || c_name ELSE c_name END AS new_name FROM customer)"""))
def jn_names_overlay(spark, sf):
    k = F.col("c_custkey")
    names = fx.table(spark, sf, "customer").select(
        k.cast("string").alias("file_name"),
        F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.lit("Zwift - "), "c_name")).when(k % 4 == 2, F.concat(F.lit("Indoor "), "c_name")).otherwise(F.col("c_name")).alias("new_name"))
    acts = fx.activities(spark, sf).withColumn("file_name", F.col("activity_id").cast("string"))
    return merge.overlay_names(acts, names).select("activity_id", "name", "is_virtual", "is_zwift")


@query("set_union", fx.oracle("SELECT source, count(*) AS n, sum(activity_id)::BIGINT AS ids FROM fx_activities GROUP BY source", A))
def set_union(spark, sf):
    acts = fx.activities(spark, sf)
    both = merge.union_sources(acts.filter("source = 'feed'"), acts.filter("source = 'file'").drop("avg_power_w"))
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("activity_id").alias("ids"))


@query("agg_sport_totals", fx.oracle("""
SELECT athlete_id, sport, count(*) AS activities, round(sum(distance_m), 2) AS metres, round(sum(coalesce(moving_s, elapsed_s, 0)), 2) AS seconds,
  grouping(sport)::INTEGER AS is_total FROM fx_activities GROUP BY GROUPING SETS ((athlete_id, sport), (athlete_id))""", A))
def agg_sport_totals(spark, sf):
    out = stats.sport_totals(fx.activities(spark, sf))
    return out.withColumn("metres", F.round("metres", 2)).withColumn("seconds", F.round("seconds", 2))


@query("top_sports", fx.oracle("""
SELECT athlete_id, sport, round(sum(distance_m), 2) AS metres, row_number() OVER (PARTITION BY athlete_id ORDER BY sum(distance_m) DESC, sport)::INTEGER AS rank
FROM fx_activities WHERE year(start_ts) = 1998 GROUP BY athlete_id, sport""", A))
def top_sports(spark, sf):
    out = stats.top_sports(stats.sport_totals(fx.activities(spark, sf), year=1998))
    return out.select("athlete_id", "sport", F.round("metres", 2).alias("metres"), "rank")


@query("agg_totals", fx.oracle("""
SELECT athlete_id, round(sum(distance_m) / 1000, 6) AS km, count(*) AS activities, count(*) FILTER (quality = 0) AS without_gps FROM fx_activities GROUP BY 1""", A))
def agg_totals(spark, sf):
    return stats.totals(fx.activities(spark, sf)).withColumn("km", F.round("km", 6))


def eddington_sql(sports):
    listed = ", ".join(f"'{s}'" for s in sports)
    return f"""
SELECT athlete_id, e::BIGINT AS number, (SELECT count(*) FROM days d WHERE d.athlete_id = n.athlete_id AND km >= e + 1) AS toward,
  (e + 1 - (SELECT count(*) FROM days d WHERE d.athlete_id = n.athlete_id AND km >= e + 1))::BIGINT AS needed
FROM (SELECT athlete_id, count(*) FILTER (km >= rn) AS e FROM (
  SELECT athlete_id, km, row_number() OVER (PARTITION BY athlete_id ORDER BY km DESC) AS rn FROM days) GROUP BY 1) n""", f"""
days AS (SELECT athlete_id, start_ts::DATE AS day, floor(sum(distance_m / 1000)) AS km FROM fx_activities WHERE sport IN ({listed}) GROUP BY 1, 2)"""


for _name, _sports in {"cycling": fa.CYCLING_SPORTS, "running": fa.RUNNING_SPORTS, "walking": fa.WALKING_SPORTS}.items():
    _body, _cte = eddington_sql(_sports)

    @query(f"agg_eddington_{_name}", fx.oracle(_body, A, _cte))
    def agg_eddington(spark, sf, sports=_sports):
        return stats.eddington(fx.activities(spark, sf), sports)


@query("win_months", fx.oracle("""
SELECT athlete_id, activity_id, strftime(date_trunc('month', start_ts), '%Y-%m') AS month,
  row_number() OVER (PARTITION BY athlete_id ORDER BY start_ts DESC NULLS LAST, activity_id) AS pos
FROM (SELECT athlete_id, activity_id, CASE WHEN activity_id % 50 <> 0 THEN start_ts END AS start_ts FROM fx_activities)""", A))
def win_months(spark, sf):
    acts = fx.activities(spark, sf).withColumn("start_ts", F.when(F.col("activity_id") % 50 != 0, F.col("start_ts")))
    return stats.months(acts).select("athlete_id", "activity_id", F.date_format("month", "yyyy-MM").alias("month"), "pos")


SINGLE_SQL = {
    "100": "count(*) FILTER (sport = 'Cycling' AND distance_m >= 100000)",
    "century": "count(*) FILTER (sport = 'Cycling' AND distance_m >= 160934)",
    "hollander": "count(*) FILTER (sport = 'Cycling' AND distance_m >= 100000 AND ascent_m < 100)",
    "marathon": "count(*) FILTER (sport = 'Running' AND distance_m >= 42195e0 * 0.99e0)",
    "half-marathon": "count(*) FILTER (sport = 'Running' AND distance_m >= 42195e0 / 2 * 0.99e0)",
    "nosleep": "count(*) FILTER (CASE WHEN activity_id % 40 = 0 THEN elapsed_s * 30 ELSE elapsed_s END > 86400)",
    "pretzel": "count(*) FILTER (contains(strip_accents(lower(name)), 'uber pretzel') AND distance_m >= 128000 AND ascent_m >= 2300)",
    "taylor": "count(*) FILTER (is_zwift) // 100",
}
BADGE_SQL = {b: f"SELECT athlete_id, '{b}' AS badge, {e} AS n FROM fx_activities GROUP BY 1" for b, e in SINGLE_SQL.items()}
COUNTRIES_SQL = "fx_countries AS (SELECT athlete_id, activity_id, 'K' || CASE WHEN athlete_id % 3 = 0 OR activity_id % 2 = 0 THEN activity_id * 31 % 60 ELSE 0 END AS country FROM fx_activities)"
BADGE_SQL |= {
    "globetrotter": "SELECT athlete_id, 'globetrotter' AS badge, CASE WHEN count(DISTINCT country) >= 50 THEN 1 ELSE 0 END AS n FROM fx_countries GROUP BY 1",
    "everester": """SELECT c.athlete_id, 'everester' AS badge, sum(picked)::BIGINT AS n FROM everest_walk c GROUP BY 1""",
    "triple-jump": """SELECT athlete_id, 'triple-jump' AS badge, count(*) AS n FROM (
      SELECT athlete_id, lead(day) OVER w - day AS a, lead(day, 2) OVER w - day AS b FROM active_days WINDOW w AS (PARTITION BY athlete_id ORDER BY day))
      WHERE a = 2 AND b = 5 GROUP BY 1""",
    "triathlete": """SELECT athlete_id, 'triathlete' AS badge, count(*) AS n FROM (
      SELECT DISTINCT s.athlete_id, s.start_ts::DATE FROM fx_activities s JOIN fx_activities c ON c.athlete_id = s.athlete_id AND c.start_ts::DATE = s.start_ts::DATE
        AND c.start_ts > s.start_ts JOIN fx_activities r ON r.athlete_id = s.athlete_id AND r.start_ts::DATE = s.start_ts::DATE AND r.start_ts > c.start_ts
      WHERE s.sport = 'Swimming' AND c.sport = 'Cycling' AND r.sport = 'Running') GROUP BY 1""",
    "eddy-the-eagle": """SELECT athlete_id, 'eddy-the-eagle' AS badge, count(*) AS n FROM (SELECT athlete_id, start_ts::DATE FROM fx_activities
      WHERE sport IN ('Skiing', 'Snowboarding') GROUP BY 1, 2 HAVING sum(coalesce(descent_m, 0)) > 1000) GROUP BY 1""",
    "silent-night": "SELECT athlete_id, 'silent-night' AS badge, count(DISTINCT year(day)) AS n FROM active_days WHERE month(day) = 12 AND day(day) = 24 GROUP BY 1",
    "giant-leap": "SELECT athlete_id, 'giant-leap' AS badge, count(DISTINCT year(day)) AS n FROM active_days WHERE month(day) = 2 AND day(day) = 29 GROUP BY 1",
    "festive-500": """SELECT athlete_id, 'festive-500' AS badge, count(*) AS n FROM (SELECT athlete_id, year(start_ts) FROM fx_activities
      WHERE month(start_ts) = 12 AND day(start_ts) >= 24 GROUP BY 1, 2 HAVING sum(distance_m) >= 500000) GROUP BY 1""",
    "every-day-im-hustling": """SELECT athlete_id, 'every-day-im-hustling' AS badge, count(*) AS n FROM (SELECT athlete_id, date_trunc('week', day)
      FROM active_days GROUP BY 1, 2 HAVING count(*) = 7) GROUP BY 1""",
    "working-9-to-5": """SELECT athlete_id, 'working-9-to-5' AS badge, count(*) AS n FROM (SELECT athlete_id, date_trunc('week', day)::DATE AS monday
      FROM active_days GROUP BY 1, 2 HAVING count(*) FILTER (isodow(day) <= 5) = 5 AND count(*) = 5) w
      WHERE NOT EXISTS (SELECT 1 FROM active_days d WHERE d.athlete_id = w.athlete_id AND d.day IN (w.monday - 1, w.monday - 2)) GROUP BY 1""",
}
DAYS_SQL = "active_days AS (SELECT DISTINCT athlete_id, start_ts::DATE AS day FROM fx_activities)"
EVEREST_SQL = """rides AS (SELECT athlete_id, start_ts AS t, sum(coalesce(ascent_m, 0)) AS up FROM fx_activities WHERE sport = 'Cycling' GROUP BY 1, 2),
everest AS (SELECT a.athlete_id, a.t, row_number() OVER (PARTITION BY a.athlete_id ORDER BY a.t) AS i FROM (
  SELECT athlete_id, t, sum(up) OVER (PARTITION BY athlete_id ORDER BY t RANGE BETWEEN CURRENT ROW AND INTERVAL '86399.999999 seconds' FOLLOWING) AS ahead FROM rides) a
  WHERE ahead > 8848),
everest_walk AS (
  SELECT athlete_id, i, t + INTERVAL 1 DAY AS free_at, 1 AS picked FROM everest WHERE i = 1
  UNION ALL
  SELECT e.athlete_id, e.i, CASE WHEN e.t >= w.free_at THEN e.t + INTERVAL 1 DAY ELSE w.free_at END, CASE WHEN e.t >= w.free_at THEN 1 ELSE 0 END
  FROM everest_walk w JOIN everest e ON e.athlete_id = w.athlete_id AND e.i = w.i + 1)"""
BADGE_CTES = (A, COUNTRIES_SQL, DAYS_SQL, EVEREST_SQL)


def countries(spark, sf):
    k = F.col("activity_id")
    far = (F.col("athlete_id") % 3 == 0) | (k % 2 == 0)
    return fx.activities(spark, sf).select("athlete_id", "activity_id", F.concat(F.lit("K"), F.when(far, k * 31 % 60).otherwise(0).cast("string")).alias("country"))


def activities_with_long_days(spark, sf):
    """Some activities last beyond a day."""
    acts = fx.activities(spark, sf)
    return acts.withColumn("elapsed_s", F.when(F.col("activity_id") % 40 == 0, F.col("elapsed_s") * 30).otherwise(F.col("elapsed_s")))


def badge(spark, sf, name):
    acts = activities_with_long_days(spark, sf)
    if name in SINGLE_SQL:
        return badges.single(acts, [name])
    if name == "globetrotter":
        return badges.globetrotter(countries(spark, sf))
    if name == "everester":
        return badges.everester(acts)
    days = badges.day_facts(acts)
    if name == "triathlete":
        return badges.triathlete(days, acts)
    if name in ("silent-night", "giant-leap"):
        return badges.date_years(days, name, *((12, 24) if name == "silent-night" else (2, 29)))
    return {"triple-jump": badges.triple_jump, "eddy-the-eagle": badges.eddy, "festive-500": badges.festive,
            "every-day-im-hustling": badges.hustling, "working-9-to-5": badges.nine_to_five}[name](days)


IDS = {"100": "hundred", "every-day-im-hustling": "hustling", "working-9-to-5": "nine_to_five", "eddy-the-eagle": "eddy", "festive-500": "festive"}
for _badge, _sql in BADGE_SQL.items():
    @query("bdg_" + IDS.get(_badge, _badge).replace("-", "_"), fx.oracle(f"SELECT * FROM ({_sql}) WHERE n > 0", *BADGE_CTES, recursive=True))
    def one_badge(spark, sf, name=_badge):
        return badge(spark, sf, name)


@query("bdg_all", fx.oracle("SELECT * FROM (" + " UNION ALL ".join(BADGE_SQL.values()) + ") WHERE n > 0", *BADGE_CTES, recursive=True))
def bdg_all(spark, sf):
    return badges.all_badges(activities_with_long_days(spark, sf), countries(spark, sf))
