"""The year in review: one row per athlete with the year's numbers and what was new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.functions import geo
from wayfold.operators import badges, stats, tiles
from wayfold.session import cut

CUT = ["athlete_id", "after"]


def years(activities: DataFrame, tz: str = "UTC") -> DataFrame:
    """Years with activities per athlete."""
    return activities.filter("start_ts is not null").select("athlete_id", F.year(fa.local_time("start_ts", tz)).alias("year")).distinct()


def _cuts(df: DataFrame, year: int, tz: str, ts: str = "start_ts") -> DataFrame:
    """Rows once per cut-off they precede: ``after`` false before the year, true up to its end."""
    y = F.coalesce(F.year(fa.local_time(ts, tz)), F.lit(-1))
    return df.withColumn("after", F.explode(F.when(y < year, F.array(F.lit(False), F.lit(True))).when(y == year, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))))


def _new_ids(facts: DataFrame, activities: DataFrame, column: str, year: int, tz: str, name: str) -> DataFrame:
    """Distinct ids whose first activity lies in the year; an id stands for ``copies``, where facts say so."""
    copies = F.col("copies") if "copies" in facts.columns else F.lit(1)
    y = F.coalesce(F.year(fa.local_time("start_ts", tz)), F.lit(-1))
    firsts = facts.join(activities.select("athlete_id", "activity_id", "start_ts"), ["athlete_id", "activity_id"]).groupBy("athlete_id", column).agg(F.min(y).alias("y"), F.max(copies).alias("_copies"))
    return firsts.filter(F.col("y") == year).groupBy("athlete_id").agg(F.sum("_copies").alias(name))


def year_in_review(activities: DataFrame, activity_tiles: DataFrame, year: int, activity_areas: DataFrame | None = None, activity_countries: DataFrame | None = None,
                   activity_climbs: DataFrame | None = None, challenge_hits: DataFrame | None = None, checkpoint_hits: DataFrame | None = None,
                   checkpoint_counts: DataFrame | None = None, coverage: float = 0.9, tz: str = "UTC") -> DataFrame:
    """Numbers of ``year`` per athlete; undated activities count as before.

    Both cut-offs run through each operator together as a second grouping key."""
    activities = cut(activities)
    during = activities.filter(F.year(fa.local_time("start_ts", tz)) == year)
    out = during.groupBy("athlete_id").agg(
        F.count(F.lit(1)).alias("activities"), (F.sum("distance_m") / 1000).alias("km"), (F.sum(F.coalesce("moving_s", "elapsed_s", F.lit(0.0))) / 3600).alias("hours"),
        F.sum(F.coalesce("ascent_m", F.lit(0.0))).alias("ascent"))

    seen = activity_tiles.join(activities.select("athlete_id", "activity_id", "start_ts"), ["athlete_id", "activity_id"])
    at_cut = cut(_cuts(seen, year, tz).select(*CUT, geo.key_x("tile_key").alias("x"), geo.key_y("tile_key").alias("y")).distinct())
    split = {False: "before", True: "after"}
    numbers = (at_cut.groupBy(*CUT).agg(F.count(F.lit(1)).alias("tiles")).join(tiles.max_square(at_cut, CUT).select(*CUT, F.col("side").alias("square")), CUT, "left")
               .join(tiles.max_cluster(at_cut, CUT).select(*CUT, "cluster"), CUT, "left")
               .join(stats.eddington(_cuts(activities, year, tz), fa.CYCLING_SPORTS, tz, CUT).select(*CUT, F.col("number").alias("eddington")), CUT, "full"))
    wide = numbers.groupBy("athlete_id").agg(*[F.coalesce(F.max(F.when(F.col("after") == side, F.col(c))), F.lit(0)).alias(f"{c}_{label}")
                                               for c in ("tiles", "square", "cluster", "eddington") for side, label in split.items()])
    out = out.join(wide, "athlete_id", "left").withColumn("new_tiles", F.col("tiles_after") - F.col("tiles_before"))

    counts = badges.all_badges(_cuts(activities, year, tz), None if activity_countries is None else
                               _cuts(activity_countries.join(activities.select("athlete_id", "activity_id", "start_ts"), ["athlete_id", "activity_id"]), year, tz), tz, CUT)
    risen = (counts.groupBy("athlete_id", "badge").agg(F.sum(F.when(F.col("after"), F.col("n")).otherwise(-F.col("n"))).alias("rise")).filter("rise > 0")
             .groupBy("athlete_id").agg(F.array_join(F.array_sort(F.collect_set("badge")), ",").alias("badges")))  # at most 18 badges
    out = out.join(risen, "athlete_id", "left")
    for facts, column, name in ((activity_areas, "code", "new_areas"), (activity_countries, "country", "new_countries"), (activity_climbs, "climb_id", "new_climbs"), (challenge_hits, "item_id", "new_items")):
        if facts is not None:
            out = out.join(_new_ids(facts, activities, column, year, tz, name), "athlete_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    if checkpoint_hits is not None and checkpoint_counts is not None:
        # ``copies``: how many routes have these checkpoints, where only one of them was matched.
        copies = F.col("copies") if "copies" in checkpoint_counts.columns else F.lit(1).cast("bigint")
        dated = _cuts(checkpoint_hits.join(activities.select("athlete_id", "activity_id", "start_ts"), ["athlete_id", "activity_id"]), year, tz)
        passed = dated.groupBy(*CUT, "route_id").agg(F.count_distinct("idx").alias("n")).join(checkpoint_counts.withColumn("_copies", copies), "route_id").filter(F.col("n") >= coverage * F.col("total"))
        done = passed.groupBy("athlete_id", "route_id", "_copies").agg(F.bool_or(~F.col("after")).alias("earlier")).filter("not earlier").groupBy("athlete_id").agg(F.sum("_copies").alias("new_routes"))
        out = out.join(done, "athlete_id", "left").withColumn("new_routes", F.coalesce("new_routes", F.lit(0)))
    return out
