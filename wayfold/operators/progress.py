"""Challenge results: what is pending, stored results, visits and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.operators import nearby, ordered
from wayfold.session import cut


def pending(activities: DataFrame, challenges: DataFrame, results: DataFrame) -> DataFrame:
    """(athlete_id, activity_id, challenge_id, key) still to check on ``activities``; where these say so
    (is_virtual, n_points), only those on the map are.

    The live challenges (a user's files) travel as one array per row instead of a cross join."""
    if {"is_virtual", "n_points"} <= set(activities.columns):
        activities = activities.filter(fa.is_on_map("is_virtual", "n_points"))
    live = challenges.agg(F.collect_list(F.struct("challenge_id", "key"))).scalar()
    wanted = activities.select("athlete_id", "activity_id", F.explode(live).alias("c")).select("athlete_id", "activity_id", "c.challenge_id", "c.key")
    keys = [*(["athlete_id"] if "athlete_id" in results.columns else []), "activity_id", "challenge_id", "key"]
    return wanted.join(results.select(*keys), keys, "left_anti")


def upsert(results: DataFrame, new: DataFrame, live: DataFrame) -> DataFrame:
    """Stored results with ``new`` ones in place of older keys; dropped challenges leave."""
    pair = [*(["athlete_id"] if "athlete_id" in results.columns else []), "activity_id", "challenge_id"]
    kept = results.join(new.select(*pair).distinct(), pair, "left_anti")
    return kept.unionByName(new).join(live.select("challenge_id"), "challenge_id", "left_semi")


def visit_dates(hits: DataFrame, challenges: DataFrame, activities: DataFrame, same: DataFrame | None = None) -> DataFrame:
    """Visits of each item, newest first: (athlete_id, challenge_id, item_id, ord, visit_ts).

    Only results with the challenge's current key count. Rows instead of arrays keep a place that
    everybody visits spread over tasks. With ``same`` (challenge_id, item_id, same) the hits name the
    first of the items that lie together; the others are added by a last join."""
    current = hits.join(challenges.select("challenge_id", "key"), ["challenge_id", "key"])
    dated = current.join(activities.select("athlete_id", "activity_id", "start_ts"), ["athlete_id", "activity_id"])
    keys = ["athlete_id", "challenge_id", "item_id"]
    rows = dated.select(*keys, "activity_id", F.col("start_ts").alias("visit_ts"))
    out = ordered.ordinals(rows, keys, [F.desc_nulls_last("visit_ts"), "activity_id"], F.coalesce(F.unix_date(F.to_date("visit_ts")), F.lit(-(10 ** 6))), "ord", descending=True)
    if same is None:
        return out
    first = cut(out.withColumn("same", F.col("item_id").cast("string")).drop("item_id"))
    return first.join(same, ["challenge_id", "same"]).select(*out.columns)


def route_coverage(hits: DataFrame, counts: DataFrame) -> DataFrame:
    """Share of each route's checkpoints passed by any activity; unknown routes are dropped."""
    passed = hits.groupBy("athlete_id", "route_id").agg(F.count_distinct("idx").alias("passed"))
    known = counts.filter("total > 0")
    return passed.join(known, "route_id").select("athlete_id", "route_id", F.least(F.lit(1.0), F.col("passed") / F.col("total")).alias("share"))


def tracks_coverage(points: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """``route_coverage`` of tracks; routes with the same checkpoints (route_id, idx, lat, lon) are matched once."""
    twins = cut(nearby.same_checkpoints(checkpoints))
    shares = first_coverage(points, checkpoints, twins)
    return shares.withColumnRenamed("route_id", "same").join(twins, "same").select("athlete_id", "route_id", "share")


def first_coverage(points: DataFrame, checkpoints: DataFrame, twins: DataFrame) -> DataFrame:
    """``tracks_coverage`` of the first of the routes with equal checkpoints; ``twins`` (route_id, same) tell the others."""
    once = checkpoints.join(twins.filter("route_id = same").select("route_id"), "route_id", "left_semi")
    return route_coverage(nearby.checkpoint_hits(points, once), once.groupBy("route_id").agg(F.count(F.lit(1)).alias("total")))


def challenge_done(shares: DataFrame, items: DataFrame, visits: DataFrame, challenges: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Items done and items in all per athlete and challenge.

    ``shares`` (athlete_id, challenge_id, route_id, share) decide cover challenges; any visit
    decides the others. ``items`` are rows (challenge_id, item_id) or totals (challenge_id, total). With
    ``copies`` (challenge_id, item_id, copies) an item stands for that many."""
    covered = (shares.join(challenges.filter("is_cover").select("challenge_id", "coverage"), "challenge_id").filter("share >= coverage")
               .select("athlete_id", "challenge_id", F.col("route_id").alias("item_id")))
    seen = visits.join(challenges.filter("not is_cover").select("challenge_id"), "challenge_id").select("athlete_id", "challenge_id", "item_id")
    done = covered.unionByName(seen).distinct()
    weight = F.lit(1)
    if copies is not None:
        done, weight = done.join(copies, ["challenge_id", "item_id"], "left"), F.coalesce("copies", F.lit(1))
    done = done.groupBy("athlete_id", "challenge_id").agg(F.sum(weight).alias("done"))
    totals = items if "total" in items.columns else items.groupBy("challenge_id").agg(F.count_distinct("item_id").alias("total"))
    return done.join(totals, "challenge_id").select("athlete_id", "challenge_id", "done", "total")
