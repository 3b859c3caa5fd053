"""Challenge progress kept up to date: only what is pending is matched, and results are stored."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.operators import nearby, progress, tracks
from wayfold.session import cut


@dataclass
class Results:
    """``checked``: (athlete_id, activity_id, challenge_id, key), what was matched against which state of a
    challenge, hits or none; ``hits``: the same with item_id and, for cover routes, the checkpoint
    idx (-1 for others).

    Items of a challenge that lie on one place or line are met together: ``hits`` name the first of
    them, ``same_items`` tells which share it and ``hits_of_items`` gives a row for each."""

    checked: DataFrame
    hits: DataFrame


CHECKED = "athlete_id BIGINT, activity_id BIGINT, challenge_id STRING, key STRING"


def empty(spark) -> Results:
    return Results(spark.createDataFrame([], CHECKED), spark.createDataFrame([], CHECKED + ", item_id STRING, idx BIGINT"))


def same_items(places: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(challenge_id, item_id, same): for each item the first of its challenge with the same geometry.

    Items are compared by two sums of 64-bit hashes over their rows, so none is gathered in one value."""
    own = ["challenge_id", F.col("item_id").cast("string").alias("item_id")]
    marks = places.select(*own, F.xxhash64("lat", "lon", "radius").alias("a"), F.xxhash64(F.lit("second"), "lat", "lon", "radius").alias("b")).distinct().withColumn("line", F.lit(False))
    if lines is not None:
        marks = marks.unionByName(lines.select(*own, F.xxhash64("piece", "seq", "lat", "lon").alias("a"), F.xxhash64(F.lit("second"), "piece", "seq", "lat", "lon").alias("b")).withColumn("line", F.lit(True)))
    sums = cut(marks.groupBy("challenge_id", "item_id").agg(F.struct(*[F.sum(F.col(c).cast("decimal(20,0)")) for c in ("a", "b")], F.count(F.lit(1)), F.count_if("line")).alias("shape")))
    first = sums.groupBy("challenge_id", "shape").agg(F.min("item_id").alias("same"))
    return sums.join(first, ["challenge_id", "shape"]).select("challenge_id", "item_id", "same")


def hits_of_items(results: Results, same: DataFrame) -> DataFrame:
    """``results.hits`` with a row for every item; its rows aren't exchanged again."""
    hits = results.hits.withColumnRenamed("item_id", "same")
    return hits.join(same, ["challenge_id", "same"]).select(*results.hits.columns)


def first_items(items: DataFrame, same: DataFrame) -> DataFrame:
    """The rows of places or lines of the first items."""
    first = same.filter("item_id = same").select("challenge_id", F.col("same").alias("_item"))
    return items.join(first, (items["challenge_id"] == first["challenge_id"]) & (items["item_id"].cast("string") == first["_item"]), "left_semi")


def update(stored: Results, activities: DataFrame, points: DataFrame, challenges: DataFrame, places: DataFrame, lines: DataFrame) -> Results:
    """``stored`` brought up to ``challenges`` (challenge_id, key, kind, complete, spacing, sports).

    An on-map activity is matched with a challenge if no result with its current key is stored;
    activities of other sports are stored without hits, so they aren't looked at again. Results of
    challenges that are gone leave. ``places`` have (challenge_id, item_id, lat, lon, radius),
    ``lines`` (challenge_id, item_id, piece, seq, lat, lon)."""
    same = cut(same_items(places, lines))
    places, lines = first_items(places, same), first_items(lines, same)
    on_map = activities.filter(fa.is_on_map("is_virtual", "n_points"))
    wanted = cut(progress.pending(on_map, challenges, stored.checked).select("athlete_id", "activity_id", "challenge_id", "key"))
    facts = on_map.select("athlete_id", "activity_id", "sport")
    counting = cut(wanted.join(challenges.drop("key"), "challenge_id").join(facts, ["athlete_id", "activity_id"]).filter(fa.sport_counts("sports", "sport")).select(*wanted.columns, "kind", "complete"))

    def matched(condition, match, items):
        pairs = counting.filter(condition).select(*wanted.columns)
        own = points.join(pairs.select("athlete_id", "activity_id").distinct(), ["athlete_id", "activity_id"], "left_semi")
        return match(own, items).join(pairs, ["athlete_id", "activity_id", "challenge_id"]).select(*wanted.columns, F.col("item_id").cast("string").alias("item_id"), F.col("idx").cast("bigint").alias("idx"))

    def lines_of(complete):
        live = challenges.filter((F.col("kind") == "routes") & (F.col("complete") == complete)).select("challenge_id", "spacing")
        return lines.join(live, "challenge_id").withColumn("route_id", F.struct("challenge_id", F.col("item_id").cast("string").alias("item_id")))

    def visit(own, items):
        return nearby.place_visits(own, items).withColumn("idx", F.lit(-1))

    def cross(own, items):
        return nearby.crossings(own, items.select("route_id", "seq", "lat", "lon")).select(*tracks.TRACK, "route_id.*", F.lit(-1).alias("idx"))

    def cover(own, items):
        marks = None
        for spacing in [r[0] for r in challenges.filter("kind = 'routes' and complete = 'cover'").select("spacing").distinct().collect()]:  # a handful of settings
            part = nearby.route_checkpoints(items.filter(F.col("spacing") == spacing).select("route_id", "piece", "seq", "lat", "lon"), spacing)
            marks = part if marks is None else marks.unionByName(part)
        if marks is None:
            return own.select(*tracks.TRACK, F.lit("").alias("challenge_id"), F.lit("").alias("item_id"), F.lit(-1).alias("idx")).limit(0)
        return nearby.checkpoint_hits(own, marks).select(*tracks.TRACK, "route_id.*", "idx")

    hits = matched("kind = 'locations'", visit, places)
    hits = hits.unionByName(matched("kind = 'routes' and complete = 'cross'", cross, lines_of("cross")))
    hits = hits.unionByName(matched("kind = 'routes' and complete = 'cover'", cover, lines_of("cover")))
    live = challenges.select("challenge_id")
    pair = ["athlete_id", "activity_id", "challenge_id"]
    kept = stored.hits.join(wanted.select(*pair), pair, "left_anti").join(live, "challenge_id", "left_semi")
    return Results(cut(progress.upsert(stored.checked, wanted, live).select(*wanted.columns)), cut(kept.select(*hits.columns).unionByName(hits)))


def standing(results: Results, challenges: DataFrame, places: DataFrame, lines: DataFrame) -> DataFrame:
    """(athlete_id, challenge_id, done, total, checked) over results with the challenges' current keys."""
    same = cut(same_items(places, lines))
    totals = same.groupBy("challenge_id").agg(F.count(F.lit(1)).alias("total"))
    copies = same.groupBy("challenge_id", F.col("same").alias("item_id")).agg(F.count(F.lit(1)).alias("copies"))
    lines = first_items(lines, same)
    now = results.hits.join(challenges.select("challenge_id", "key"), ["challenge_id", "key"], "left_semi")
    cover = challenges.select("challenge_id", ((F.col("kind") == "routes") & (F.col("complete") == "cover")).alias("is_cover"), "coverage", "spacing")
    marks = None
    for spacing in [r[0] for r in cover.filter("is_cover").select("spacing").distinct().collect()]:
        own = lines.join(cover.filter("is_cover").filter(F.col("spacing") == spacing).select("challenge_id"), "challenge_id", "left_semi")
        part = nearby.route_checkpoints(own.select(F.struct("challenge_id", F.col("item_id").cast("string").alias("item_id")).alias("route_id"), "piece", "seq", "lat", "lon"), spacing)
        marks = part if marks is None else marks.unionByName(part)
    passed = now.filter("idx >= 0").select("athlete_id", F.struct("challenge_id", "item_id").alias("route_id"), "idx")
    shares = None if marks is None else progress.route_coverage(passed, marks.groupBy("route_id").agg(F.count("*").alias("total")))
    shares = now.limit(0).select("athlete_id", "challenge_id", F.col("item_id").alias("route_id"), F.lit(0.0).alias("share")) if shares is None else shares.select("athlete_id", "route_id.challenge_id", F.col("route_id.item_id").alias("route_id"), "share")
    done = progress.challenge_done(shares, totals, now.filter("idx < 0"), cover, copies)
    checks = results.checked.join(challenges.select("challenge_id", "key"), ["challenge_id", "key"], "left_semi").groupBy("athlete_id", "challenge_id").agg(F.count("*").alias("checked"))
    return checks.join(done, ["athlete_id", "challenge_id"], "left").select("athlete_id", "challenge_id", F.coalesce("done", F.lit(0)).alias("done"), "total", "checked")
