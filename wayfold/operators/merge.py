"""Copies of one workout: which activities belong together, and what the merged workout is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.operators import graph
from wayfold.session import cut

# Seconds between starts that always mean one workout, and the overlap shares.
TOLERANCE_S = 120
SAME_OVERLAP, SAME_KIND_OVERLAP = 0.8, 0.5

_US = 1_000_000
_BUCKET_US = 4 * 3600 * _US
_HOUR_US = 3600 * _US


def _timed(activities: DataFrame) -> DataFrame:
    return (activities.filter("start_ts is not null")
            .select("athlete_id", "activity_id", F.unix_micros("start_ts").alias("start_us"),
                    F.coalesce("elapsed_s", F.lit(0.0)).alias("elapsed"), fa.category("sport").alias("kind")))


def _overlap_rule(a: str, b: str) -> Column:
    """The overlap half of the same-workout rule for sides ``a`` and ``b`` (struct columns)."""
    s1, s2 = F.col(f"{a}.start_us") / 1e6, F.col(f"{b}.start_us") / 1e6
    d1, d2 = F.col(f"{a}.elapsed"), F.col(f"{b}.elapsed")
    ratio = (F.least(s1 + d1, s2 + d2) - F.greatest(s1, s2)) / F.least(d1, d2)
    kinds = (F.col(f"{a}.kind") == F.col(f"{b}.kind")) | (F.col(f"{a}.kind") == "other") | (F.col(f"{b}.kind") == "other")
    return (d1 > 0) & (d2 > 0) & (ratio > 0) & ((ratio >= SAME_OVERLAP) | ((ratio >= SAME_KIND_OVERLAP) & kinds))


def _start_rule(a: str, b: str) -> Column:
    return F.abs(F.col(f"{a}.start_us") - F.col(f"{b}.start_us")) <= TOLERANCE_S * _US


def _buckets(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / _BUCKET_US), F.floor(F.greatest(first, last) / _BUCKET_US)))


def _end_us(start="start_us", elapsed="elapsed") -> Column:
    return F.col(start) + (F.greatest(F.col(elapsed), F.lit(0.0)) * 1e6).cast("bigint")


def same_workout(probes: DataFrame, library: DataFrame) -> DataFrame:
    """Pairs (athlete_id, activity_id, library_id) of one workout.

    The start and overlap rules alone decide, as in ``duplicate_groups``."""
    def side(df, name):
        t = _timed(df)
        slack = TOLERANCE_S * _US
        return t.select("athlete_id", F.struct("activity_id", "start_us", "elapsed", "kind").alias(name),
                        _buckets(F.col("start_us") - slack, _end_us() + slack).alias("bucket"))

    pairs = side(probes, "a").join(side(library, "b"), ["athlete_id", "bucket"])
    return (pairs.filter(_start_rule("a", "b") | _overlap_rule("a", "b"))
            .select("athlete_id", F.col("a.activity_id").alias("activity_id"), F.col("b.activity_id").alias("library_id")).distinct())


def duplicate_groups(activities: DataFrame) -> DataFrame:
    """(athlete_id, activity_id, group_id): each activity joins the earliest group holding a copy.

    In start order an activity joins the first group with a same-workout member, which is the group
    of its smallest ancestor along same-workout links, so labels are propagated over links:
    * identical (start, elapsed, kind) rows collapse to their first and last id beforehand;
    * the "starts within 120 s" rule needs only links between neighbours in start order: whatever lies
      between two such rows is linked to the next one too;
    * the overlap rule is an equi-join on four-hour buckets, each later start in one bucket only.
    ``group_id`` is the id of the group's first member; undated activities stand alone."""
    rows = _timed(activities)
    classes = cut(rows.groupBy("athlete_id", "start_us", "elapsed", "kind").agg(F.min("activity_id").alias("first"), F.max("activity_id").alias("last")))
    nodes = classes.select("athlete_id", "start_us", "elapsed", "kind", "first", "last",
                           F.explode(F.array_distinct(F.array("first", "last"))).alias("activity_id"))
    # Rows near the end of an hour also stand in the next one, as what its first row may follow.
    home, slack = F.floor(F.col("start_us") / _HOUR_US), TOLERANCE_S * _US
    hours = F.when(F.pmod(F.col("start_us"), F.lit(_HOUR_US)) >= _HOUR_US - slack, F.array(home, home + 1)).otherwise(F.array(home))
    placed = nodes.select("athlete_id", F.struct("start_us", "activity_id").alias("dst"), home.alias("home"), F.explode(hours).alias("hour"))
    chain = (placed.withColumn("src", F.lag("dst").over(Window.partitionBy("athlete_id", "hour").orderBy("dst")))
             .filter((F.col("hour") == F.col("home")) & (F.col("dst.start_us") - F.col("src.start_us") <= slack)).select("athlete_id", "dst", "src"))
    timed = F.struct("activity_id", "start_us", "elapsed", "kind")
    earlier = (nodes.filter((F.col("activity_id") == F.col("last")) & (F.col("elapsed") > 0))
               .select("athlete_id", timed.alias("a"), _buckets(F.col("start_us"), _end_us()).alias("bucket")))
    later = (nodes.filter((F.col("activity_id") == F.col("first")) & (F.col("elapsed") > 0))
             .select("athlete_id", timed.alias("b"), F.floor(F.col("start_us") / _BUCKET_US).alias("bucket")))
    overlap = (earlier.join(later, ["athlete_id", "bucket"])
               .filter((F.col("b.start_us") - F.col("a.start_us") > TOLERANCE_S * _US) & _overlap_rule("a", "b"))
               .select("athlete_id", F.struct(F.col("b.start_us").alias("start_us"), F.col("b.activity_id").alias("activity_id")).alias("dst"),
                       F.struct(F.col("a.start_us").alias("start_us"), F.col("a.activity_id").alias("activity_id")).alias("src")))
    edges = chain.unionByName(overlap)
    labels = graph.propagate_min(edges, ["athlete_id"])
    # A row's label is the label of the last node at or before it; that differs from its class's
    # last node only while other rows of the very same start come in between.
    def of(end):
        return labels.select("athlete_id", F.col("node.start_us").alias("start_us"), F.col("node.activity_id").alias(end), F.col("label").alias(f"{end}_label"))
    labelled = (classes.join(of("first"), ["athlete_id", "start_us", "first"], "left").join(of("last"), ["athlete_id", "start_us", "last"], "left")
                .select("athlete_id", "start_us", "elapsed", "kind", F.coalesce("first_label", F.struct("start_us", F.col("first").alias("activity_id"))).alias("hi"),
                        F.coalesce("last_label", F.struct("start_us", F.col("last").alias("activity_id"))).alias("lo")))
    joined = rows.join(labelled, ["athlete_id", "start_us", "elapsed", "kind"])
    settled = joined.filter(F.col("hi") == F.col("lo")).select("athlete_id", "activity_id", F.col("lo.activity_id").alias("group_id"))
    same_start = labels.select("athlete_id", F.col("node.start_us").alias("start_us"), F.col("node.activity_id").alias("node_id"), "label")
    between = (joined.filter(F.col("hi") != F.col("lo")).join(same_start, ["athlete_id", "start_us"]).filter(F.col("node_id") <= F.col("activity_id"))
               .groupBy("athlete_id", "activity_id").agg(F.min("label").alias("label"))
               .select("athlete_id", "activity_id", F.col("label.activity_id").alias("group_id")))
    undated = activities.filter("start_ts is null").select("athlete_id", "activity_id", F.col("activity_id").alias("group_id"))
    return settled.unionByName(between).unionByName(undated)


def best_copy(members: DataFrame) -> DataFrame:
    """One merged activity per (athlete_id, group_id) of ``members``."""
    order = F.struct(F.unix_micros("start_ts").alias("start_us"), "activity_id")
    best = F.struct((-F.col("quality")).alias("q"), (-F.coalesce("distance_m", F.lit(0.0))).alias("d"), order.alias("o"))

    def other(column):
        return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), order)).alias(f"other_{column}")

    filled = ["avg_power_w", "moving_s", "elapsed_s", "ascent_m", "descent_m"]
    own = [c for c in members.columns if c not in ("athlete_id", "group_id")]
    merged = members.groupBy("athlete_id", "group_id").agg(
        F.min_by(F.struct(*own), best).alias("b"), F.bool_or("is_virtual").alias("any_virtual"), F.bool_or("is_zwift").alias("any_zwift"),
        F.count(F.lit(1)).alias("copies"),
        F.min_by("name", F.when(F.col("source") == "feed", order)).alias("feed_name"), *[other(c) for c in filled])
    name = F.when((F.col("b.source") != "feed") & F.col("feed_name").isNotNull(), F.col("feed_name")).otherwise(F.col("b.name"))
    flags = {"name": name, "is_virtual": F.coalesce(F.col("any_virtual"), F.lit(False)), "is_zwift": F.coalesce(F.col("any_zwift"), F.lit(False)),
             **{c: F.coalesce(F.col(f"b.{c}"), F.col(f"other_{c}")) for c in filled}}
    return merged.select("athlete_id", "group_id", *[flags.get(c, F.col(f"b.{c}")).alias(c) for c in own], "copies")


def preferred_file(members: DataFrame) -> DataFrame:
    """Marks the file to keep of each group: GPS quality, original recording, power, distance."""
    file_name = F.substring_index(F.col("file_name"), "|", -1)
    order = F.struct((-F.col("quality")).alias("q"), fa.is_own_export(file_name).cast("int").alias("own"),
                     F.col("avg_power_w").isNull().cast("int").alias("p"), (-F.coalesce("distance_m", F.lit(0.0))).alias("d"),
                     F.unix_micros("start_ts").alias("s"), F.col("activity_id").alias("i"))
    keep = members.groupBy("athlete_id", "group_id").agg(F.min_by("activity_id", order).alias("keep_id"))
    return (members.join(keep, ["athlete_id", "group_id"])
            .select("athlete_id", "group_id", "activity_id", (F.col("activity_id") == F.col("keep_id")).alias("keep")))


def overlay_names(activities: DataFrame, names: DataFrame) -> DataFrame:
    """Current names (file_name, new_name) replace stored ones; flags follow the new name."""
    joined = activities.join(names.select("file_name", "new_name"), "file_name", "left")
    changed = F.col("new_name").isNotNull() & (F.col("new_name") != "") & ~F.col("new_name").eqNullSafe(F.col("name"))
    return (joined.withColumn("is_virtual", F.when(changed & fa.name_is_virtual("new_name"), True).otherwise(F.col("is_virtual")))
            .withColumn("is_zwift", F.when(changed & fa.is_zwift_name("new_name"), True).otherwise(F.col("is_zwift")))
            .withColumn("name", F.when(changed, F.col("new_name")).otherwise(F.col("name"))).drop("new_name"))


def union_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out
