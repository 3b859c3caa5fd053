"""Set operations that keep a library, its feed and its catalogues in step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators import merge, ordered

# Fixed value: seconds the feed is read again.
REREAD_S = 86_400


def mirror_diff(source: DataFrame, target: DataFrame, deleted: DataFrame) -> DataFrame:
    """Names of ``source`` that ``target`` lacks and nobody deleted."""
    return source.select("name").distinct().join(target.select("name"), "name", "left_anti").join(deleted.select("name"), "name", "left_anti")


def country_prune(enabled: DataFrame, visited_areas: DataFrame, failed: DataFrame) -> DataFrame:
    """Enabled countries (athlete_id, country) with a visited area or a failed load.

    An athlete keeps the current choice where nothing would be left."""
    wanted = visited_areas.select("athlete_id", F.substring_index("code", ":", 1).alias("country")).unionByName(failed.select("athlete_id", "country")).distinct()
    marked = enabled.join(wanted.withColumn("hit", F.lit(True)), ["athlete_id", "country"], "left")
    some = marked.groupBy("athlete_id").agg(F.bool_or("hit").alias("any_hit"))
    return marked.join(some, "athlete_id").filter(F.col("hit") | F.col("any_hit").isNull()).select("athlete_id", "country")


def feed_new(listed: DataFrame, known: DataFrame, deleted: DataFrame) -> DataFrame:
    """Listed activities that are neither known nor deleted, read again from a day before the
    athlete's latest known start."""
    mark = known.groupBy("athlete_id").agg(F.max("start_ts").alias("_mark"))
    recent = listed.join(mark, "athlete_id", "left").filter(F.col("_mark").isNull() | (F.col("start_ts") > F.col("_mark") - F.expr(f"INTERVAL {REREAD_S} SECONDS")))
    return (recent.drop("_mark").join(known.select("athlete_id", "activity_id"), ["athlete_id", "activity_id"], "left_anti")
            .join(deleted.select("athlete_id", "activity_id"), ["athlete_id", "activity_id"], "left_anti"))


def detail_queue(activities: DataFrame, library: DataFrame, present_files: DataFrame) -> DataFrame:
    """Activities that still need full detail, newest first per athlete (``pos``).

    ``exported_file`` counts only while its file is present or the library has a copy (with GPS,
    when the activity has GPS)."""
    with_gps = merge.same_workout(activities, library.filter("quality > 0")).select("athlete_id", "activity_id").distinct().withColumn("gps_copy", F.lit(True))
    any_copy = merge.same_workout(activities, library).select("athlete_id", "activity_id").distinct().withColumn("any_copy", F.lit(True))
    there = present_files.select(F.col("name").alias("exported_file")).withColumn("there", F.lit(True))
    rows = (activities.join(with_gps, ["athlete_id", "activity_id"], "left").join(any_copy, ["athlete_id", "activity_id"], "left").join(there, "exported_file", "left"))
    covered = F.when(F.col("quality") > 0, F.col("gps_copy")).otherwise(F.col("any_copy"))
    saved = F.col("exported_file").isNotNull() & (F.coalesce("there", F.lit(False)) | F.coalesce(covered, F.lit(False)))
    queue = rows.filter((F.col("quality") > 0) & F.col("gps_copy").isNull() & ((F.col("quality") == 1) | ~saved))
    day = F.coalesce(F.unix_date(F.to_date("start_ts")), F.lit(-(10 ** 6)))
    return ordered.ordinals(queue.select("athlete_id", "activity_id", "start_ts", "quality"), ["athlete_id"], [F.desc_nulls_last("start_ts"), "activity_id"], day, "pos", descending=True)


def catalogue_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Ids added to or removed from a catalogue."""
    added = new.select("id").distinct().join(old.select("id"), "id", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(old.select("id").distinct().join(new.select("id"), "id", "left_anti").withColumn("change", F.lit("removed")))


def tombstones(log: DataFrame, keys=()) -> DataFrame:
    """State of each name from signed change times (negative: restored). Every name is kept.

    Equal times keep the first writer."""
    keys = list(keys)
    writer = F.col("writer") if "writer" in log.columns else F.lit(0)
    state = log.groupBy(*keys, "name").agg(F.max_by("changed_at", F.struct(F.abs("changed_at").alias("t"), (-writer).alias("w"))).alias("changed_at"))
    return state.select(*keys, "name", "changed_at", (F.col("changed_at") > 0).alias("deleted"))


def names_log(log: DataFrame, keys=("athlete_id",)) -> DataFrame:
    """Current name per file from (keys..., file_name, new_name, arrival); the last arrival wins.
    Every file is kept."""
    keys = list(keys)
    current = log.groupBy(*keys, "file_name").agg(F.max(F.struct("arrival", "new_name")).alias("m"))
    return current.select(*keys, "file_name", "m.new_name", "m.arrival")
