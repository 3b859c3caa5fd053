"""Everything that follows from the library, brought up to date in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import activity as fa
from wayfold.functions import geo
from wayfold.operators import areas, merge, nearby, stats, tiles, tracks
from wayfold.session import cut


@dataclass
class Library:
    """``activities``: merged ones under their current names; ``tiles`` and ``areas``: what those on the
    map visited; ``squares``: largest square and cluster; ``climbs``: (athlete_id, climb_id, times, copies),
    the first of ``copies`` climbs with equal checkpoints; ``same_climbs``: (climb_id, same), that first
    one of each; ``eddington``: by cycling."""

    activities: DataFrame
    tiles: DataFrame
    areas: DataFrame
    squares: DataFrame
    climbs: DataFrame
    same_climbs: DataFrame
    eddington: DataFrame


def refresh(activities: DataFrame, points: DataFrame, names: DataFrame, rings: DataFrame, climb_checkpoints: DataFrame, tz: str = "UTC") -> Library:
    """Names are laid over the activities (file_name), copies merged, and tracks of merged activities on
    the map matched with tiles, areas and climbs. A name may make an activity virtual, and a copy
    that is virtual makes its group so; their tracks then count nowhere."""
    named = cut(merge.overlay_names(activities, names))
    merged = cut(merge.best_copy(named.join(merge.duplicate_groups(named), ["athlete_id", "activity_id"])))
    on_map = merged.filter(fa.is_on_map("is_virtual", "n_points"))
    track = cut(points.join(on_map.select(*tracks.TRACK), list(tracks.TRACK), "left_semi"))
    seen = cut(tiles.visited(tracks.tiles(track)).select("athlete_id", "tile_key", geo.key_x("tile_key").alias("x"), geo.key_y("tile_key").alias("y")))
    inside = tiles.visited(areas.track_areas(track, areas.cell_index(rings)), columns=("code",))
    same = cut(nearby.same_checkpoints(climb_checkpoints, "climb_id"))
    copies = same.groupBy(F.col("same").alias("climb_id")).agg(F.count("*").alias("copies"))
    ridden = nearby.first_climb_matches(track, climb_checkpoints, same).groupBy("athlete_id", "climb_id").agg(F.count("*").alias("times")).join(copies, "climb_id")
    return Library(merged, seen, cut(inside), cut(tiles.square_stats(seen)), cut(ridden), same, stats.eddington(merged, fa.CYCLING_SPORTS, tz))


def climbs_of(library: Library) -> DataFrame:
    """(athlete_id, climb_id, times) with a row for every climb; its rows aren't exchanged again."""
    return library.climbs.withColumnRenamed("climb_id", "same").join(library.same_climbs, "same").select("athlete_id", "climb_id", "times")


def summary(library: Library) -> DataFrame:
    """One row per athlete: activities, tiles, areas, square, cluster, climbs and eddington."""
    out = library.activities.groupBy("athlete_id").agg(F.count("*").alias("activities"), F.sum("copies").alias("files"))
    counts = {"areas": (library.areas, F.count("*")), "climbs": (library.climbs, F.sum("copies"))}
    out = out.join(library.squares.select("athlete_id", "tiles", "square", "cluster"), "athlete_id", "left").join(library.eddington.select("athlete_id", F.col("number").alias("eddington")), "athlete_id", "left")
    for name, (table, number) in counts.items():
        out = out.join(table.groupBy("athlete_id").agg(number.alias(name)), "athlete_id", "left")
    return out.select("athlete_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("activities", "files", "tiles", "areas", "square", "cluster", "climbs", "eddington")])
