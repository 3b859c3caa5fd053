"""Track operators: windowed geometry over points (keys..., seq, lat, lon).

``seq`` is dense within a track (see ``reindex``); all windows run over blocks of a track.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import ordered
from wayfold.session import cut

TRACK = ("athlete_id", "activity_id")

# Spacing and longest filled gap, in metres, of each use of a densified track.
TILE_SPACING, TILE_GAP = 100.0, 2_000.0
COVERAGE_SPACING, COVERAGE_GAP = 20.0, 5_000.0
MATCH_SPACING = 20.0


def valid_positions(points: DataFrame) -> DataFrame:
    """Drops positions that are missing, (0, 0), or out of range."""
    lat, lon = F.col("lat"), F.col("lon")
    return points.filter(lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0))
                         & lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0))


# The invalid marker of device coordinates, and degrees per semicircle.
INVALID_SEMICIRCLE = 2_147_483_647
DEGREES_PER_SEMICIRCLE = 180.0 / 2_147_483_648.0


def semicircle_positions(points: DataFrame, lat: str = "lat_semi", lon: str = "lon_semi") -> DataFrame:
    """Device positions in degrees, without the invalid marker and (0, 0)."""
    ok = (F.col(lat) != INVALID_SEMICIRCLE) & (F.col(lon) != INVALID_SEMICIRCLE) & ((F.col(lat) != 0) | (F.col(lon) != 0))
    return (points.filter(ok).withColumn("lat", F.col(lat) * DEGREES_PER_SEMICIRCLE)
            .withColumn("lon", F.col(lon) * DEGREES_PER_SEMICIRCLE))


def reindex(points: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Makes ``seq`` dense from 0 again after points were dropped."""
    numbered = ordered.ordinals(points, keys, ["seq"], F.floor(F.col("seq") / ordered.BLOCK), "_n")
    return numbered.withColumn("seq", (F.col("_n") - 1).cast("int")).drop("_n")


def with_next(points: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    return ordered.neighbours(points, keys, {"lat2": ("lat", 1), "lon2": ("lon", 1)})


def segments(points: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Consecutive point pairs with their length."""
    return (with_next(points, keys).filter(F.col("lat2").isNotNull())
            .withColumn("metres", geo.distance_m("lat", "lon", "lat2", "lon2")))


def interpolate(points: DataFrame, steps: Column, keys: Sequence[str] = TRACK) -> DataFrame:
    """Each segment cut into ``steps`` (a column over ``metres``) parts; adds ``sub`` within seq."""
    spaced = (with_next(points, keys)
              .withColumn("metres", geo.distance_m("lat", "lon", "lat2", "lon2"))
              .withColumn("_n", F.coalesce(steps, F.lit(1)).cast("int"))
              .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))))
    share = F.col("sub") / F.col("_n")
    return (spaced.withColumn("lat", F.when(F.col("sub") == 0, F.col("lat")).otherwise(F.col("lat") + (F.col("lat2") - F.col("lat")) * share))
            .withColumn("lon", F.when(F.col("sub") == 0, F.col("lon")).otherwise(F.col("lon") + (F.col("lon2") - F.col("lon")) * share))
            .drop("_n", "lat2", "lon2", "metres"))


def densify(points: DataFrame, spacing: float, max_gap: float | None = TILE_GAP, keys: Sequence[str] = TRACK) -> DataFrame:
    """Points at most ``spacing`` metres apart; segments longer than ``max_gap`` stay open."""
    wide = F.col("metres") > spacing
    if max_gap is not None:
        wide = wide & (F.col("metres") <= max_gap)
    return interpolate(points, F.when(wide, F.ceil(F.col("metres") / spacing)), keys)


def densify_for_matching(points: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """The spacing of climb and route matching: whole 20 m steps, gaps of any length filled."""
    return interpolate(points, F.greatest(F.lit(1), F.floor(F.col("metres") / MATCH_SPACING).cast("int")), keys)


def tiles(points: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Distinct explorer tiles touched by each track."""
    dense = densify(points, TILE_SPACING, TILE_GAP, keys)
    return (dense.select(*keys, geo.tile_key_at("lat", "lon").alias("tile_key")).filter("tile_key is not null").distinct()
            .select(*keys, "tile_key", geo.key_x("tile_key").alias("x"), geo.key_y("tile_key").alias("y")))


def tiles_ordered(points: DataFrame, activity_tiles: DataFrame | None = None, keys: Sequence[str] = TRACK) -> DataFrame:
    """Each activity's tiles with the track position (seq, sub) that first reaches them.

    Every gap is filled here; tiles the walk misses have a null position and come last."""
    walked = (densify(points, TILE_SPACING, None, keys).select(*keys, geo.tile_key_at("lat", "lon").alias("tile_key"), "seq", "sub")
              .filter("tile_key is not null").groupBy(*keys, "tile_key")
              .agg(F.min(F.struct("seq", "sub")).alias("reached")))
    own = tiles(points, keys) if activity_tiles is None else activity_tiles
    return (own.join(walked, [*keys, "tile_key"], "left")
            .select(*keys, "tile_key", F.col("reached.seq").alias("first_seq"), F.col("reached.sub").alias("first_sub")))


def length(points: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    return (with_next(points, keys).groupBy(*keys)
            .agg(F.coalesce(F.sum(geo.distance_m("lat", "lon", "lat2", "lon2")), F.lit(0.0)).alias("metres")))


def bbox(points: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"),
                                     F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def _with_walked(segs: DataFrame, keys: Sequence[str], metres: str = "metres") -> DataFrame:
    return ordered.running(segs, keys, ["seq"], {"walked": (F.col(metres), "sum")}, F.floor(F.col("seq") / ordered.BLOCK),
                           exclusive=True, totals=True)


def midpoint(points: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """The point at half the length of each line."""
    segs = _with_walked(segments(points, keys), keys).withColumn("half", F.col("walked_total") / 2)
    at = (F.col("half") - F.col("walked")) / F.col("metres")
    hit = (segs.filter((F.col("walked") + F.col("metres") >= F.col("half")) & (F.col("metres") > 0))
           .groupBy(*keys).agg(F.min_by(F.struct((F.col("lat") + (F.col("lat2") - F.col("lat")) * at).alias("lat"),
                                                 (F.col("lon") + (F.col("lon2") - F.col("lon")) * at).alias("lon")), "seq").alias("p")))
    last = points.groupBy(*keys).agg(F.max_by(F.struct("lat", "lon"), "seq").alias("last"))
    return last.join(hit, list(keys), "left").select(*keys, F.coalesce("p.lat", "last.lat").alias("lat"),
                                                     F.coalesce("p.lon", "last.lon").alias("lon"))


def even_times(points: DataFrame, activities: DataFrame, keys: Sequence[str] = TRACK) -> DataFrame:
    """Timestamps spread evenly over the elapsed (else moving, else one second per point) time."""
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_first"))
    spans = counts.join(activities.select(*keys, "start_ts", "elapsed_s", "moving_s"), list(keys))
    total = F.coalesce("elapsed_s", "moving_s", F.col("_n").cast("double"))
    step = F.when(F.col("_n") > 1, total / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    return (points.join(spans, list(keys))
            .withColumn("t_off", (F.col("seq") - F.col("_first")) * step)
            .withColumn("t", F.timestamp_micros((F.unix_micros("start_ts") + F.rint(F.col("t_off") * 1e6)).cast("bigint")))
            .drop("_n", "_first", "start_ts", "elapsed_s", "moving_s"))


def simplify(points: DataFrame, tolerance: float, keys: Sequence[str] = TRACK) -> DataFrame:
    """Douglas-Peucker on all tracks together, one level of splits per round.

    Each round finds the farthest point of every open span with one partial aggregate and keeps
    only the points of spans that split, so rounds follow the recursion depth and shrink fast."""
    ends = points.groupBy(*keys).agg(F.min(F.struct("seq", "lat", "lon")).alias("a"), F.max(F.struct("seq", "lat", "lon")).alias("b"))
    flat = (points.select(*keys, "seq", "lat", "lon").join(ends, list(keys))
            .withColumn("_kx", F.cos(F.radians(F.col("a.lat"))) * geo.METRES_PER_DEGREE_LON))
    kx, ky = F.col("_kx"), geo.METRES_PER_DEGREE_LAT
    flat = cut(flat.select(*keys, "seq", (F.col("lon") * kx).alias("px"), (F.col("lat") * ky).alias("py"),
                           F.struct(F.col("a.seq").alias("seq"), (F.col("a.lon") * kx).alias("x"), (F.col("a.lat") * ky).alias("y")).alias("lo"),
                           F.struct(F.col("b.seq").alias("seq"), (F.col("b.lon") * kx).alias("x"), (F.col("b.lat") * ky).alias("y")).alias("hi")))
    kept = ends.select(*keys, F.explode(F.array("a.seq", "b.seq")).alias("seq")).distinct()
    open_points = flat.filter((F.col("seq") > F.col("lo.seq")) & (F.col("seq") < F.col("hi.seq")))
    found = []
    while True:
        dx, dy = F.col("hi.x") - F.col("lo.x"), F.col("hi.y") - F.col("lo.y")
        ex, ey = F.col("px") - F.col("lo.x"), F.col("py") - F.col("lo.y")
        len2 = dx * dx + dy * dy
        t = F.when(len2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ex * dx + ey * dy) / len2))).otherwise(F.lit(0.0))
        d2 = (ex - t * dx) * (ex - t * dx) + (ey - t * dy) * (ey - t * dy)
        span = [*keys, F.col("lo.seq").alias("_lo")]
        far = (open_points.select(*span, d2.alias("d2"), "seq", "px", "py").groupBy(*keys, "_lo")
               .agg(F.max(F.struct("d2", (-F.col("seq")).alias("neg"), "px", "py")).alias("far"))
               .filter(F.col("far.d2") > tolerance * tolerance)
               .select(*keys, "_lo", F.struct((-F.col("far.neg")).alias("seq"), F.col("far.px").alias("x"), F.col("far.py").alias("y")).alias("mid")))
        far = cut(far)
        if far.isEmpty():
            break
        found.append(far.select(*keys, F.col("mid.seq").alias("seq")))
        left = F.col("seq") < F.col("mid.seq")
        open_points = cut(open_points.withColumn("_lo", F.col("lo.seq")).join(far, [*keys, "_lo"])
                          .filter(F.col("seq") != F.col("mid.seq"))
                          .select(*keys, "seq", "px", "py", F.when(left, F.col("lo")).otherwise(F.col("mid")).alias("lo"),
                                  F.when(left, F.col("mid")).otherwise(F.col("hi")).alias("hi")))
    for rows in found:
        kept = kept.unionByName(rows)
    return points.join(kept.distinct(), [*keys, "seq"], "left_semi")


def ring_area(ring_points: DataFrame, keys: Sequence[str] = ("code", "poly", "ring")) -> DataFrame:
    """Planar area of each ring in square degrees (shoelace, closed implicitly)."""
    nxt = with_next(ring_points, keys)
    cross = F.coalesce(F.col("lon") * F.col("lat2") - F.col("lon2") * F.col("lat"), F.lit(0.0))
    return (nxt.groupBy(*keys).agg(F.sum(cross).alias("s"), F.min_by(F.struct("lat", "lon"), "seq").alias("f"),
                                   F.max_by(F.struct("lat", "lon"), "seq").alias("l"))
            .select(*keys, (F.abs(F.col("s") + F.col("l.lon") * F.col("f.lat") - F.col("f.lon") * F.col("l.lat")) / 2).alias("area")))
