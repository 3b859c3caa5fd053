"""Joins of tracks with places, crossings, route checkpoints and climbs, all on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import ordered, tracks
from wayfold.session import cut

# Tolerances in metres and shares of the matchers.
CHECKPOINT_M, CLIMB_SHARE = 30.0, 0.9
CROSSING_MIN_M, CROSSING_MAX_M = 15.0, 80.0
CHECKPOINT_CELL = 0.0005
LANDING_M, LANDING_DLAT, LANDING_DLON = 5_000.0, 0.05, 0.08
#: Cells in which track pieces look for targets before they are cut into points.
COARSE_CELL = 0.004
#: Columns of a target's place; targets that share them are met together.
SPOT, CIRCLE = ["tlat", "tlon"], ["tlat", "tlon", "radius"]


#: Cell sizes in degrees of the grid's levels. A target lies on the finest level whose cells are at
#: least as wide as its radius, so few segments meet it that are far away.
LEVELS = [0.001 * 4 ** i for i in range(8)]


def _level(radius: Column) -> Column:
    """The level of a radius in metres, counted from the finest."""
    return sum([(radius / 110_000.0 > size).cast("int") for size in LEVELS[:-1]], F.lit(0))


def _size(level: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), level + 1)


def _pieces(segs: DataFrame, levels: list[int]) -> DataFrame:
    """Segments with the cells they pass on each of ``levels``, one row per cell of each short piece.

    Long segments are walked in steps of one cell, so their rows grow with length, not area."""
    c = F.col("_c")
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("lat2") - F.col("lat")), F.abs(F.col("lon2") - F.col("lon"))) / c).cast("int"))
    leveled = segs.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).withColumn("_c", _size(F.col("level")))
    walked = leveled.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def at(a, b, i):
        return F.col(a) + (F.col(b) - F.col(a)) * i / F.col("_n")

    def cells(low, high):
        return F.explode(F.sequence(F.floor(low / c).cast("bigint"), F.floor(high / c).cast("bigint")))

    i = F.col("_i")
    ya, yb, xa, xb = at("lat", "lat2", i), at("lat", "lat2", i + 1), at("lon", "lon2", i), at("lon", "lon2", i + 1)
    eps = 1e-9
    return (walked.withColumn("cy", cells(F.least(ya, yb) - eps, F.greatest(ya, yb) + eps))
            .withColumn("cx", cells(F.least(xa, xb) - eps, F.greatest(xa, xb) + eps)).drop("_n", "_i", "_c"))


def _target_cells(targets: DataFrame) -> DataFrame:
    """Targets (tlat, tlon, radius) in every cell of their level within their radius."""
    c = F.col("_c")
    dlat = F.col("radius") / 110_000.0
    dlon = F.col("radius") / (110_000.0 * F.greatest(F.cos(F.radians(F.abs("tlat") + dlat)), F.lit(0.01)))

    def cells(low, high):
        return F.explode(F.sequence(F.floor(low / c).cast("bigint"), F.floor(high / c).cast("bigint")))

    leveled = targets.withColumn("level", _level(F.col("radius"))).withColumn("_c", _size(F.col("level")))
    return leveled.withColumn("cy", cells(F.col("tlat") - dlat, F.col("tlat") + dlat)).withColumn("cx", cells(F.col("tlon") - dlon, F.col("tlon") + dlon)).drop("_c")


def near_candidates(lines: DataFrame, targets: DataFrame, keys, with_single: bool = True) -> DataFrame:
    """Segments and targets that share a cell: what ``near_segments`` measures."""
    shaped = ordered.neighbours(lines, keys, {"lat2": ("lat", 1), "lon2": ("lon", 1), "_before": ("lat", -1)})
    lone = F.col("lat2").isNull() & F.col("_before").isNull()
    kept = shaped.filter(F.col("lat2").isNotNull() | lone) if with_single else shaped.filter("lat2 is not null")
    segs = kept.select(*keys, "lat", "lon", F.coalesce("lat2", "lat").alias("lat2"), F.coalesce("lon2", "lon").alias("lon2"), lone.alias("_lone"))
    return _met(segs, targets)


def _met(segs: DataFrame, targets: DataFrame) -> DataFrame:
    levels = sorted(r[0] for r in targets.select(_level(F.col("radius"))).distinct().collect() if r[0] is not None)  # at most all levels
    return _pieces(segs, levels or [0]).join(_target_cells(targets), ["level", "cy", "cx"]).drop("level")


def near_segments(lines: DataFrame, targets: DataFrame, keys, with_single: bool = True) -> DataFrame:
    """Rows (keys..., target columns..., metres) of targets within their radius of a segment.

    A line of a single point counts by its distance to that point when ``with_single``."""
    return _within(near_candidates(lines, targets, keys, with_single)).select(*keys, *targets.columns, "metres")


def _within(met: DataFrame) -> DataFrame:
    metres = (F.when(F.col("_lone"), geo.distance_m("lat", "lon", "tlat", "tlon"))
              .otherwise(geo.segment_distance_m("tlat", "tlon", "lat", "lon", "lat2", "lon2")))
    return met.withColumn("metres", metres).filter(F.col("metres") <= F.col("radius"))


def place_visits(points: DataFrame, places: DataFrame, keys=tracks.TRACK) -> DataFrame:
    """Places (challenge_id, item_id, lat, lon, radius) each track passes within their radius.

    Many places may stand on one spot: a last join adds them, and its rows are exchanged again only
    for items that stand on several spots and may be met twice."""
    item = ["challenge_id", "item_id"]
    own = places.select(*item, F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), "radius").distinct()
    targets = cut(own.withColumn("_spots", F.count(F.lit(1)).over(Window.partitionBy(*item))))  # the spots of one item
    met = cut(near_segments(points, targets.select(*CIRCLE).distinct(), keys).select(*keys, *CIRCLE).distinct())

    def visited(spots):
        return met.join(targets.filter(spots), CIRCLE).select(*keys, *item)

    return visited("_spots = 1").unionByName(visited("_spots > 1").distinct())


def crossings(points: DataFrame, lines: DataFrame, keys=tracks.TRACK) -> DataFrame:
    """Lines (route_id, seq, lat, lon) a track passes near the middle and near both ends."""
    ends = lines.groupBy("route_id").agg(F.min_by(F.struct("lat", "lon"), "seq").alias("a"), F.max_by(F.struct("lat", "lon"), "seq").alias("b"))
    middle = tracks.midpoint(lines, ["route_id"]).select("route_id", F.struct("lat", "lon").alias("m"))
    sized = tracks.length(lines, ["route_id"]).select("route_id", F.least(F.lit(CROSSING_MAX_M), F.greatest(F.lit(CROSSING_MIN_M), F.col("metres") / 3)).alias("radius"))
    # Lines with the same anchors are crossed together, so they are matched once.
    whole = cut(ends.join(middle, "route_id").join(sized, "route_id").select("route_id", F.struct("m", "a", "b", "radius").alias("shape")))
    anchors = (whole.select("shape").distinct().select("shape", F.posexplode(F.array("shape.m", "shape.a", "shape.b")).alias("anchor", "p"))
               .select("shape", F.expr("shiftleft(1, anchor)").alias("bit"), F.col("p.lat").alias("tlat"), F.col("p.lon").alias("tlon"), F.col("shape.radius").alias("radius")))
    hits = near_segments(points, anchors, keys, with_single=False)
    crossed = hits.groupBy(*keys, "shape").agg(F.bit_or("bit").alias("m")).filter("m = 7")
    return crossed.join(whole, "shape").select(*keys, "route_id")


def route_checkpoints(lines: DataFrame, spacing: float) -> DataFrame:
    """Checkpoints (route_id, idx, lat, lon) every ``spacing`` metres over all pieces in order."""
    dense = tracks.densify(lines, spacing, None, ["route_id", "piece"])
    numbered = ordered.ordinals(dense, ["route_id"], ["piece", "seq", "sub"], F.col("piece") * 1_000_000 + F.floor(F.col("seq") / ordered.BLOCK), "_n")
    return numbered.select("route_id", (F.col("_n") - 1).alias("idx"), "lat", "lon")


def _row_width(row: Column) -> Column:
    return CHECKPOINT_CELL / F.greatest(F.cos(F.radians(row * CHECKPOINT_CELL)), F.lit(0.01))


def near_points(dense: DataFrame, targets: DataFrame, metres: float = CHECKPOINT_M) -> DataFrame:
    """Pairs of track points and targets (tlat, tlon) at most ``metres`` apart.

    Cell columns widen with latitude; targets enter the cells of the three rows around them."""
    own = dense.withColumn("cy", geo.cell("lat", CHECKPOINT_CELL)).withColumn("cx", F.floor(F.col("lon") / _row_width(F.col("cy"))))
    dlon = metres * 1.05 / (geo.METRES_PER_DEGREE_LON * F.greatest(F.cos(F.radians("tlat")), F.lit(0.01)))
    rows = targets.withColumn("cy", F.explode(F.sequence(geo.cell("tlat", CHECKPOINT_CELL) - 1, geo.cell("tlat", CHECKPOINT_CELL) + 1)))
    width = _row_width(F.col("cy"))
    cells = rows.withColumn("cx", F.explode(F.sequence(F.floor((F.col("tlon") - dlon) / width), F.floor((F.col("tlon") + dlon) / width))))
    return own.join(cells, ["cy", "cx"]).filter(geo.distance_m("lat", "lon", "tlat", "tlon") <= metres).drop("cy", "cx")


def points_near(points: DataFrame, targets: DataFrame, metres: float = CHECKPOINT_M, keys=tracks.TRACK) -> DataFrame:
    """The points of ``tracks.densify_for_matching`` (keys..., seq, sub, lat, lon) of those pieces of the
    tracks that pass near a target (tlat, tlon).

    Segments are cut into pieces of at most one coarse cell, each known by the cell of its middle;
    targets stand in all cells from which such a piece can reach them. Only pieces that meet one
    are cut into points, so points grow with what is near and not with the tracks."""
    c = COARSE_CELL
    spaced = tracks.with_next(points, keys).withColumn("_n", F.coalesce(F.greatest(F.lit(1), F.floor(geo.distance_m("lat", "lon", "lat2", "lon2") / tracks.MATCH_SPACING).cast("int")), F.lit(1)))
    extent = F.greatest(F.abs(F.col("lat2") - F.col("lat")), F.abs(F.col("lon2") - F.col("lon")))
    parts = F.coalesce(F.least(F.col("_n"), F.greatest(F.lit(1), F.ceil(extent / c).cast("int"))), F.lit(1))
    cut_up = spaced.withColumn("_k", parts).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    first, after = F.floor(F.col("_j") * F.col("_n") / F.col("_k")).cast("int"), F.floor((F.col("_j") + 1) * F.col("_n") / F.col("_k")).cast("int")
    middle = (F.col("_first") + F.col("_after") - 1) / 2 / F.col("_n")
    placed = cut_up.withColumn("_first", first).withColumn("_after", after).filter("_after > _first")
    placed = (placed.withColumn("_mlat", F.col("lat") + F.coalesce((F.col("lat2") - F.col("lat")) * middle, F.lit(0.0))).withColumn("_mlon", F.col("lon") + F.coalesce((F.col("lon2") - F.col("lon")) * middle, F.lit(0.0)))
              .withColumn("cy", geo.cell("_mlat", c)))

    def width(row):  # cells keep their width in metres towards the poles
        return c / F.greatest(F.cos(F.radians(row * c)), F.lit(0.01))

    placed = placed.withColumn("cx", F.floor(F.col("_mlon") / width(F.col("cy"))))
    # A piece reaches at most one cell from its middle.
    dlon = c + metres * 1.05 / (geo.METRES_PER_DEGREE_LON * F.greatest(F.cos(F.radians(F.abs("tlat") + c)), F.lit(0.01)))
    rows = targets.select("tlat", "tlon", F.explode(F.sequence(geo.cell(F.col("tlat") - c - metres / 110_000.0, c), geo.cell(F.col("tlat") + c + metres / 110_000.0, c))).alias("cy"))
    around = rows.select("cy", F.explode(F.sequence(F.floor((F.col("tlon") - dlon) / width(F.col("cy"))), F.floor((F.col("tlon") + dlon) / width(F.col("cy"))))).alias("cx")).distinct()
    near = placed.join(around, ["cy", "cx"], "left_semi")
    share = F.col("sub") / F.col("_n")
    return (near.withColumn("sub", F.explode(F.sequence(F.col("_first"), F.col("_after") - 1)))
            .select(*keys, "seq", "sub", F.when(F.col("sub") == 0, F.col("lat")).otherwise(F.col("lat") + (F.col("lat2") - F.col("lat")) * share).alias("lat"),
                    F.when(F.col("sub") == 0, F.col("lon")).otherwise(F.col("lon") + (F.col("lon2") - F.col("lon")) * share).alias("lon")))


def checkpoint_hits(points: DataFrame, checkpoints: DataFrame, keys=tracks.TRACK) -> DataFrame:
    """(keys..., route_id, idx): checkpoints within 30 m of the track.

    Checkpoints are one row per route and idx. Those of several routes on one spot are matched once;
    the last join adds the routes, and its rows are not exchanged again."""
    return spot_hits(points, checkpoints, keys).join(_on_spots(checkpoints), SPOT).select(*keys, "route_id", "idx")


def _on_spots(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.withColumnsRenamed({"lat": "tlat", "lon": "tlon"})


def spot_hits(points: DataFrame, checkpoints: DataFrame, keys=tracks.TRACK) -> DataFrame:
    """(keys..., tlat, tlon): spots of checkpoints within 30 m of the track, each once."""
    spots = _on_spots(checkpoints).select(*SPOT).distinct()
    dense = points_near(points, spots, keys=keys).select(*keys, "lat", "lon")
    return near_points(dense, spots).select(*keys, *SPOT).distinct()


def same_checkpoints(checkpoints: DataFrame, key: str = "route_id") -> DataFrame:
    """(key, same): for each line the smallest line with the same checkpoints, itself included.

    Lines are compared by two 64-bit sums over their checkpoints, so none is gathered in one value."""
    mark = [F.col("idx").cast("bigint"), F.col("lat"), F.col("lon")]
    sums = cut(checkpoints.groupBy(key).agg(F.bit_xor(F.xxhash64(*mark)).alias("_x"), F.bit_xor(F.xxhash64(F.lit("second"), *mark)).alias("_y"), F.count(F.lit(1)).alias("_z")))
    first = sums.groupBy("_x", "_y", "_z").agg(F.min(key).alias("same"))
    return sums.join(first, ["_x", "_y", "_z"]).select(key, "same")


def climb_matches(points: DataFrame, checkpoints: DataFrame, keys=tracks.TRACK) -> DataFrame:
    """Climbs (climb_id, idx, lat, lon: bottom first) ridden uphill by each track.

    At least 90 % of the checkpoints are passed and the first pass of the bottom precedes the last
    pass of the top; an end that is never passed leaves the coverage to decide."""
    twins = cut(same_checkpoints(checkpoints, "climb_id"))
    return first_climb_matches(points, checkpoints, twins, keys).withColumnRenamed("climb_id", "same").join(twins, "same").select(*keys, "climb_id")


def first_climb_matches(points: DataFrame, checkpoints: DataFrame, twins: DataFrame, keys=tracks.TRACK) -> DataFrame:
    """``climb_matches`` of the first of the climbs with equal checkpoints; ``twins`` (climb_id, same) tell the others."""
    checkpoints = checkpoints.join(twins.filter("climb_id = same").select("climb_id"), "climb_id", "left_semi")
    sizes = checkpoints.groupBy("climb_id").agg(F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"))
    spots = _on_spots(checkpoints).select(*SPOT).distinct()
    dense = points_near(points, spots, keys=keys).select(*keys, F.struct("seq", "sub").alias("pos"), "lat", "lon")
    passes = near_points(dense, spots).groupBy(*keys, *SPOT).agg(F.min("pos").alias("first"), F.max("pos").alias("final"))
    marks = _on_spots(checkpoints.join(sizes, "climb_id").select("climb_id", "idx", "lat", "lon", "n", "last"))
    climbs = (passes.join(marks, SPOT).groupBy(*keys, "climb_id", "n")
              .agg(F.count(F.lit(1)).alias("hit"), F.min(F.when(F.col("idx") == 0, F.col("first"))).alias("bottom"),
                   F.max(F.when(F.col("idx") == F.col("last"), F.col("final"))).alias("top")))
    ridden = climbs.filter((F.col("n") >= 2) & (F.col("hit") >= CLIMB_SHARE * F.col("n")) & F.coalesce(F.col("bottom") < F.col("top"), F.lit(True)))
    return ridden.select(*keys, "climb_id")


def nearest_landing_place(landings: DataFrame, places: DataFrame) -> DataFrame:
    """The nearest named place within 5 km (and a small box) of each landing (id, lat, lon)."""
    c = 0.1
    spots = landings.select("lat", "lon").distinct()
    near = (spots.withColumn("cy", F.explode(F.sequence(geo.cell(F.col("lat") - LANDING_DLAT, c), geo.cell(F.col("lat") + LANDING_DLAT, c))))
            .withColumn("cx", F.explode(F.sequence(geo.cell(F.col("lon") - LANDING_DLON, c), geo.cell(F.col("lon") + LANDING_DLON, c)))))
    named = _named_spots(places).withColumn("cy", geo.cell("plat", c)).withColumn("cx", geo.cell("plon", c))
    d = geo.catalogue_distance_m("lat", "lon", "plat", "plon")
    ok = (F.abs(F.col("plat") - F.col("lat")) <= LANDING_DLAT) & (F.abs(F.col("plon") - F.col("lon")) <= LANDING_DLON) & (d < LANDING_M)
    best = near.join(named, ["cy", "cx"]).filter(ok).groupBy("lat", "lon").agg(F.min(F.struct(d.alias("d"), "name")).alias("m"))
    return landings.select("id", "lat", "lon").join(best, ["lat", "lon"], "left").select("id", F.col("m.name").alias("name"))


def _named_spots(places: DataFrame) -> DataFrame:
    """Places (name, plat, plon); of those on one spot the first by name, which wins there."""
    return places.groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(F.min("name").alias("name"))


def nearest_top_place(tops: DataFrame, places: DataFrame) -> DataFrame:
    """The nearest named place in the 3 x 3 cells of 0.1 degrees around each climb top."""
    def whole(c):
        return (F.col(c) * 10).cast("bigint")

    spots = tops.select("lat", "lon").distinct()
    near = (spots.withColumn("cy", F.explode(F.sequence(whole("lat") - 1, whole("lat") + 1))).withColumn("cx", F.explode(F.sequence(whole("lon") - 1, whole("lon") + 1))))
    named = _named_spots(places).withColumn("cy", whole("plat")).withColumn("cx", whole("plon"))
    d = F.pow(F.col("plat") - F.col("lat"), F.lit(2)) + F.pow((F.col("plon") - F.col("lon")) * F.cos(F.radians("lat")), F.lit(2))
    best = near.join(named, ["cy", "cx"]).groupBy("lat", "lon").agg(F.min(F.struct(d.alias("d"), "name")).alias("m"))
    return tops.select("id", "lat", "lon").join(best, ["lat", "lon"], "left").select("id", F.col("m.name").alias("name"))


def nearest_item(queries: DataFrame, lines: DataFrame) -> DataFrame:
    """The line (item_id, piece, seq, lat, lon) nearest to each query (query_id, lat, lon, radius).

    Queries on one spot are answered once, and of equal segments the one of the smallest item, which
    wins wherever they tie."""
    targets = queries.select("query_id", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), "radius")
    shaped = ordered.neighbours(lines, ["item_id", "piece"], {"lat2": ("lat", 1), "lon2": ("lon", 1), "_before": ("lat", -1)})
    lone = F.col("lat2").isNull() & F.col("_before").isNull()
    ends = ["lat", "lon", F.coalesce("lat2", "lat").alias("lat2"), F.coalesce("lon2", "lon").alias("lon2"), lone.alias("_lone")]
    segs = shaped.filter(F.col("lat2").isNotNull() | lone).select("item_id", *ends).groupBy("lat", "lon", "lat2", "lon2", "_lone").agg(F.min("item_id").alias("item_id"))
    hits = _within(_met(segs, targets.select(*CIRCLE).distinct()))
    best = hits.groupBy(*CIRCLE).agg(F.min(F.struct(F.round("metres", 6).alias("metres"), "item_id")).alias("m"))
    return targets.join(best, CIRCLE).select("query_id", F.col("m.item_id").alias("item_id"), F.col("m.metres").alias("metres"))
