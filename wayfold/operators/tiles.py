"""Visited tiles: counts, history, largest square, largest cluster, neighbourhoods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import graph, ordered
from wayfold.session import cut

KEY = ["athlete_id"]

# Frames of the growing history and of its held end, and frames a tile is highlighted.
GROW_FRAMES, HOLD_FRAMES, HIGHLIGHT_FRAMES = 600, 90, 12


def visited(activity_tiles: DataFrame, on_map: DataFrame | None = None, columns=("tile_key",)) -> DataFrame:
    """Distinct facts (tiles or area codes) per athlete over the activities on the map."""
    rows = activity_tiles if on_map is None else activity_tiles.join(on_map.select("athlete_id", "activity_id"), ["athlete_id", "activity_id"], "left_semi")
    return rows.select("athlete_id", *columns).distinct()


def first_visits(ordered_tiles: DataFrame, activities: DataFrame) -> DataFrame:
    """Each tile once per athlete, numbered in order of first visit (undated activities first)."""
    dated = ordered_tiles.join(activities.select("athlete_id", "activity_id", "start_ts"), ["athlete_id", "activity_id"])
    far = F.lit(2 ** 31 - 1)
    visit = F.struct(F.coalesce(F.unix_micros("start_ts"), F.lit(-(2 ** 62))).alias("us"), "activity_id",
                     F.coalesce("first_seq", far).alias("seq"), F.coalesce("first_sub", far).alias("sub"))
    first = (dated.groupBy("athlete_id", "tile_key").agg(F.min(F.struct(visit.alias("v"), "start_ts")).alias("m"))
             .select("athlete_id", "tile_key", F.col("m.start_ts").alias("first_ts"), F.col("m.v.activity_id").alias("activity_id"), F.col("m.v").alias("v")))
    day = F.floor(F.col("v.us") / 86_400_000_000)
    return ordered.ordinals(first, KEY, [F.col("v"), F.col("tile_key")], day, "ord").drop("v")


def before(history: DataFrame, date) -> DataFrame:
    return history.filter(F.col("first_ts").isNull() | (F.col("first_ts") < date))


def history_frames(history: DataFrame) -> DataFrame:
    """The frame in which each tile appears and the last frame that highlights it."""
    totals = history.groupBy("athlete_id").agg(F.count(F.lit(1)).alias("total"))
    frame = F.floor((GROW_FRAMES * F.col("ord") + F.col("total") - 1) / F.col("total")) - 1
    return (history.join(totals, "athlete_id").withColumn("frame", frame)
            .withColumn("highlight_until", F.col("frame") + HIGHLIGHT_FRAMES).drop("total"))


def frame_counts(history: DataFrame) -> DataFrame:
    """Per athlete and frame: tiles shown, newly shown and highlighted; the end is held."""
    totals = history.groupBy("athlete_id").agg(F.count(F.lit(1)).alias("total"))

    def shown(frame: Column) -> Column:
        return F.when(frame < 0, F.lit(0)).when(frame >= GROW_FRAMES, F.col("total")).otherwise(F.floor(F.col("total") * (frame + 1) / GROW_FRAMES))

    f = F.col("frame")
    return (totals.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(GROW_FRAMES + HOLD_FRAMES - 1))))
            .select("athlete_id", "frame", shown(f).alias("shown"), (shown(f) - shown(f - 1)).alias("added"),
                    (shown(f) - shown(f - HIGHLIGHT_FRAMES - 1)).alias("highlighted")))


def _grow(corners: DataFrame, by: int, keys) -> DataFrame:
    """Bottom-right corners of full squares ``by`` tiles larger: four full squares overlap in one."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, by) for dy in (0, by)])
    moved = corners.select(*keys, "side", "x", "y", F.explode(offsets).alias("o"))
    return (moved.groupBy(*keys, "side", (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
            .agg(F.count(F.lit(1)).alias("n")).filter("n = 4").select(*keys, (F.col("side") + by).alias("side"), "x", "y"))


def max_square(tiles: DataFrame, keys=KEY) -> DataFrame:
    """Side and top-left tile of the largest full square; ties take the first bottom-right tile.

    Squares double while any athlete has one, then shrinking steps are tried: about
    2 log2(side) rounds for all athletes together, each one grouped count."""
    keys = list(keys)
    levels = [tiles.select(*keys, F.lit(1).alias("side"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()]
    step, current = 1, cut(levels[0])
    levels = [current]
    while True:
        grown = cut(_grow(current, step, keys))
        if grown.isEmpty():
            break
        levels.append(grown)
        current, step = grown, step * 2
    best = reduce(DataFrame.unionByName, levels)
    top = best.groupBy(*keys).agg(F.max("side").alias("side"))
    best = best.join(top, [*keys, "side"])
    step //= 2
    while step >= 1:
        best = cut(best)
        grown = _grow(best.filter(F.col("side") > step), step, keys)
        both = best.unionByName(grown)
        top = grown.groupBy(*keys).agg(F.max("side").alias("top"))
        best = both.join(top, keys, "left").filter(F.col("side") == F.coalesce("top", F.col("side"))).drop("top")
        step //= 2
    return (best.groupBy(*keys, "side").agg(F.min(F.struct("y", "x")).alias("c"))
            .select(*keys, "side", (F.col("c.x") - F.col("side") + 1).alias("x"), (F.col("c.y") - F.col("side") + 1).alias("y")))


def inner_tiles(tiles: DataFrame, keys=KEY) -> DataFrame:
    """Tiles whose four neighbours are visited too: they collect five marks."""
    marks = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    spread = tiles.select(*keys, "x", "y").distinct().select(*keys, "x", "y", F.explode(marks).alias("o"))
    return (spread.groupBy(*keys, (F.col("x") + F.col("o.dx")).alias("x"), (F.col("y") + F.col("o.dy")).alias("y"))
            .agg(F.count(F.lit(1)).alias("n")).filter("n = 5").drop("n"))


def max_cluster(tiles: DataFrame, keys=KEY) -> DataFrame:
    """Largest 4-connected group of inner tiles: size and mean tile position plus one half.

    Tiles collapse to horizontal runs (a row has at most 2^14 tiles), runs touching vertically are
    linked, and components are labelled on runs. Ties take the smallest tile key."""
    keys = list(keys)
    row = Window.partitionBy(*keys, "y").orderBy("x")
    inner = inner_tiles(tiles, keys).withColumn("_g", F.col("x") - F.row_number().over(row))
    starts = Window.partitionBy(*keys, "y", "_g")
    inner = cut(inner.select(*keys, "x", "y", geo.tile_key(F.min("x").over(starts), F.col("y")).alias("run")))
    runs = inner.groupBy(*keys, "run").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    above = inner.select(*keys, "x", (F.col("y") + 1).alias("y"), F.col("run").alias("src"))
    edges = inner.select(*keys, "x", "y", F.col("run").alias("dst")).join(above, [*keys, "x", "y"]).select(*keys, "src", "dst")
    labels = graph.components(edges, keys).withColumnRenamed("node", "run")
    groups = (runs.join(labels, [*keys, "run"], "left").groupBy(*keys, F.coalesce("label", "run").alias("label"))
              .agg(F.sum("n").alias("size"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy")))
    return (groups.groupBy(*keys).agg(F.max(F.struct("size", (-F.col("label")).alias("neg"), "sx", "sy")).alias("b"))
            .select(*keys, F.col("b.size").alias("cluster"), (F.col("b.sx") / F.col("b.size") + 0.5).alias("center_x"),
                    (F.col("b.sy") / F.col("b.size") + 0.5).alias("center_y")))


def square_stats(tiles: DataFrame, keys=KEY) -> DataFrame:
    """Tile count, largest square and largest cluster, one row per athlete."""
    keys = list(keys)
    counts = tiles.select(*keys, "x", "y").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("tiles"))
    square = max_square(tiles, keys).select(*keys, F.col("side").alias("square"), F.col("x").alias("square_x"), F.col("y").alias("square_y"))
    return counts.join(square, keys, "left").join(max_cluster(tiles, keys), keys, "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))


def _window(columns: int, rows: int) -> Column:
    xs = F.sequence(F.lit(0), F.lit(columns - 1))
    return F.flatten(F.transform(xs, lambda i: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def neighbourhood(locations: DataFrame, tiles: DataFrame, columns: int = 5, rows: int = 5) -> DataFrame:
    """Visited and total tiles of the window around each location (athlete_id, location_id, lat, lon)."""
    cells = (locations.select("athlete_id", "location_id", geo.tile_x("lon").alias("cx"), geo.tile_y("lat").alias("cy"), F.explode(_window(columns, rows)).alias("o"))
             .select("athlete_id", "location_id", (F.col("cx") - columns // 2 + F.col("o.i")).alias("x"), (F.col("cy") - rows // 2 + F.col("o.j")).alias("y")))
    seen = tiles.select("athlete_id", "x", "y").distinct().withColumn("seen", F.lit(1))
    return (cells.join(seen, ["athlete_id", "x", "y"], "left").groupBy("athlete_id", "location_id")
            .agg(F.count("seen").alias("visited"), F.count(F.lit(1)).alias("total")))


def nearest_unvisited(starts: DataFrame, tiles: DataFrame, k: int = 4, reach: int = 6) -> DataFrame:
    """The k nearest unvisited tiles of each start, itself left out; ``rank`` from 1.

    Starts that have fewer than k within ``reach`` look twice as far. They have visited nearly all
    tiles there, so what is looked at grows with the tiles visited. Runs a job a round."""
    keys = ["athlete_id", "location_id"]
    tiles = tiles.select("athlete_id", "x", "y").distinct()
    pending, found = starts.select(*keys, "lat", "lon"), []
    while True:
        near = cut(_unvisited_within(pending, tiles, k, reach))
        full = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k)
        found.append(near.join(full.select(*keys), keys, "left_semi"))
        pending = cut(pending.join(full, keys, "left_anti"))
        if k < 1 or pending.isEmpty():
            return reduce(DataFrame.unionByName, found)
        reach *= 2


def _unvisited_within(starts: DataFrame, tiles: DataFrame, k: int, reach: int) -> DataFrame:
    """The first k unvisited tiles of the disc around each start; a disc misses no nearer tile."""
    side = 2 * reach + 1
    cells = (starts.select("athlete_id", "location_id", geo.tile_x("lon").alias("cx"), geo.tile_y("lat").alias("cy"), F.explode(_window(side, side)).alias("o"))
             .select("athlete_id", "location_id", (F.col("o.i") - reach).alias("dx"), (F.col("o.j") - reach).alias("dy"), "cx", "cy")
             .filter(f"(dx <> 0 or dy <> 0) and dx * dx + dy * dy <= {reach * reach}")
             .select("athlete_id", "location_id", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"),
                     (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("d2")))
    fresh = cells.join(tiles.select("athlete_id", "x", "y"), ["athlete_id", "x", "y"], "left_anti")
    w = Window.partitionBy("athlete_id", "location_id").orderBy("d2", "x", "y")
    return fresh.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def densest_center(points: DataFrame, keys=KEY, zoom: int = 10) -> DataFrame:
    """Mean position of the zoom-10 tile holding most points; ties take the smallest tile."""
    keys, n = list(keys), float(1 << zoom)
    x = F.floor((F.col("lon") + 180) / 360 * n)
    y = geo._mercator_row(F.col("lat"), n)
    buckets = (points.filter(F.abs("lat") < 85).groupBy(*keys, geo.tile_key(x, y).alias("b"))
               .agg(F.count(F.lit(1)).alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")))
    return (buckets.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("b")).alias("neg"), "lat", "lon")).alias("m"))
            .select(*keys, F.col("m.n").alias("points"), F.col("m.lat").alias("lat"), F.col("m.lon").alias("lon")))


# Fixed value: margin of the focus region as a share of its size.
FOCUS_MARGIN = 0.06


def focus_region(tiles: DataFrame, country_index: DataFrame, aspect: float, keys=KEY) -> DataFrame:
    """Region around the tiles of the country holding the largest cluster, else around all tiles.

    Bounds are fractional tile positions (Web Mercator is linear in them), widened by a margin and
    stretched to ``aspect`` (width / height)."""
    from wayfold.operators import areas
    keys = list(keys)
    tiles = cut(tiles.select(*keys, "x", "y").distinct())
    homes = max_cluster(tiles, keys).select(*keys, geo.tile_lat("center_y").alias("lat"), geo.tile_lon("center_x").alias("lon"))
    home = areas.located(homes, country_index, areas.COUNTRY_CELL).select(*keys, F.substring_index("code", ":", 1).alias("country"))
    centers = tiles.select(*keys, "x", "y", geo.tile_lat(F.col("y") + 0.5).alias("lat"), geo.tile_lon(F.col("x") + 0.5).alias("lon"))
    inside = (areas.located(centers, country_index, areas.COUNTRY_CELL).withColumn("country", F.substring_index("code", ":", 1))
              .join(home, [*keys, "country"], "left_semi").select(*keys, "x", "y", "country"))

    def bounds(rows):
        return rows.agg(F.min("x").alias("w"), (F.max("x") + 1).alias("e"), F.min("y").alias("n"), (F.max("y") + 1).alias("s"))

    local = bounds(inside.groupBy(*keys, "country"))
    every = bounds(tiles.groupBy(*keys))
    pick = every.select(*keys, F.struct("w", "e", "n", "s").alias("all")).join(local.select(*keys, "country", F.struct("w", "e", "n", "s").alias("home")), keys, "left")
    shown = pick.withColumn("b", F.coalesce("home", "all"))
    width, height = (F.col("b.e") - F.col("b.w")) * (1 + 2 * FOCUS_MARGIN), (F.col("b.s") - F.col("b.n")) * (1 + 2 * FOCUS_MARGIN)
    half_w, half_h = F.greatest(width, height * aspect) / 2, F.greatest(height, width / aspect) / 2
    cx, cy = (F.col("b.e") + F.col("b.w")) / 2, (F.col("b.s") + F.col("b.n")) / 2
    return shown.select(*keys, "country", geo.tile_lat(cy - half_h).alias("north"), geo.tile_lat(cy + half_h).alias("south"), geo.tile_lon(cx - half_w).alias("west"), geo.tile_lon(cx + half_w).alias("east"))
