"""Candidate routes: what they would add, their targets, and the data cells they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.session import cut
from wayfold.operators import areas, nearby, tracks

ROUTE = ["athlete_id", "route_id"]

# Metres between corridor samples, degrees around a track's box, outline margin, and
# the ring around a place.
CORRIDOR_STEP_M, BOX_DEGREES, OUTLINE_KM = 2_000.0, 0.05, 70.0
RING_M, RING_SHARE = 120.0, 0.6
AREA_GRIDS, ENOUGH = (12, 24, 48), 12


def new_things(route_points: DataFrame, visited: DataFrame, area_index: DataFrame | None = None, climb_checkpoints: DataFrame | None = None,
               places: DataFrame | None = None, own_points: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(passed, new): rows (athlete_id, route_id, kind, id) of what each route passes, and what of
    it the athlete has not visited: not in ``visited`` (athlete_id, kind, id), and no climb or place that
    their own tracks ``own_points`` pass.

    Many climbs may have equal checkpoints and many places stand on one spot, so their rows are made by a
    last join and not exchanged again: those without one the athlete knows need no look at what is known."""
    passed = _passed(route_points, area_index)
    known = visited.select("athlete_id", "kind", "id")
    new = passed.join(known, ["athlete_id", "kind", "id"], "left_anti")
    found = [(passed, new)]
    if climb_checkpoints is not None:
        found.append(_climbs_found(route_points, known, climb_checkpoints, own_points))
    if places is not None:
        found.append(_places_found(route_points, known, places, own_points))
    return tuple(reduce(DataFrame.unionByName, [pair[i].select(*ROUTE, "kind", "id") for pair in found]) for i in (0, 1))


def _climbs_found(route_points: DataFrame, known: DataFrame, checkpoints: DataFrame, own_points: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    same = cut(nearby.same_checkpoints(checkpoints, "climb_id"))
    twins = same.select(F.lit("climb").alias("kind"), F.col("climb_id").cast("string").alias("id"), F.col("same").alias("climb_id"))

    def met_by(points, keys):
        return nearby.first_climb_matches(points, checkpoints, same, keys)

    def climbs_of(firsts):
        return firsts.join(twins, "climb_id").select(*ROUTE, "kind", "id")

    met = cut(met_by(route_points, ROUTE))
    fresh = met if own_points is None else met.join(met_by(own_points, tracks.TRACK).select("athlete_id", "climb_id").distinct(), ["athlete_id", "climb_id"], "left_anti")
    touched = cut(known.join(twins, ["kind", "id"]).select("athlete_id", "climb_id").distinct())
    rest = climbs_of(fresh.join(touched, ["athlete_id", "climb_id"], "left_semi")).join(known, ["athlete_id", "kind", "id"], "left_anti")
    return climbs_of(met), climbs_of(fresh.join(touched, ["athlete_id", "climb_id"], "left_anti")).unionByName(rest.select(*ROUTE, "kind", "id"))


def _places_found(route_points: DataFrame, known: DataFrame, places: DataFrame, own_points: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    marks = cut(_marks(places))
    met = cut(_met_circles(route_points, marks))
    single, several = marks.filter("spots = 1"), marks.filter("spots > 1")
    owned = ["athlete_id", *nearby.CIRCLE]

    def places_of(circles, items, keys=ROUTE):
        return circles.join(items, nearby.CIRCLE).select(*keys, "kind", "id")

    twice = places_of(met, several).distinct()
    ahead, open_twice = met, twice
    if own_points is not None:
        seen = cut(_met_circles(own_points, marks, tracks.TRACK).select(*owned).distinct())
        ahead = met.join(seen, owned, "left_anti")
        open_twice = twice.join(places_of(seen, several, ["athlete_id"]).distinct(), ["athlete_id", "kind", "id"], "left_anti").select(*ROUTE, "kind", "id")
    touched = cut(known.join(marks, ["kind", "id"]).select(*owned).distinct())
    fresh = places_of(ahead.join(touched, owned, "left_anti"), single)
    rest = places_of(ahead.join(touched, owned, "left_semi"), single).unionByName(open_twice).join(known, ["athlete_id", "kind", "id"], "left_anti")
    return places_of(met, single).unionByName(twice), fresh.unionByName(rest.select(*ROUTE, "kind", "id"))


def passed_targets(targets: DataFrame, route_points: DataFrame, area_index: DataFrame | None = None, climb_checkpoints: DataFrame | None = None,
                   places: DataFrame | None = None) -> DataFrame:
    """Those of the requested targets (athlete_id, route_id, kind, id) that their route passes.

    Only routes with a target of a kind are matched with it, and only with the targets' own places."""
    targets = cut(targets.select(*ROUTE, "kind", "id").distinct())

    def asking(*kinds):
        return route_points.join(targets.filter(F.col("kind").isin(*kinds)).select(*ROUTE).distinct(), ROUTE, "left_semi")

    found = _passed(asking("tile"))
    if area_index is not None:
        found = found.unionByName(_areas_passed(asking("area"), area_index))
    if climb_checkpoints is not None:
        found = found.unionByName(_climbs_passed(asking("climb"), climb_checkpoints))
    passed = found.join(targets, [*ROUTE, "kind", "id"], "left_semi")
    if places is None:
        return passed
    marks = cut(_marks(places).join(targets.select("kind", "id").distinct(), ["kind", "id"], "left_semi"))
    met = _met_circles(asking("place"), marks)
    return passed.unionByName(targets.join(marks, ["kind", "id"]).join(met, [*ROUTE, *nearby.CIRCLE], "left_semi").select(*ROUTE, "kind", "id").distinct())


def _passed(route_points: DataFrame, area_index: DataFrame | None = None) -> DataFrame:
    passed = _dense(route_points).select(*ROUTE, F.lit("tile").alias("kind"), geo.tile_key_at("lat", "lon").cast("string").alias("id")).filter("id is not null")
    if area_index is not None:
        passed = passed.unionByName(_areas_passed(route_points, area_index))
    return passed.distinct()


def _dense(route_points: DataFrame) -> DataFrame:
    return tracks.densify(route_points, tracks.COVERAGE_SPACING, tracks.COVERAGE_GAP, ROUTE).select(*ROUTE, "lat", "lon")


def _areas_passed(route_points: DataFrame, area_index: DataFrame) -> DataFrame:
    return areas.located(_dense(route_points), area_index).select(*ROUTE, F.lit("area").alias("kind"), F.col("code").alias("id"))


def _climbs_passed(route_points: DataFrame, climb_checkpoints: DataFrame) -> DataFrame:
    return nearby.climb_matches(route_points, climb_checkpoints, ROUTE).select(*ROUTE, F.lit("climb").alias("kind"), F.col("climb_id").cast("string").alias("id"))


def _marks(places: DataFrame) -> DataFrame:
    """(kind, id, tlat, tlon, radius, spots): places once per spot; an id has ``spots`` of them in all."""
    own = places.select(F.lit("place").alias("kind"), F.col("item_id").cast("string").alias("id"), F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), "radius").distinct()
    return own.join(own.groupBy("id").agg(F.count(F.lit(1)).alias("spots")), "id").select("kind", "id", *nearby.CIRCLE, "spots")


def _met_circles(points: DataFrame, marks: DataFrame, keys=ROUTE) -> DataFrame:
    return nearby.near_segments(points, marks.select(*nearby.CIRCLE).distinct(), keys).select(*keys, *nearby.CIRCLE).distinct()


def missed_targets(targets: DataFrame, passed: DataFrame) -> DataFrame:
    """Requested targets (athlete_id, route_id, kind, id) the route does not pass."""
    return targets.join(passed, [*ROUTE, "kind", "id"], "left_anti")


def _grid(n: int):
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.struct(((i + 0.5) / n).alias("u"), ((j + 0.5) / n).alias("v")))))


def tile_candidates(targets: DataFrame, key: str = "target_id") -> DataFrame:
    """A 6 x 6 grid inside each tile (x, y)."""
    north, west = geo.tile_lat("y"), geo.tile_lon("x")
    south, east = geo.tile_lat(F.col("y") + 1), geo.tile_lon(F.col("x") + 1)
    return (targets.withColumn("g", F.explode(_grid(6)))
            .select(key, (north + (south - north) * F.col("g.u")).alias("lat"), (west + (east - west) * F.col("g.v")).alias("lon")))


def place_candidates(targets: DataFrame, key: str = "target_id") -> DataFrame:
    """Each place and a ring of eight points around it within its radius."""
    dlat = F.least(F.lit(RING_M), F.col("radius") * RING_SHARE) / geo.BOX_METRES_PER_DEGREE
    dlon = dlat / F.greatest(F.cos(F.radians("lat")), F.lit(geo.MIN_COSINE))
    turns = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(0.0 if k < 0 else 1.0).alias("r")) for k in range(-1, 8)])
    angle = F.col("t.k") * F.lit(3.141592653589793 / 4)
    return (targets.withColumn("t", F.explode(turns))
            .select(key, (F.col("lat") + dlat * F.sin(angle) * F.col("t.r")).alias("lat"), (F.col("lon") + dlon * F.cos(angle) * F.col("t.r")).alias("lon")))


def area_candidates(rings: DataFrame) -> DataFrame:
    """Grid points inside each area: 12 x 12, else 24 x 24, else 48 x 48 until 12 lie inside. An area so
    thin that no grid point meets it gets one point of its surface (level 3)."""
    boxes = rings.groupBy("code").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    size = areas.AREA_CELL
    # One cell index per area: ordinals only decide between areas, so candidates keep their code.
    index = areas.cell_index(rings, size)
    grids = F.array(*[F.struct(F.lit(level).alias("level"), _grid(n).alias("g")) for level, n in enumerate(AREA_GRIDS)])
    points = (boxes.withColumn("k", F.explode(grids)).withColumn("g", F.explode("k.g"))
              .select(F.col("code").alias("want"), F.col("k.level").alias("level"), (F.col("s") + (F.col("n") - F.col("s")) * F.col("g.u")).alias("lat"),
                      (F.col("w") + (F.col("e") - F.col("w")) * F.col("g.v")).alias("lon")))
    inside = cut(areas.located(points, index, size).filter("code = want").drop("want"))
    counts = inside.groupBy("code", "level").agg(F.count(F.lit(1)).alias("n"))
    chosen = counts.groupBy("code").agg(F.min(F.when((F.col("n") >= ENOUGH) | (F.col("level") == len(AREA_GRIDS) - 1), F.col("level"))).alias("level"))
    found = inside.join(chosen, ["code", "level"]).select("code", "level", "lat", "lon")
    thin = rings.join(found.select("code").distinct(), "code", "left_anti")
    return found.unionByName(surface_points(thin).select("code", F.lit(len(AREA_GRIDS)).alias("level"), "lat", "lon"))


def surface_points(rings: DataFrame) -> DataFrame:
    """(code, lat, lon): a point inside each area, half-way along the westernmost chord at the middle
    latitude of its first polygon; of an area without height, its first point."""
    poly = ["code", "ordinal", "poly"]
    middle = rings.groupBy(*poly).agg(((F.min("lat") + F.max("lat")) / 2).alias("y"))
    met = areas.ring_edges(rings).join(middle, poly).filter((F.col("alat") > F.col("y")) != (F.col("blat") > F.col("y")))
    at = (F.col("blon") - F.col("alon")) * (F.col("y") - F.col("alat")) / (F.col("blat") - F.col("alat")) + F.col("alon")
    chord = met.groupBy(*poly, "y").agg(F.array_sort(F.collect_list(at)).alias("x")).filter(F.size("x") >= 2).select(*poly, F.struct(F.col("y").alias("lat"), ((F.col("x")[0] + F.col("x")[1]) / 2).alias("lon")).alias("p"))
    first = rings.groupBy("code").agg(F.min(F.struct("poly", "ring", "seq", F.struct("lat", "lon").alias("p"))).alias("f"))
    best = chord.groupBy("code").agg(F.min_by("p", "poly").alias("p"))
    return first.join(best, "code", "left").select("code", F.coalesce("p.lat", "f.p.lat").alias("lat"), F.coalesce("p.lon", "f.p.lon").alias("lon"))


def corridor_cells(stops: DataFrame, cells: DataFrame, margin_m: float, candidates: DataFrame | None = None) -> DataFrame:
    """Data cells (cell_id, lat, lon, size, bytes) within ``margin_m`` of each path (path_id, seq, lat, lon).

    Paths are sampled every 2 km; cells enter every 1 degree bucket their widened box overlaps. Cells of
    one box are met once; the last join adds their ids (one row each), and its rows aren't exchanged again."""
    walked = tracks.interpolate(stops, F.greatest(F.lit(1), F.floor(F.col("metres") / CORRIDOR_STEP_M).cast("int")), ["path_id"]).select("path_id", "lat", "lon")
    if candidates is not None:
        walked = walked.unionByName(candidates.select("path_id", "lat", "lon"))
    samples = walked.withColumn("by", F.floor("lat")).withColumn("bx", F.floor("lon"))
    dlat = F.lit(margin_m / geo.BOX_METRES_PER_DEGREE)
    dlon = margin_m / (geo.BOX_METRES_PER_DEGREE * F.greatest(F.cos(F.radians(F.col("lat") + F.col("size") / 2)), F.lit(geo.MIN_COSINE)))
    wide = cells.select("cell_id", "bytes", (F.col("lat") - dlat).alias("s"), (F.col("lat") + F.col("size") + dlat).alias("n"),
                        (F.col("lon") - dlon).alias("w"), (F.col("lon") + F.col("size") + dlon).alias("e"))
    box = ["s", "n", "w", "e"]
    spread = wide.select(*box).distinct().withColumn("by", F.explode(F.sequence(F.floor("s"), F.floor("n")))).withColumn("bx", F.explode(F.sequence(F.floor("w"), F.floor("e"))))
    hits = samples.join(spread, ["by", "bx"]).filter("lat > s and lat < n and lon > w and lon < e").select("path_id", *box).distinct()
    return hits.join(wide.distinct(), box).select("path_id", "cell_id", "bytes")


def corridor_bytes(path_cells: DataFrame) -> DataFrame:
    return path_cells.groupBy("path_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("bytes").alias("bytes"))


def cells_near_outline(cells: DataFrame, rings: DataFrame, margin_km: float = OUTLINE_KM) -> DataFrame:
    """Cells (cell_id, lat, lon, size) near an outline vertex or with their centre inside."""
    dlat = F.lit(margin_km / 111.0)
    dlon = margin_km / (111.0 * F.greatest(F.cos(F.radians(F.col("lat") + F.col("size") / 2)), F.lit(geo.MIN_COSINE)))
    wide = cells.select("cell_id", (F.col("lat") - dlat).alias("s"), (F.col("lat") + F.col("size") + dlat).alias("n"), (F.col("lon") - dlon).alias("w"), (F.col("lon") + F.col("size") + dlon).alias("e"))
    spread = wide.withColumn("by", F.explode(F.sequence(F.floor("s"), F.floor("n")))).withColumn("bx", F.explode(F.sequence(F.floor("w"), F.floor("e"))))
    outer = rings.filter("ring = 0")
    vertices = outer.select(F.col("lat").alias("y"), F.col("lon").alias("x"), F.floor("lat").alias("by"), F.floor("lon").alias("bx")).distinct()
    near = spread.join(vertices, ["by", "bx"]).filter("y >= s and y <= n and x >= w and x <= e").select("cell_id")
    centers = cells.select("cell_id", (F.col("lat") + F.col("size") / 2).alias("lat"), (F.col("lon") + F.col("size") / 2).alias("lon"))
    inside = areas.located(centers, areas.cell_index(outer, areas.COUNTRY_CELL, True), areas.COUNTRY_CELL).select("cell_id")
    return near.unionByName(inside).distinct()


def cells_in_box(boxes: DataFrame, cells: DataFrame, key: str = "activity_id") -> DataFrame:
    """1 degree cells (cell_lat, cell_lon, ...) overlapping each box widened by 0.05 degrees."""
    m = BOX_DEGREES

    def span(low, high):
        return F.explode(F.sequence(F.floor(F.col(low) - m), F.ceil(F.col(high) + m) - 1))

    wide = boxes.withColumn("cell_lat", span("min_lat", "max_lat")).withColumn("cell_lon", span("min_lon", "max_lon"))
    return wide.select(key, "cell_lat", "cell_lon").join(cells, ["cell_lat", "cell_lon"])


def pairwise_cost(stops: DataFrame) -> DataFrame:
    """Distance matrix (request_id, i, j, metres) of the stops of each request (at most 60 stops)."""
    a = stops.select("request_id", F.col("seq").alias("i"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    b = stops.select("request_id", F.col("seq").alias("j"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    return a.join(b, "request_id").select("request_id", "i", "j", geo.distance_m("alat", "alon", "blat", "blon").alias("metres"))


def ferries(lines: DataFrame, least: float = 30.0, most: float = 2_000.0) -> DataFrame:
    """Ferry lines (line_id, seq, lat, lon) between 30 m and 2 km that are no round trips."""
    metres = F.sum(geo.catalogue_distance_m("lat", "lon", "lat2", "lon2"))
    sized = tracks.with_next(lines, ["line_id"]).groupBy("line_id").agg(metres.alias("metres"), F.min_by(F.struct("lat", "lon"), "seq").alias("a"), F.max_by(F.struct("lat", "lon"), "seq").alias("b"))
    apart = geo.catalogue_distance_m(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return sized.filter(F.col("metres").between(least, most) & (apart >= F.col("metres") / 3)).select("line_id", "metres", "a", "b")


def cross_border_distinct(routes: DataFrame) -> DataFrame:
    """Routes (route_id, extract, metres, a, b) of several extracts once.

    The same rounded pair of ends keeps its first extract, the same id its longest version."""
    def end(c):
        return F.struct(F.round(F.col(f"{c}.lat"), 3).alias("y"), F.round(F.col(f"{c}.lon"), 3).alias("x"))

    keyed = routes.withColumn("ends", F.array_sort(F.array(end("a"), end("b"))))
    first = keyed.groupBy("ends").agg(F.min(F.struct("extract", "route_id")).alias("m")).select("ends", F.col("m.extract").alias("extract"), F.col("m.route_id").alias("route_id"))
    kept = keyed.join(first, ["ends", "extract", "route_id"], "left_semi")
    longest = kept.groupBy("route_id").agg(F.min(F.struct((-F.col("metres")).alias("m"), "extract")).alias("k")).select("route_id", F.col("k.extract").alias("extract"))
    return kept.join(longest, ["route_id", "extract"], "left_semi").drop("ends")


def weighted_technical(ways: DataFrame) -> DataFrame:
    """Length-weighted trail scale per route, null unless a third of its length is tagged."""
    tagged = F.sum(F.when(F.col("scale").isNotNull(), F.col("metres")))
    weighted = F.sum(F.col("metres") * F.col("scale"))
    return ways.groupBy("route_id").agg(F.when(tagged >= F.sum("metres") / 3, F.round(weighted / tagged, 1)).alias("technical"))


def catalogue_stats(routes: DataFrame, by: str) -> DataFrame:
    """Count and kilometres per grade or category, and in all (null)."""
    return routes.rollup(by).agg(F.count(F.lit(1)).alias("routes"), (F.sum("metres") / 1000).alias("km"))
