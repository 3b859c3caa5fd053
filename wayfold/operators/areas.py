"""Areas with polygons: a cell index for point location, counts per region, dissolving, slivers.

Ring points are rows (code, name, ordinal, poly, ring, seq, lat, lon); ring 0 is the outer boundary
and ``ordinal`` the list order that decides between overlapping areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import tracks
from wayfold.session import cut

AREA_CELL, COUNTRY_CELL = 0.05, 1.0
#: Edges a cell of the index keeps before it is split, and levels it is split down to.
CELL_EDGES, DEEPEST = 256, 14
# Least side in metres of the parts kept of areas and of country outlines.
AREA_SLIVER_M, COUNTRY_SLIVER_M = 50.0, 1_500.0

RING = ["code", "ordinal", "poly", "ring"]


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edges from each point to the next, closing every ring; ``seq`` numbers them."""
    opened = tracks.with_next(rings, RING)
    firsts = rings.groupBy(*RING).agg(F.min_by(F.struct("lat", "lon"), "seq").alias("f"))
    closed = opened.join(firsts, RING)
    return closed.select(*RING, "seq", F.coalesce("lat2", "f.lat").alias("alat"), F.coalesce("lon2", "f.lon").alias("alon"),
                         F.col("lat").alias("blat"), F.col("lon").alias("blon"))


def crosses(lat, lon, edge) -> Column:
    """Whether a ray east from the point crosses the edge (even-odd rule, half-open in latitude)."""
    a_lat, a_lon, b_lat, b_lon = edge["alat"], edge["alon"], edge["blat"], edge["blon"]
    span = F.when((a_lat > lat) != (b_lat > lat), (b_lon - a_lon) * (lat - a_lat) / (b_lat - a_lat) + a_lon)
    return F.coalesce(lon < span, F.lit(False))


def turns(lat, lon, south, east, edge) -> Column:
    """Whether an edge changes the parity between a cell's south-east corner and a point of the cell:
    on the way north along the east side to the point's latitude, or west from there to the point.

    Rounding of borders is as in ``crosses``: a ray on the east side counts edges strictly east."""
    a_lat, a_lon, b_lat, b_lon = edge["alat"], edge["alon"], edge["blat"], edge["blon"]
    at = (b_lat - a_lat) * (east - a_lon) / (b_lon - a_lon) + a_lat
    rising = (b_lat - a_lat) * (b_lon - a_lon) > 0
    north = ((a_lon > east) != (b_lon > east)) & F.when(rising, (at >= south) & (at < lat)).otherwise((at > south) & (at <= lat))
    west = crosses(lat, lon, edge) & ~crosses(lat, east, edge)
    return F.coalesce(north, F.lit(False)) != west


EDGE = ["alat", "alon", "blat", "blon"]


def _cells_of_edges(edges: DataFrame, size: float) -> DataFrame:
    """Edges with every cell they touch; long ones are walked in steps of one cell."""
    steps = F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("blat") - F.col("alat")), F.abs(F.col("blon") - F.col("alon"))) / size).cast("int"))
    walked = edges.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))

    def ends(a, b):
        step = (F.col(b) - F.col(a)) / F.col("_n")
        return F.col(a) + step * F.col("_i"), F.col(a) + step * (F.col("_i") + 1)

    eps = size * 1e-9
    (ya, yb), (xa, xb) = ends("alat", "blat"), ends("alon", "blon")
    return (walked.withColumn("cy", F.explode(F.sequence(geo.cell(F.least(ya, yb) - eps, size), geo.cell(F.greatest(ya, yb) + eps, size))))
            .withColumn("cx", F.explode(F.sequence(geo.cell(F.least(xa, xb) - eps, size), geo.cell(F.greatest(xa, xb) + eps, size))))
            .select(*RING, "seq", *EDGE, "cx", "cy").distinct())


def _corner_parity(rings: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """(ring, cx, cy, odd): whether a ray east from the south-east corner of each cell of a ring's box
    crosses the ring oddly often. Each edge counts once on every grid line it crosses; the counts are
    summed from the east along the line."""
    boxes = rings.groupBy(*RING).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    cells = (boxes.withColumn("cy", F.explode(F.sequence(geo.cell("s", size), geo.cell("n", size))))
             .withColumn("cx", F.explode(F.sequence(geo.cell("w", size), geo.cell("e", size)))).select(*RING, "cx", "cy", F.lit(0).alias("hits")))
    lines = edges.withColumn("cy", F.explode(F.sequence(geo.cell(F.least("alat", "blat"), size), geo.cell(F.greatest("alat", "blat"), size) + 1)))
    y = F.col("cy") * size
    met = lines.filter((F.col("alat") > y) != (F.col("blat") > y)).withColumn("at", (F.col("blon") - F.col("alon")) * (y - F.col("alat")) / (F.col("blat") - F.col("alat")) + F.col("alon"))
    guess = F.ceil(F.col("at") / size).cast("bigint") - 2  # the last cell whose east side lies west of the crossing
    last = F.when((guess + 2) * size < F.col("at"), guess + 1).when((guess + 1) * size >= F.col("at"), guess - 1).otherwise(guess)
    hits = met.select(*RING, last.alias("cx"), "cy").groupBy(*RING, "cx", "cy").agg(F.count("*").cast("int").alias("hits"))
    from pyspark.sql import Window
    row = Window.partitionBy(*RING, "cy").orderBy(F.desc("cx")).rangeBetween(Window.unboundedPreceding, 0)
    both = cells.unionByName(hits).groupBy(*RING, "cx", "cy").agg(F.sum("hits").alias("hits"), F.bool_or(F.col("hits") == 0).alias("own"))
    return both.withColumn("odd", F.sum("hits").over(row) % 2 == 1).filter("own").select(*RING, "cx", "cy", "odd")


def cell_index(rings: DataFrame, size: float = AREA_CELL, outer_only: bool = False, limit: int = CELL_EDGES) -> DataFrame:
    """One row per quadtree cell (level, cx, cy) with the areas that can contain a point of it, in list
    order. Cells of level 0 are ``size`` degrees wide, those below half as wide each.

    A cell keeps the edges that touch it and, per ring, the parity of its south-east corner: a point's
    parity differs from the corner's by the edges between them, which all touch the cell. Cells with
    more than ``limit`` edges are split in four, down to ``DEEPEST`` levels. Cells no edge touches
    carry no edges, only whether they lie inside."""
    if outer_only:
        rings = rings.filter("ring = 0")
    edges = cut(ring_edges(rings))
    lies = cut(_cells_of_edges(edges, size).withColumn("level", F.lit(0)))
    odd = cut(_corner_parity(rings, edges, size).withColumn("level", F.lit(0)))
    cell, leaves = ["level", "cx", "cy"], []
    for level in range(DEEPEST + 1):
        wide = lies.groupBy(*cell).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(*cell)
        wide = cut(wide) if level < DEEPEST else wide.limit(0)
        if level == DEEPEST or wide.isEmpty():
            leaves.append((odd, lies))
            break
        leaves.append((odd.join(wide, cell, "left_anti"), lies.join(wide, cell, "left_anti")))
        half = size / 2 ** (level + 1)
        quarters = F.explode(F.array(*[F.struct((F.col("cx") * 2 + x).alias("x"), (F.col("cy") * 2 + y).alias("y")) for x in (0, 1) for y in (0, 1)]))
        south, east = F.col("cy") * (2 * half), (F.col("cx") + 1) * (2 * half)
        child = [F.lit(level + 1).alias("level"), F.col("q.x").alias("cx"), F.col("q.y").alias("cy")]
        split = lies.join(wide, cell, "left_semi").withColumn("q", quarters)
        change = turns(F.col("q.y") * half, (F.col("q.x") + 1) * half, south, east, {c: F.col(c) for c in EDGE})
        flips = split.groupBy(*RING, "q").agg((F.count_if(change) % 2 == 1).alias("flip"))
        below = odd.join(wide, cell, "left_semi").withColumn("q", quarters).join(flips, [*RING, "q"], "left")
        odd = cut(below.select(*RING, (F.col("odd") != F.coalesce("flip", F.lit(False))).alias("odd"), *child))
        eps = half * 1e-9
        w, e, s, n = F.col("q.x") * half - eps, (F.col("q.x") + 1) * half + eps, F.col("q.y") * half - eps, (F.col("q.y") + 1) * half + eps
        boxed = (F.least("alon", "blon") <= e) & (F.greatest("alon", "blon") >= w) & (F.least("alat", "blat") <= n) & (F.greatest("alat", "blat") >= s)

        def side(x, y):  # on which side of the edge a corner lies
            return (F.col("blon") - F.col("alon")) * (y - F.col("alat")) - (F.col("blat") - F.col("alat")) * (x - F.col("alon"))

        corners = [side(x, y) for x in (w, e) for y in (s, n)]
        lies = cut(split.filter(boxed & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)).select(*RING, "seq", *EDGE, *child))
    table = None
    for parity, touching in leaves:
        kept = touching.groupBy(*RING, *cell).agg(F.collect_list(F.struct(*EDGE)).alias("edges"))
        part = parity.join(kept, [*RING, *cell], "left").filter(F.col("odd") | F.col("edges").isNotNull())
        table = part if table is None else table.unionByName(part)
    whole = (F.size("rings") == 1) & F.col("rings")[0]["edges"].isNull() & (F.col("rings")[0]["ring"] == 0)
    polys = (table.groupBy("code", "ordinal", "poly", *cell).agg(F.collect_list(F.struct("ring", "odd", "edges")).alias("rings"))
             .filter(F.exists("rings", lambda r: r["ring"] == 0) & ~F.exists("rings", lambda r: (r["ring"] > 0) & r["odd"] & r["edges"].isNull())))
    eps = 1e-9  # more than the rounding of a crossing
    boxes = edges.filter("ring = 0").groupBy("code", "ordinal", "poly").agg(F.struct((F.min("blat") - eps).alias("s"), (F.max("blat") + eps).alias("n"), (F.min("blon") - eps).alias("w"), (F.max("blon") + eps).alias("e")).alias("box"))
    area = F.struct("ordinal", "code", "poly", whole.alias("full"), F.when(~whole, F.col("rings")).alias("rings"), F.when(~whole, F.col("box")).alias("box"))
    return cut(polys.join(boxes, ["code", "ordinal", "poly"]).groupBy(*cell).agg(F.array_sort(F.collect_list(area)).alias("areas")))


def located(points: DataFrame, index: DataFrame, size: float = AREA_CELL) -> DataFrame:
    """Points inside an area with its ``code``; the first area in list order wins.

    The test of a cell's edges is the dear part: it stands in an ``explode``, which runs it once a row (a
    filter on its result would be pushed below and run it again), and a cell's corner comes with the cell.
    Only areas whose box holds the point have their edges tested."""
    lat, lon, south, east = (F.col(c) for c in ("lat", "lon", "_south", "_east"))

    def odd(ring):
        changes = F.size(F.filter(ring["edges"], lambda e: turns(lat, lon, south, east, e)))
        return F.when(ring["edges"].isNull(), ring["odd"]).otherwise(ring["odd"] != (changes % 2 == 1))

    def holds(area):
        box = area["box"]
        near = (lat >= box["s"]) & (lat <= box["n"]) & (lon >= box["w"]) & (lon <= box["e"])
        return area["full"] | (near & F.exists(area["rings"], lambda r: (r["ring"] == 0) & odd(r)) & ~F.exists(area["rings"], lambda r: (r["ring"] > 0) & odd(r)))

    def width(level):
        return F.lit(size) / F.pow(F.lit(2.0), F.col(level))

    first = F.col("_areas")[0]
    code = F.when(first["full"], F.array(first["code"])).otherwise(F.transform(F.slice(F.filter("_areas", holds), 1, 1), lambda area: area["code"]))
    cells = index.select(F.col("level").alias("_level"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("areas").alias("_areas"),
                         (F.col("cy") * width("level")).alias("_south"), ((F.col("cx") + 1) * width("level")).alias("_east"))
    wide = F.pow(F.lit(2.0), F.col("_level"))
    depths = (cells.filter("_level > 0").select(F.floor(F.col("_cx") / wide).alias("_cx"), F.floor(F.col("_cy") / wide).alias("_cy"), "_level")
              .groupBy("_cx", "_cy").agg(F.collect_set("_level").alias("_levels")))
    keyed = points.withColumn("_cx", geo.cell("lon", size)).withColumn("_cy", geo.cell("lat", size))
    # Where a cell was split, a point looks on each level there; only one has a cell around it.
    deep = keyed.join(depths, ["_cx", "_cy"], "left").withColumn("_level", F.explode(F.concat(F.array(F.lit(0)), F.coalesce("_levels", F.array().cast("array<int>"))))).drop("_levels", "_cx", "_cy")
    placed = deep.withColumn("_cx", F.floor(lon / width("_level")).cast("bigint")).withColumn("_cy", F.floor(lat / width("_level")).cast("bigint"))
    return placed.join(cells, ["_level", "_cx", "_cy"]).withColumn("code", F.explode(code)).drop("_level", "_cx", "_cy", "_areas", "_south", "_east")


def track_areas(points: DataFrame, index: DataFrame, size: float = AREA_CELL, keys=tracks.TRACK) -> DataFrame:
    """Distinct area codes touched by each densified track."""
    dense = tracks.densify(points, tracks.TILE_SPACING, tracks.TILE_GAP, keys).select(*keys, "lat", "lon")
    return located(dense, index, size).select(*keys, "code").distinct()


def track_countries(points: DataFrame, country_index: DataFrame, keys=tracks.TRACK) -> DataFrame:
    """Countries of all points of each track."""
    found = located(points.select(*keys, "lat", "lon"), country_index, COUNTRY_CELL)
    return found.select(*keys, F.substring_index("code", ":", 1).alias("country")).distinct()


def region_counts(visited: DataFrame, areas: DataFrame) -> DataFrame:
    """Visited and total areas per athlete and country, with countries not visited at all."""
    visited = cut(visited.select("athlete_id", "code").distinct())
    country = F.substring_index("code", ":", 1).alias("country")
    totals = areas.select("code").distinct().groupBy(country).agg(F.count(F.lit(1)).alias("total"))
    every = totals.agg(F.collect_list(F.struct("country", "total")).alias("c")).scalar()  # one entry per country of the world
    seen = visited.groupBy("athlete_id", country).agg(F.count(F.lit(1)).alias("seen"))
    frame = visited.select("athlete_id").distinct().withColumn("c", F.explode(every)).select("athlete_id", "c.country", "c.total")
    out = frame.join(seen, ["athlete_id", "country"], "left").withColumn("visited", F.coalesce("seen", F.lit(0)))
    return out.select("athlete_id", "country", "visited", "total", (F.col("visited") / F.greatest("total", F.lit(1)) * 100).alias("pct"))


def dissolve(features: DataFrame) -> DataFrame:
    """Features (feature_id, code, name, poly, ring, seq, ...) of one code become one area.

    Polygons are numbered per code on the small (feature, polygon) table; the first name is kept."""
    from pyspark.sql import Window
    parts = features.select("code", "feature_id", "poly").distinct()
    numbered = parts.withColumn("new_poly", F.row_number().over(Window.partitionBy("code").orderBy("feature_id", "poly")) - 1)
    names = features.groupBy("code").agg(F.min_by("name", "feature_id").alias("first_name"), F.min("feature_id").alias("ordinal"))
    return (features.drop("ordinal").join(numbered, ["code", "feature_id", "poly"]).join(names, "code")
            .select("code", F.col("first_name").alias("name"), "ordinal", F.col("new_poly").alias("poly"), "ring", "seq", "lat", "lon"))


def layer_manifest(rings: DataFrame, kind: str) -> DataFrame:
    """Per country: areas, points and bounding box of a layer."""
    return (rings.groupBy(F.substring_index("code", ":", 1).alias("country"))
            .agg(F.count_distinct("code").alias("areas"), F.count(F.lit(1)).alias("points"),
                 F.round(F.min("lon"), 4).alias("min_lon"), F.round(F.min("lat"), 4).alias("min_lat"),
                 F.round(F.max("lon"), 4).alias("max_lon"), F.round(F.max("lat"), 4).alias("max_lat"))
            .withColumn("kind", F.lit(kind)))


def drop_slivers(rings: DataFrame, metres: float = AREA_SLIVER_M) -> DataFrame:
    """Drops polygons smaller than a square of ``metres``; keeps the largest if all are."""
    least = (metres / geo.BOX_METRES_PER_DEGREE) ** 2
    signed = F.when(F.col("ring") == 0, F.col("area")).otherwise(-F.col("area"))
    polys = tracks.ring_area(rings).groupBy("code", "poly").agg(F.sum(signed).alias("area"))
    best = polys.groupBy("code").agg(F.max(F.struct("area", "poly")).alias("top"))
    keep = polys.join(best, "code").filter((F.col("area") >= least) | ((F.col("top.area") < least) & (F.col("poly") == F.col("top.poly"))))
    return rings.join(keep.select("code", "poly"), ["code", "poly"], "left_semi")


def nearest_unvisited_area(starts: DataFrame, rings: DataFrame, visited: DataFrame, reach_deg: float = 1.0) -> DataFrame:
    """The unvisited area whose box centre lies nearest to each start.

    Centres are matched in growing rings of cells: starts without one within ``reach_deg`` are
    looked up again with the reach tripled, so no start is left out while any area remains."""
    centers = rings.groupBy("code", "ordinal").agg(((F.min("lat") + F.max("lat")) / 2).alias("clat"), ((F.min("lon") + F.max("lon")) / 2).alias("clon"))
    visited = cut(visited.select("athlete_id", "code").join(starts.select("athlete_id").distinct(), "athlete_id", "left_semi").distinct())
    pending, out, reach = starts, None, reach_deg
    while True:
        size = reach
        around = F.sequence(geo.cell("lat", size) - 1, geo.cell("lat", size) + 1)
        across = F.sequence(geo.cell("lon", size) - 1, geo.cell("lon", size) + 1)
        near = (pending.withColumn("cy", F.explode(around)).withColumn("cx", F.explode(across))
                .join(centers.withColumn("cy", geo.cell("clat", size)).withColumn("cx", geo.cell("clon", size)), ["cx", "cy"])
                .join(visited, ["athlete_id", "code"], "left_anti")
                .withColumn("d", geo.distance_m("clat", "clon", "lat", "lon")))
        # Only distances the searched ring surely covers are final.
        safe = size * geo.METRES_PER_DEGREE_LAT * F.greatest(F.cos(F.radians(F.abs("lat") + size)), F.lit(0.01)) if size < 90 else F.lit(float("inf"))
        found = (near.filter(F.col("d") <= safe).groupBy("athlete_id", "location_id")
                 .agg(F.min(F.struct("d", "ordinal", "code")).alias("m")).select("athlete_id", "location_id", F.col("m.code").alias("code"), F.col("m.d").alias("metres")))
        out = found if out is None else out.unionByName(found)
        if size >= 360:
            return out
        pending = cut(pending.join(found, ["athlete_id", "location_id"], "left_anti"))
        if pending.isEmpty():
            return out
        reach = min(reach * 3, 360.0)
