"""Pieces of roads joined into lines: end to end, and over short gaps.

Ends of pieces are linked pairwise (an end has at most one link); linked pieces form chains whose
order comes from list ranking, so a road of any length is put together in logarithmic rounds.
Where an order of processing would decide between equally good continuations, a total order on
(road class change, turn, way id) decides instead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import graph, ordered
from wayfold.session import cut

# Metres bridged between ends of one road, rounds, end cells and gap positions.
GAP_M, END_CELLS_PER_DEGREE = 300.0, 200
GAP_SHARES = (0.02, 0.98)


def piece_ends(points: DataFrame) -> DataFrame:
    """Both ends of each piece (way_id, end, key, class, lat, lon, and the unit way out of it)."""
    near = ordered.neighbours(points, ["way_id"], {"nlat": ("lat", 1), "nlon": ("lon", 1), "plat": ("lat", -1), "plon": ("lon", -1)})
    first, last = F.col("plat").isNull(), F.col("nlat").isNull()
    both = near.filter(first | last).withColumn("end", F.explode(F.when(first & last, F.array().cast("array<int>")).when(first, F.array(F.lit(0))).otherwise(F.array(F.lit(1)))))
    dx, dy = F.coalesce("nlon", "plon") - F.col("lon"), F.coalesce("nlat", "plat") - F.col("lat")
    size = F.hypot(dx, dy)
    return both.select("way_id", "end", "key", "class", "lat", "lon", F.when(size > 0, dx / size).otherwise(0.0).alias("dx"), F.when(size > 0, dy / size).otherwise(0.0).alias("dy"))


def touching_links(ends: DataFrame) -> DataFrame:
    """Links (a_way, a_end, b_way, b_end), both ways round, between pieces of a key that meet.

    Unnamed pieces link only where exactly two meet; elsewhere ends that prefer each other (same
    class first, then straightest on) link, round by round among the ends still free. Only ends on
    one point of one road are compared, a handful at any junction."""
    spot = ["key", "y", "x"]
    at = cut(ends.withColumn("y", F.round("lat", 6)).withColumn("x", F.round("lon", 6)))
    unnamed = at.filter("key is null").drop("key")
    pairs = unnamed.groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("way_id", "end")).alias("a"), F.max(F.struct("way_id", "end")).alias("b"))
    found = pairs.filter((F.col("n") == 2) & (F.col("a.way_id") != F.col("b.way_id"))).select(F.col("a.way_id").alias("a_way"), F.col("a.end").alias("a_end"), F.col("b.way_id").alias("b_way"), F.col("b.end").alias("b_end"))
    out = found.unionByName(found.select(F.col("b_way").alias("a_way"), F.col("b_end").alias("a_end"), F.col("a_way").alias("b_way"), F.col("a_end").alias("b_end")))
    free = at.filter("key is not null")
    while True:
        a = free.select(*spot, F.struct("way_id", "end").alias("a"), F.col("class").alias("ac"), F.col("dx").alias("ax"), F.col("dy").alias("ay"))
        b = free.select(*spot, F.struct("way_id", "end").alias("b"), F.col("class").alias("bc"), F.col("dx").alias("bx"), F.col("dy").alias("by"))
        # Straight on leaves the point opposite to where the other piece leaves it: cosine -1.
        rank = F.struct((F.col("ac") != F.col("bc")).alias("c"), F.round(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by"), 9).alias("turn"), F.col("b").alias("b"))
        best = a.join(b, spot).filter(F.col("a.way_id") != F.col("b.way_id")).groupBy("a").agg(F.min(rank).alias("m")).select("a", F.col("m.b").alias("b"))
        best = cut(best)
        mutual = best.join(best.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"])
        links = cut(mutual.select(F.col("a.way_id").alias("a_way"), F.col("a.end").alias("a_end"), F.col("b.way_id").alias("b_way"), F.col("b.end").alias("b_end")))
        if links.isEmpty():
            return cut(out)
        out = out.unionByName(links)
        free = cut(free.join(links.select(F.col("a_way").alias("way_id"), F.col("a_end").alias("end")), ["way_id", "end"], "left_anti"))


def near_links(ends: DataFrame) -> DataFrame:
    """Links between ends of one key that are each other's nearest end within 300 m."""
    c = 1.0 / END_CELLS_PER_DEGREE
    named = cut(ends.filter("key is not null").select("key", F.struct("way_id", "end").alias("e"), "lat", "lon"))
    a = (named.withColumn("cy", F.explode(F.sequence(geo.cell("lat", c) - 1, geo.cell("lat", c) + 1))).withColumn("cx", F.explode(F.sequence(geo.cell("lon", c) - 1, geo.cell("lon", c) + 1))))
    b = named.select("key", F.col("e").alias("o"), F.col("lat").alias("olat"), F.col("lon").alias("olon"), geo.cell("lat", c).alias("cy"), geo.cell("lon", c).alias("cx"))
    d = F.hypot((F.col("olon") - F.col("lon")) * F.cos(F.radians("lat")), F.col("olat") - F.col("lat")) * geo.METRES_PER_DEGREE_LON
    best = cut(a.join(b, ["key", "cy", "cx"]).filter((F.col("o.way_id") != F.col("e.way_id")) & (d < GAP_M)).groupBy("e").agg(F.min(F.struct(F.round(d, 6).alias("d"), "o")).alias("m")).select("e", F.col("m.o").alias("o")))
    return best.join(best.select(F.col("o").alias("e"), F.col("e").alias("o")), ["e", "o"]).select(F.col("e.way_id").alias("a_way"), F.col("e.end").alias("a_end"), F.col("o.way_id").alias("b_way"), F.col("o.end").alias("b_end"))


def assemble(ways: DataFrame, links: DataFrame) -> DataFrame:
    """(way_id, path_id, ord, reversed) of linked ways; ``path_id`` is the path's smallest way.

    Rings are opened at their smallest way. Each path is read from its smaller end."""
    links = cut(links)
    labels = graph.components(links.select(F.lit(0).alias("_g"), F.col("a_way").alias("src"), F.col("b_way").alias("dst")), ["_g"]).select(F.col("node").alias("way_id"), F.col("label").alias("path_id"))
    members = cut(ways.select("way_id").distinct().join(labels, "way_id", "left").withColumn("path_id", F.coalesce("path_id", "way_id")))
    sizes = members.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"))
    counts = links.join(members.withColumnRenamed("way_id", "a_way"), "a_way").groupBy("path_id").agg((F.count(F.lit(1)) / 2).alias("links"))
    rings = sizes.join(counts, "path_id").filter("links >= n").select(F.col("path_id").alias("ring"))
    opened = links.join(rings.select(F.col("ring").alias("a_way"), F.lit(0).alias("a_end")), ["a_way", "a_end"], "left_anti").join(rings.select(F.col("ring").alias("b_way"), F.lit(0).alias("b_end")), ["b_way", "b_end"], "left_anti")
    # A directed node enters a way at one end and leaves it at the other.
    nodes = members.withColumn("enter", F.explode(F.array(F.lit(0), F.lit(1))))
    onward = opened.select(F.col("a_way").alias("way_id"), (1 - F.col("a_end")).alias("enter"), F.struct(F.col("b_way").alias("way_id"), F.col("b_end").alias("enter")).alias("next"))
    chained = nodes.join(onward, ["way_id", "enter"], "left").select("path_id", F.struct("way_id", "enter").alias("node"), "next")
    ranked = graph.count_to_end(chained, ["path_id"])
    last = F.struct(F.col("last.way_id").alias("way_id"), (1 - F.col("last.enter")).alias("end"))
    ranked = cut(ranked.withColumn("exit", last))
    ends = ranked.groupBy("path_id").agg(F.max("exit").alias("exit"))
    kept = ranked.join(ends, ["path_id", "exit"]).join(sizes, "path_id")
    return kept.select(F.col("node.way_id").alias("way_id"), "path_id", (F.col("n") - F.col("steps")).alias("ord"), (F.col("node.enter") == 1).alias("reversed"))


def joined_points(points: DataFrame, order: DataFrame, gap: bool = False) -> DataFrame:
    """Points of the assembled lines (way_id is the path), renumbered; shared points appear once.

    With ``gap`` pieces don't touch: two flat points just inside each gap are added instead."""
    sized = points.groupBy("way_id").agg(F.max("seq").alias("_top"))
    rows = points.join(sized, "way_id").join(order, "way_id").withColumn("_s", F.when(F.col("reversed"), F.col("_top") - F.col("seq")).otherwise(F.col("seq")))
    if not gap:
        rows = rows.filter((F.col("ord") == 0) | (F.col("_s") > 0))
    block = F.col("ord") * 1_000_000 + F.floor(F.col("_s") / ordered.BLOCK)
    flat = rows.select(F.col("path_id"), "ord", F.col("_s"), F.lit(0).alias("_g"), block.alias("_b"), "key", "class", "name", "lat", "lon", "flat")
    if gap:
        ends = rows.filter((F.col("_s") == 0) | (F.col("_s") == F.col("_top")))
        tail = ends.filter(F.col("_s") == F.col("_top")).select("path_id", (F.col("ord") + 1).alias("ord"), F.struct("lat", "lon", "class").alias("t"), F.col("_s").alias("_ts"))
        head = ends.filter("_s = 0").select("path_id", "ord", "key", F.struct("lat", "lon").alias("h"))
        at = tail.join(head, ["path_id", "ord"]).withColumn("_g", F.explode(F.array(F.lit(1), F.lit(2))))
        share = F.when(F.col("_g") == 1, GAP_SHARES[0]).otherwise(GAP_SHARES[1])
        bridge = at.select("path_id", (F.col("ord") - 1).alias("ord"), F.col("_ts").alias("_s"), "_g", ((F.col("ord") - 1) * 1_000_000 + F.floor(F.col("_ts") / ordered.BLOCK)).alias("_b"), "key", F.col("t.class").alias("class"),
                           F.lit(None).cast("string").alias("name"), (F.col("t.lat") + (F.col("h.lat") - F.col("t.lat")) * share).alias("lat"), (F.col("t.lon") + (F.col("h.lon") - F.col("t.lon")) * share).alias("lon"), F.lit(True).alias("flat"))
        flat = flat.unionByName(bridge)
    numbered = ordered.ordinals(flat, ["path_id"], ["ord", "_s", "_g"], F.col("_b"), "_n")
    return numbered.select(F.col("path_id").alias("way_id"), (F.col("_n") - 1).cast("int").alias("seq"), "lat", "lon", "key", "class", "name", "flat")


def chain(points: DataFrame) -> DataFrame:
    """Pieces (way_id, seq, lat, lon, key, class, name, flat) of a road joined end to end."""
    return joined_points(points, assemble(points, touching_links(piece_ends(points))))


def stitch(points: DataFrame) -> DataFrame:
    """Lines of a road joined over gaps of up to 300 m until no link is left. Every round joins at
    least one pair of lines, so the rounds end."""
    while True:
        links = cut(near_links(piece_ends(points)))
        if links.isEmpty():
            break
        points = cut(joined_points(points, assemble(points, links), gap=True))
    return points
