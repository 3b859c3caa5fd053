"""Joining road pieces: roads of ten pieces derived from ``part``, some pieces moved aside."""

from pyspark.sql import functions as F

from wayfold.operators import lines
from workload import fixtures as fx
from workload.registry import query


# Latitudes of roads in one block, and degrees between the blocks.
ROWS, BLOCK_LAT = 400, 0.00001


def pieces(spark, sf):
    """Piece j of a road runs 200 m east from j; every third is drawn backwards. One in 17 lies
    2 km aside, which leaves a gap in its road. Roads lie between 50 and 70 degrees, where the gaps are
    under 300 m; every 400 roads start a new block of latitudes, 0.00001 degrees further north."""
    p = F.col("p_partkey")
    base = fx.table(spark, sf, "part").select(p.alias("way_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq"))
    k, s = F.col("way_id"), F.col("seq")
    along = F.when(k % 3 == 0, 2 - s).otherwise(s)
    road = F.floor(k / 10)
    return base.select("way_id", "seq", (F.lit(50.0) + road % ROWS * F.lit(0.05) + F.floor(road / ROWS) * F.lit(BLOCK_LAT) + F.when(k % 17 == 5, 0.02).otherwise(0.0)).alias("lat"), (F.lit(5.0) + (k % 10) * F.lit(0.003) + along * F.lit(0.0015)).alias("lon"),
                       F.when(road % 4 != 3, F.concat(F.lit("R"), road.cast("string"))).alias("key"), F.lit(2).alias("class"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("flat"))


PIECES_SQL = """pieces AS (SELECT p_partkey AS way_id, p_partkey // 10 AS road, p_partkey % 10 AS j, p_partkey % 17 = 5 AS aside FROM part),
runs AS (SELECT *, CASE WHEN aside THEN -100 - j ELSE j - row_number() OVER (PARTITION BY road, aside ORDER BY j) END AS g FROM pieces),
paths AS (SELECT road, g, min(way_id) AS path_id, count(*) AS n, min(j) AS j0, max(j) AS j1 FROM runs GROUP BY 1, 2)"""


@query("win_chain_lines", fx.oracle("SELECT way_id, path_id, j - j0 AS ord, way_id % 3 = 0 AS reversed FROM runs JOIN paths USING (road, g)", PIECES_SQL))
def win_chain_lines(spark, sf):
    """Order and direction of the pieces; paths are compared from their western end."""
    rows = pieces(spark, sf)
    out = lines.assemble(rows, lines.touching_links(lines.piece_ends(rows)))
    sizes = out.groupBy("path_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("way_id", "ord").alias("first"))
    flip = F.col("first") != F.col("path_id")
    lone = F.col("n") == 1
    return out.join(sizes, "path_id").select("way_id", "path_id", F.when(flip, F.col("n") - 1 - F.col("ord")).otherwise(F.col("ord")).alias("ord"),
                                             F.when(lone, F.col("way_id") % 3 == 0).otherwise(F.col("reversed") != flip).alias("reversed"))


@query("win_chain_points", fx.oracle("SELECT path_id AS way_id, (2 * n + 1) AS points, round(5e0 + j0 * 0.003e0, 6) AS west, round(5e0 + (j1 + 1) * 0.003e0, 6) AS east FROM paths", PIECES_SQL))
def win_chain_points(spark, sf):
    return lines.chain(pieces(spark, sf)).groupBy("way_id").agg(F.count(F.lit(1)).alias("points"), F.round(F.min("lon"), 6).alias("west"), F.round(F.max("lon"), 6).alias("east"))


@query("jn_mutual_nearest_ends", fx.oracle("""
SELECT road, min(path_id) AS way_id, sum(2 * n + 1)::BIGINT + 2 * (count(*) - 1) AS points, 2 * (count(*) - 1) AS flat FROM paths WHERE road % 4 <> 3 AND g > -100 GROUP BY 1
UNION ALL SELECT road, path_id, 2 * n + 1, 0 FROM paths WHERE road % 4 = 3 OR g <= -100""", PIECES_SQL))
def jn_mutual_nearest_ends(spark, sf):
    """Named roads close their 200 m gaps; unnamed pieces stay apart."""
    out = lines.stitch(lines.chain(pieces(spark, sf)))
    row = F.floor((F.col("lat") - 50) / 0.05 + 1e-6)
    north = F.col("lat") - 50 - row * F.lit(0.05)
    block = F.floor(F.rint((north - F.when(north > 0.02 - BLOCK_LAT / 2, 0.02).otherwise(0.0)) / BLOCK_LAT))
    return out.groupBy((block * ROWS + row).alias("road"), "way_id").agg(F.count(F.lit(1)).alias("points"), F.count_if("flat").alias("flat"))
