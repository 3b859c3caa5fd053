"""The whole climb list on one road over a ramp."""

from pyspark.sql import functions as F

from wayfold.operators import climbs, profiles
from wayfold.plans.climb_list import climb_list


def test_one_climb_from_two_pieces(spark):
    n = 50
    raster = spark.range((n + 1) ** 2).select(F.lit(50).cast("long").alias("cell_lat"), F.lit(6).cast("long").alias("cell_lon"), F.floor(F.col("id") / (n + 1)).alias("row"), (F.col("id") % (n + 1)).alias("col"))
    raster = raster.withColumn("elev", (F.lit(6000.0) * (1 - F.col("row") / n)).cast("int"))
    roads = [(w, s, 50.5 + (w * 3 + s) * 0.005, 6.5, "D 1", 1, "Col Road", False) for w in (0, 1) for s in range(4)]
    road_points = spark.createDataFrame(roads, "way_id long, seq int, lat double, lon double, key string, class int, name string, flat boolean")
    places = spark.createDataFrame([("Top", 50.53, 6.51), ("Far", 50.9, 6.9)], "name string, lat double, lon double")
    rows = climb_list(road_points, raster, places, n).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["name"], r["place"], r["cat"]) == ("Col Road", "Top", "3") and 3200 <= r["length"] <= 3340 and 170 <= r["gain"] <= 182 and 5.2 <= r["avg"] <= 5.6 and r["line"]


def test_climbs_without_a_named_road_are_kept(spark):
    # 3 m up every 20 m northwards over 20 points 100 m apart; the names differ, the last road has none.
    names = {1: ["A"] * 12 + ["B"] * 8, 2: ["C"] * 5 + [None] * 15, 3: [None] * 20}
    lat = [50 + s * 100 / 111_320 for s in range(20)]
    rows = [(k, lat, [6.0] * 20, row, [3.0 * i for i in range(95)]) for k, row in names.items()]
    profiled = spark.createDataFrame(rows, "line_id long, lat array<double>, lon array<double>, name array<string>, elev array<double>")
    got = {(r.line_id, r.reverse): r for r in climbs.metrics(profiles.find(profiled)).collect()}
    assert {k: r["name"] for k, r in got.items()} == {(1, False): "B", (2, False): "C", (3, False): None}
    r = got[1, False]
    assert (r["size"], r["start"], r["top"], r["elev0"], r["elev1"]) == (95, 0, 94, 0.0, 282.0) and abs(r["max"] - 15) < 1e-9 and abs(r["lat1"] - (50 + 1880 / 111_320)) < 1e-9


def test_profiles_exchange_posts_and_no_samples(spark):
    """A line's samples were exchanged and stored several times; only its points, posts and heights are."""
    n, side = 1200, 60
    raster = spark.range(side * side).select(F.lit(50).cast("long").alias("cell_lat"), F.lit(6).cast("long").alias("cell_lon"), (F.floor(F.col("id") / side) + 570).alias("row"), (F.col("id") % side + 570).alias("col"))
    raster = raster.withColumn("elev", F.when((F.col("row") == 580) & (F.col("col") == 620), climbs.VOID).otherwise((F.col("row") * 7 + F.col("col") * 3).cast("int")))
    points = [(k, s, 50.5 + s * 0.002, 6.5 + k * 0.008 + s * 0.0001, flat(s)) for k, flat in ((0, lambda s: s in (1, 2)), (1, lambda s: True), (2, lambda s: s == 0), (3, lambda s: False)) for s in range(9)] + [(9, 0, 50.5, 6.5, False), (9, 1, 50.501, 6.5, False)]
    line_points = spark.createDataFrame(points, "line_id long, seq int, lat double, lon double, flat boolean")
    lines = profiles.gather(line_points, "flat")
    samples = climbs.resample(line_points.withColumn("name", F.lit(None).cast("string")))
    whole = climbs.with_elevation(samples, raster, n)
    filled = climbs.fill_flat(whole)
    for upto, want in (("bilinear", climbs.with_elevation(samples, raster, n, drop_lines=False)), ("whole", whole), ("filled", filled), ("smooth", climbs.smooth(filled))):
        got = profiles.profile(lines, raster, n, upto)
        values, expected = ({(r.line_id, r.i): r.elev for r in df.collect()} for df in (profiles.samples(got), want))
        assert values.keys() == expected.keys() and all((e is None) == (values[k] is None) and (e is None or abs(e - values[k]) < 1e-6) for k, e in expected.items()), upto
    assert {k for k, _ in values} == {0}  # 1 is flat throughout, 2 meets the void, 3 leaves the raster, 9 is short
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan[:plan.index("SortMergeJoin")]  # no row per sample before the join with the lines
