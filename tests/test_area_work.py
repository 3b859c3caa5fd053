"""Point location and area search do no work twice and none that a box rules out."""

from pyspark.sql import functions as F

from wayfold.operators import areas


def squares(spark):
    corners = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    rows = [(f"C{i % 2}:{i}", i, 0, 0, s, 50.1 + 0.2 * (i // 3) + 0.2 * y, 4.1 + 0.2 * (i % 3) + 0.2 * x) for i in range(6) for s, (y, x) in enumerate(corners)]
    return spark.createDataFrame(rows, "code STRING, ordinal INT, poly INT, ring INT, seq INT, lat DOUBLE, lon DOUBLE")


def test_edges_are_tested_only_inside_an_areas_box(spark):
    index = areas.cell_index(squares(spark), 1.0)
    points = spark.createDataFrame([(i, 50.05 + 0.05 * (i % 11), 4.05 + 0.05 * (i // 11)) for i in range(165)], "id INT, lat DOUBLE, lon DOUBLE")
    found = {r["id"]: r["code"] for r in areas.located(points, index, 1.0).collect()}
    inside = {i for i, lat, lon in points.collect() if 50.1 < lat < 50.5 and 4.1 < lon < 4.7}
    assert inside <= set(found) and set(found.values()) == {f"C{i % 2}:{i}" for i in range(6)}
    # With the box of area 4 moved away its edges aren't asked, the others' are.
    moved = index.withColumn("areas", F.transform("areas", lambda a: F.when(a["ordinal"] == 4, a.withField("box", a["box"].withField("s", F.lit(80.0)))).otherwise(a)))
    rest = {r["id"]: r["code"] for r in areas.located(points, moved, 1.0).collect()}
    assert rest == {i: c for i, c in found.items() if c != "C0:4"} and len(rest) < len(found)


def test_visited_areas_are_computed_once_for_all_rounds(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(code):
        met.add(1)
        return code

    visited = spark.createDataFrame([(1, "C0:0"), (1, "C1:1"), (7, "C0:2")], "athlete_id BIGINT, code STRING").withColumn("code", seen("code"))
    starts = spark.createDataFrame([(1, 1, 50.2, 4.2), (2, 2, 50.2, 4.2), (1, 3, 58.0, 20.0)], "athlete_id BIGINT, location_id BIGINT, lat DOUBLE, lon DOUBLE")
    got = {r["location_id"]: r["code"] for r in areas.nearest_unvisited_area(starts, squares(spark), visited).collect()}
    assert got == {1: "C1:3", 2: "C0:0", 3: "C1:5"}
    assert met.value <= 3
