"""What candidate routes pass, with places that share spots, known places and requested targets."""

from pyspark.sql import functions as F

from wayfold.operators import areas, routes

LINE = "athlete_id long, route_id long, seq int, lat double, lon double"
PLACE = "challenge_id string, item_id long, lat double, lon double, radius double"
RING = "code string, name string, ordinal int, poly int, ring int, seq int, lat double, lon double"
TARGET_COLUMNS = ["athlete_id", "route_id", "kind", "id"]
TARGET = "athlete_id long, route_id long, kind string, id string"


def lines(spark):
    return spark.createDataFrame([(a, 10 * a + k, i, 52.0 + 0.001 * i, 5.0 + k) for a in (1, 2) for k in (0, 1) for i in range(3)], LINE)


def places(spark):
    here, there = (52.0005, 5.0, 200.0), (52.0015, 5.0, 200.0)
    # Place 3 stands on two spots and in two challenges; place 4 lies far away.
    return spark.createDataFrame([("c", 1, *here), ("c", 2, *here), ("c", 3, *here), ("d", 3, *there), ("c", 4, 40.0, 5.0, 200.0), ("d", 5, *there)], PLACE)


def test_places_of_one_spot_known_and_new(spark):
    known = spark.createDataFrame([(1, "place", "2"), (2, "place", "3"), (2, "area", "1")], "athlete_id long, kind string, id string")
    passed, new = (df.filter("kind = 'place'").select(*TARGET_COLUMNS).collect() for df in routes.new_things(lines(spark), known, places=places(spark)))
    every = [(a, 10 * a, "place", str(i)) for a in (1, 2) for i in (1, 2, 3, 5)]
    assert sorted(map(tuple, passed)) == every
    assert sorted(map(tuple, new)) == [r for r in every if (r[0], r[3]) not in {(1, "2"), (2, "3")}]


def test_only_requested_targets_are_looked_up(spark):
    ring = [("A", "a", 0, 0, 0, i, a, o) for i, (a, o) in enumerate([(51.9, 4.9), (51.9, 5.1), (52.1, 5.1), (52.1, 4.9)])]
    index = areas.cell_index(spark.createDataFrame(ring, RING))
    passed, _ = routes.new_things(lines(spark), spark.createDataFrame([], "athlete_id long, kind string, id string"), index, places=places(spark))
    wanted = spark.createDataFrame([(1, 10, "place", "3"), (1, 10, "place", "4"), (1, 11, "place", "1"), (2, 20, "area", "A"), (2, 21, "area", "A"), (1, 10, "tile", ""), (2, 20, "other", "x")], TARGET)
    wanted = wanted.withColumn("id", F.when(F.col("kind") == "tile", passed.filter("kind = 'tile' and route_id = 10").agg(F.min("id")).scalar()).otherwise(F.col("id")))
    slow, fast = (sorted(map(tuple, routes.missed_targets(wanted, p).collect())) for p in (passed, routes.passed_targets(wanted, lines(spark), index, places=places(spark))))
    assert slow == fast == [(1, 10, "place", "4"), (1, 11, "place", "1"), (2, 20, "other", "x"), (2, 21, "area", "A")]


def test_edges_of_a_cell_are_tested_once_a_point(spark):
    ring = [("A", "a", 0, 0, 0, i, a, o) for i, (a, o) in enumerate([(51.9, 4.9), (51.9, 5.1), (52.1, 5.1), (52.1, 4.9)])]
    found = areas.located(lines(spark), areas.cell_index(spark.createDataFrame(ring, RING)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [row for row in plan.splitlines() if "Filter" in row.split("(")[0] and "exists(" in row]
    assert found.count() == 6


def test_climbs_count_and_own_tracks_are_known(spark):
    up = [(52.0 + 0.0005 * i, 5.0) for i in range(5)]
    marks = spark.createDataFrame([(c, i, a, o + x) for c, x in ((7, 0.0), (8, 0.0), (9, 1.0)) for i, (a, o) in enumerate(up)], "climb_id long, idx long, lat double, lon double")
    # Athlete 1 passed one of the two spots of place 3 and that of place 5, no climb; athlete 2 rode the far road.
    own = spark.createDataFrame([(1, 5, i, 52.003 + 0.0005 * i, 5.0) for i in range(2)] + [(2, 6, i, 52.0 + 0.001 * i, 6.0) for i in range(3)], "athlete_id long, activity_id long, seq int, lat double, lon double")
    known = spark.createDataFrame([(1, "climb", "8")], "athlete_id long, kind string, id string")
    passed, new = (sorted(map(tuple, df.filter("kind <> 'tile'").collect())) for df in routes.new_things(lines(spark), known, None, marks, places(spark), own))
    climbed = [(a, 10 * a + k, "climb", c) for a in (1, 2) for k, c in ((0, "7"), (0, "8"), (1, "9"))]
    assert passed == sorted(climbed + [(a, 10 * a, "place", i) for a in (1, 2) for i in "1235"])
    assert new == sorted([r for r in climbed if (r[0], r[3]) not in {(1, "8"), (2, "9")}] + [(1, 10, "place", i) for i in "12"] + [(2, 20, "place", i) for i in "1235"])
