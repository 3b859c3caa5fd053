"""Targets and lines that stand on one spot are met once, and guessed sizes don't decide on broadcasts."""

from wayfold.operators import nearby, progress, routes
from wayfold.plans import challenge_results, review
from wayfold.session import measured_broadcasts
from workload import q_climbs

POINT = "athlete_id long, activity_id long, seq int, lat double, lon double"


def _marks(spark, ids):
    return spark.createDataFrame([(r, i, 50.0 + i * 0.0005 + (0.1 if r == 9 else 0), 5.0) for r in ids for i in range(4)], "route_id long, idx long, lat double, lon double")


def test_routes_with_equal_checkpoints_share_one(spark):
    same = {r.route_id: r.same for r in nearby.same_checkpoints(_marks(spark, [3, 4, 7, 9])).collect()}
    assert same == {3: 3, 4: 3, 7: 3, 9: 9}


def test_coverage_of_equal_routes(spark):
    track = spark.createDataFrame([(1, 1, 0, 50.0, 5.0), (1, 1, 1, 50.0006, 5.0)], POINT)
    marks = _marks(spark, [3, 4, 9])
    assert sorted(map(tuple, progress.tracks_coverage(track, marks).collect())) == [(1, 3, 0.5), (1, 4, 0.5)]
    assert sorted((r.route_id, r.idx) for r in nearby.checkpoint_hits(track, marks).collect()) == [(3, 0), (3, 1), (4, 0), (4, 1)]
    assert nearby.spot_hits(track, marks).count() == 2


def test_climbs_with_equal_checkpoints(spark):
    track = spark.createDataFrame([(1, 1, 0, 50.0, 5.0), (1, 1, 1, 50.0015, 5.0)], POINT)
    got = nearby.climb_matches(track, _marks(spark, [3, 4, 9]).withColumnRenamed("route_id", "climb_id"))
    assert sorted(r.climb_id for r in got.collect()) == [3, 4]


def test_equal_lines_and_queries(spark):
    lines = spark.createDataFrame([(i, 0, s, 50.0 + s * 0.01, 5.0) for i in (8, 5) for s in (0, 1)], "item_id long, piece int, seq int, lat double, lon double")
    asked = spark.createDataFrame([(1, 50.005, 5.001, 900.0), (2, 50.005, 5.001, 900.0), (3, 51.0, 5.0, 900.0)], "query_id long, lat double, lon double, radius double")
    assert sorted((r.query_id, r.item_id) for r in nearby.nearest_item(asked, lines).collect()) == [(1, 5), (2, 5)]


def test_cells_of_one_box(spark):
    stops = spark.createDataFrame([(1, 0, 50.1, 5.1), (1, 1, 50.2, 5.2)], "path_id long, seq int, lat double, lon double")
    cells = spark.createDataFrame([(1, 50.0, 5.0, 1.0, 10), (2, 50.0, 5.0, 1.0, 20), (3, 55.0, 5.0, 1.0, 40)], "cell_id long, lat double, lon double, size double, bytes long")
    assert routes.corridor_bytes(routes.corridor_cells(stops, cells, 1000.0)).first()[:] == (1, 2, 30)


def test_exploded_rows_are_not_broadcast_on_a_guess(spark, tmp_path):
    """200,000 keys lie in a file of less than a megabyte; the roads made of them have millions of rows."""
    spark.range(200_000).withColumnRenamed("id", "p_partkey").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    plan = q_climbs.trk_resample(measured_broadcasts(spark), str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_places_of_one_spot_are_not_exchanged_again(spark):
    pts = spark.createDataFrame([(1, k, i, 52.0 + 0.001 * i, 5.0) for k in (1, 2) for i in range(3)], "athlete_id long, activity_id long, seq int, lat double, lon double")
    here, there = (52.0005, 5.0, 200.0), (52.0015, 5.0, 200.0)
    rows = [("c", 1, *here), ("c", 1, *here), ("c", 2, *here), ("c", 3, *here), ("c", 3, *there), ("d", 3, *there), (None, 4, *there), ("c", 5, 40.0, 5.0, 200.0)]
    got = nearby.place_visits(pts, spark.createDataFrame(rows, "challenge_id string, item_id long, lat double, lon double, radius double"))
    want = [(k, c, i) for k in (1, 2) for c, i in (("c", 1), ("c", 2), ("c", 3), ("d", 3), (None, 4))]
    assert sorted(map(str, got.select("activity_id", "challenge_id", "item_id").toLocalIterator())) == sorted(f"Row(activity_id={k}, challenge_id={c!r}, item_id={i})" for k, c, i in want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Aggregate [") == 1


def test_visits_of_places_of_one_spot(spark):
    places = spark.createDataFrame([("c", i, 52.0, 5.0, 200.0) for i in (1, 2)] + [("c", 3, 53.0, 5.0, 200.0), ("d", 1, 52.0, 5.0, 200.0)], "challenge_id string, item_id long, lat double, lon double, radius double")
    same = challenge_results.same_items(places)
    first = {(r.challenge_id, r.item_id) for r in challenge_results.first_items(places, same).collect()}
    assert first == {("c", 1), ("c", 3), ("d", 1)}
    hits = spark.createDataFrame([(1, k, c, i, "k") for k in (10, 11) for c, i in (("c", 1), ("d", 1))], "athlete_id long, activity_id long, challenge_id string, item_id long, key string")
    acts = spark.createDataFrame([(1, k, k * 100000) for k in (10, 11)], "athlete_id long, activity_id long, t long").selectExpr("athlete_id", "activity_id", "timestamp_seconds(t) as start_ts")
    live = spark.createDataFrame([("c", "k"), ("d", "k")], "challenge_id string, key string")
    got = progress.visit_dates(hits, live, acts, same).selectExpr("challenge_id", "item_id", "ord", "unix_seconds(visit_ts) as t").collect()
    assert sorted(map(tuple, got)) == [(c, i, n, t) for c, i in (("c", "1"), ("c", "2"), ("d", "1")) for n, t in ((1, 1100000), (2, 1000000))]


def test_coverage_of_the_first_of_equal_routes(spark):
    track = spark.createDataFrame([(1, 1, 0, 50.0, 5.0), (1, 1, 1, 50.0006, 5.0)], POINT)
    marks = _marks(spark, [3, 4, 9])
    shares = progress.first_coverage(track, marks, nearby.same_checkpoints(marks))
    assert sorted(map(tuple, shares.collect())) == [(1, 3, 0.5)]
    challenge = spark.createDataFrame([("r", True, 0.5)], "challenge_id string, is_cover boolean, coverage double")
    named = shares.selectExpr("athlete_id", "'r' as challenge_id", "string(route_id) as route_id", "share")
    copies = spark.createDataFrame([("r", "3", 2), ("r", "9", 1)], "challenge_id string, item_id string, copies long")
    none = spark.createDataFrame([], "athlete_id long, challenge_id string, item_id string")
    assert list(map(tuple, progress.challenge_done(named, spark.createDataFrame([("r", 3)], "challenge_id string, total long"), none, challenge, copies).collect())) == [(1, "r", 2, 3)]


def test_new_ids_count_their_copies(spark):
    acts = spark.createDataFrame([(1, 1, "2023-05-01"), (1, 2, "2024-05-01"), (1, 3, "2024-06-01")], "athlete_id long, activity_id long, t string").selectExpr("athlete_id", "activity_id", "timestamp(t) as start_ts")
    facts = spark.createDataFrame([(1, 1, 7, 4), (1, 2, 7, 4), (1, 2, 8, 3), (1, 3, 8, 3), (1, 3, 9, 1)], "athlete_id long, activity_id long, climb_id long, copies long")
    assert review._new_ids(facts, acts, "climb_id", 2024, "UTC", "n").collect() == [(1, 4)]
    assert review._new_ids(facts.drop("copies"), acts, "climb_id", 2024, "UTC", "n").collect() == [(1, 2)]
