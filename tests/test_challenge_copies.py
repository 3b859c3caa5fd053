"""Items of one place or line are matched once in the challenge plan and count as many."""

from wayfold.plans import challenge_results as cr


def test_items_of_one_geometry(spark):
    acts = spark.createDataFrame([(1, 10, "Cycling", False, 4)], "athlete_id long, activity_id long, sport string, is_virtual boolean, n_points long")
    points = spark.createDataFrame([(1, 10, i, 52.0 + 0.001 * i, 5.0) for i in range(4)], "athlete_id long, activity_id long, seq int, lat double, lon double")
    live = spark.createDataFrame([("p", "k", "locations", "cover", 50.0, 0.5, None), ("t", "k", "routes", "cover", 50.0, 0.5, None), ("f", "k", "routes", "cross", 50.0, 0.5, None)],
                                 "challenge_id string, key string, kind string, complete string, spacing double, coverage double, sports array<string>")
    places = spark.createDataFrame([("p", i, 52.001, 5.0, r) for i, r in ((1, 100.0), (2, 100.0), (3, 150.0))] + [("p", 4, 40.0, 5.0, 100.0)],
                                   "challenge_id string, item_id long, lat double, lon double, radius double")
    along, away = [(52.0, 5.0), (52.002, 5.0)], [(41.0, 5.0), (41.002, 5.0)]
    lines = spark.createDataFrame([(c, i, 0, s, a, o) for c in ("t", "f") for i, pts in ((1, along), (2, along), (3, away), (10, along)) for s, (a, o) in enumerate(pts)],
                                  "challenge_id string, item_id long, piece int, seq int, lat double, lon double")
    results = cr.update(cr.empty(spark), acts, points, live, places, lines)
    same = cr.same_items(places, lines)
    assert {(r.challenge_id, r.item_id): r.same for r in same.collect()} == {
        ("p", "1"): "1", ("p", "2"): "1", ("p", "3"): "3", ("p", "4"): "4", **{(c, i): s for c in ("t", "f") for i, s in (("1", "1"), ("2", "1"), ("10", "1"), ("3", "3"))}}
    assert {(r.challenge_id, r.item_id) for r in results.hits.collect()} == {("p", "1"), ("p", "3"), ("t", "1"), ("f", "1")}
    every = cr.hits_of_items(results, same)
    assert {(r.challenge_id, r.item_id) for r in every.collect()} == {("p", "1"), ("p", "2"), ("p", "3"), *[(c, i) for c in ("t", "f") for i in ("1", "2", "10")]}
    assert {(r.challenge_id, r.done, r.total, r.checked) for r in cr.standing(results, live, places, lines).collect()} == {("p", 3, 4, 1), ("t", 3, 4, 1), ("f", 3, 4, 1)}
